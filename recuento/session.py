"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(
    app_name: str = "recuento",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings the operators count on.

    Adaptive execution picks the join side to broadcast from measured sizes and
    splits skewed join partitions; the time zone is fixed so that timestamps
    mean the same on every machine. Java does not compile methods of over 8,000
    bytes: where a stage of many columns would generate one, Spark cuts it into
    smaller ones instead. On a cluster leave ``master`` unset.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Where that is unset, a folder in the warehouse (``spark.sql.warehouse.dir``),
    which a cluster shares as well. A machine's temporary folder is never used.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stored"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    path = f"{shared_dir(spark)}/recuento/{name}-{uuid.uuid4().hex}"
    if _stored:
        _stored[-1].append(path)
    return path


_stored: list[list[str]] = []


@contextmanager
def stored_tables(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the intermediate tables that were stored inside.

    What is read lazily from them must be written before the end.
    """
    _stored.append([])
    try:
        yield
    finally:
        for path in _stored.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    The lineage is cut at a table that outlives any executor, and readers see
    the same rows in the same files however often a task is repeated.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
