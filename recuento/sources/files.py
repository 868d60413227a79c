"""CSV and Parquet deliveries, typed snapshots and the published table.

Codes such as ``"09"`` are text and must stay text, so no scan infers types:
every one takes a schema or the types of the columns it needs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recuento.sources.schemas import REGION_VERTICES, VOCABULARY

MISSING_TEXT = "NA"

ROWS_PER_FILE = 1_000_000
"""Rows of a published CSV file at most."""


_CORRUPT = "__corrupt"
_REJECTED = "__rejected"


def _csv_options(encoding: str, name_pattern: str | None, trim: bool = True) -> dict[str, str]:
    options = {
        "header": "true",
        "encoding": encoding,
        "nullValue": MISSING_TEXT,
        "emptyValue": "",
        "quote": '"',
        "escape": '"',
        "multiLine": "true",
        "ignoreLeadingWhiteSpace": str(trim).lower(),
        "ignoreTrailingWhiteSpace": str(trim).lower(),
        "enforceSchema": "false",
        "columnNameOfCorruptRecord": _CORRUPT,
    }
    if name_pattern:
        options["pathGlobFilter"] = name_pattern
    return options


def _typed(cell: Column, kind: T.DataType) -> Column:
    """A cell as its type, NULL if it does not fit; whole numbers may be written ``7.0``."""
    plain = cell.try_cast(kind)
    if isinstance(kind, T.IntegralType):
        number = cell.try_cast("double")
        plain = F.coalesce(plain, F.when(number == F.floor(number), number.try_cast(kind)))
    return plain


def _as_text(spark: SparkSession, paths: list[str], schema: T.StructType, options: Mapping[str, str]) -> DataFrame:
    """The cells as text, empty ones NULL, and the whole row where its cells do not match the header."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField(_CORRUPT, T.StringType())])
    df = spark.read.schema(text).options(**options).csv(paths)
    return df.select(*[F.nullif(F.col(f"`{f.name}`"), F.lit("")).alias(f.name) for f in schema.fields], _CORRUPT)


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    *,
    encoding: str = "UTF-8",
    name_pattern: str | None = None,
    trim: bool = True,
    bad: str = "fail",
) -> DataFrame:
    """Header CSV with a full schema; empty cells and ``NA`` are NULL.

    Quoted cells may hold line breaks, kept as written, and doubled quotes. So a
    file cannot be cut into pieces and one task reads it: deliver many files,
    and land them as Parquet before they are read more than once. The header of
    every file is compared with the schema. ``name_pattern`` keeps only the
    files whose name fits, such as ``*Personas*``. Blanks around an unquoted
    cell are dropped unless ``trim`` is off.

    A cell that does not fit its type, or a row with too few or too many cells,
    fails the job; with ``bad="null"`` such cells are NULL, and ``bad_cells``
    lists them.
    """
    if bad not in ("fail", "null"):
        raise ValueError("bad is 'fail' or 'null'")
    paths = [path] if isinstance(path, str) else list(path)
    cells = _as_text(spark, paths, schema, _csv_options(encoding, name_pattern, trim))
    if bad == "fail":
        first = F.coalesce(F.col(f"`{schema.fields[0].name}`"), F.lit(""))
        message = F.concat(F.lit("row does not match the header, first cell: "), first)
        cells = cells.where(F.when(F.col(_CORRUPT).isNotNull(), F.raise_error(message).cast("boolean")).otherwise(True))

    def converted(field: T.StructField) -> Column:
        cell = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            return cell.alias(field.name)
        value = _typed(cell, field.dataType)
        if bad == "fail":
            kind = field.dataType.simpleString()
            message = F.concat(F.lit(f"cell of {field.name} is not {kind}: "), cell)
            value = F.when(cell.isNotNull() & value.isNull(), F.raise_error(message).cast(kind)).otherwise(value)
        return value.alias(field.name)

    return cells.select(*map(converted, schema.fields))


def bad_cells(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    *,
    encoding: str = "UTF-8",
    name_pattern: str | None = None,
) -> DataFrame:
    """``column, value, rows``: cells that do not fit their type, and whole rows (column NULL) that do not fit the header."""
    paths = [path] if isinstance(path, str) else list(path)
    cells = _as_text(spark, paths, schema, _csv_options(encoding, name_pattern))
    typed = [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]
    checks = [
        F.struct(F.lit(f.name).alias("column"), F.when(_typed(F.col(f"`{f.name}`"), f.dataType).isNull(), F.col(f"`{f.name}`")).alias("value"))
        for f in typed
    ]
    checks.append(F.struct(F.lit(None).cast("string").alias("column"), F.col(_CORRUPT).alias("value")))
    listed = cells.select(F.inline(F.array(*checks)), F.col(f"`{schema.fields[0].name}`").alias("__first"))
    return listed.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("rows"))


def land_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    out: str,
    *,
    encoding: str = "UTF-8",
    name_pattern: str | None = None,
    trim: bool = True,
) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Parse a CSV delivery once into good rows and rejects, both stored as Parquet under ``out``.

    Returns the good rows under ``schema``; the rejects as ``reasons`` (an array
    of ``column, value``, the column NULL for a row that does not fit the
    header) and ``cells``, all cells as they were; and the number of good and of
    rejected rows and, by column, of bad cells, counted while writing. One
    write makes both tables, as folders of one partitioned table.
    """
    paths = [path] if isinstance(path, str) else list(path)
    cells = _as_text(spark, paths, schema, _csv_options(encoding, name_pattern, trim))
    raw, typed = [F.col(f"`{f.name}`") for f in schema.fields], [f for f in schema.fields if not isinstance(f.dataType, T.StringType)]

    def bad(field: T.StructField) -> Column:
        return F.col(f"`{field.name}`").isNotNull() & _typed(F.col(f"`{field.name}`"), field.dataType).isNull()

    def reason(test: Column, column: Column, value: Column) -> Column:
        return F.when(test, F.struct(column.cast("string").alias("column"), value.alias("value")))

    shape = F.col(_CORRUPT).isNotNull()
    reasons = F.array_compact(
        F.array(reason(shape, F.lit(None), F.col(_CORRUPT)), *[reason(~shape & bad(f), F.lit(f.name), F.col(f"`{f.name}`")) for f in typed])
    )
    parsed = cells.select(
        reasons.alias("reasons"),
        F.struct(*[(_typed(c, f.dataType) if f in typed else c).alias(f.name) for c, f in zip(raw, schema.fields)]).alias("row"),
        F.array(*raw).alias("cells"),
    )
    wrong = F.size("reasons") > 0
    counts = [F.count_if(F.exists("reasons", _is_about(f.name))).alias(f"bad:{f.name}") for f in typed]
    seen = Observation()
    landed = parsed.observe(seen, F.count_if(~wrong).alias("good"), F.count_if(wrong).alias("rejected"), F.count_if(F.exists("reasons", _is_about(None))).alias("bad:row"), *counts)
    landed = landed.select("reasons", F.when(~wrong, F.col("row")).alias("row"), F.when(wrong, F.col("cells")).alias("cells"), wrong.cast("string").alias(_REJECTED))
    landed.write.mode("overwrite").partitionBy(_REJECTED).parquet(out)
    stored = spark.read.schema(landed.schema).parquet(out)
    # read as a table's rows, every column may be NULL
    good = stored.where(F.col(_REJECTED) == "false").select(*[F.col("row").getField(f.name).alias(f.name) for f in schema.fields])
    return good, stored.where(F.col(_REJECTED) == "true").select("reasons", "cells"), dict(seen.get)


def _is_about(name: str | None) -> Callable[[Column], Column]:
    return lambda reason: reason["column"].eqNullSafe(F.lit(name))


def read_csv_columns(
    spark: SparkSession,
    path: str | Sequence[str],
    columns: Mapping[str, T.DataType],
    *,
    encoding: str = "UTF-8",
    name_pattern: str | None = None,
    bad: str = "fail",
) -> DataFrame:
    """A few typed columns of a wide CSV, in the given order.

    Only the header line is read to place the columns; the others are never
    converted.
    """
    paths = [path] if isinstance(path, str) else list(path)
    options = _csv_options(encoding, name_pattern)
    header = spark.read.options(**options | {"multiLine": "false"}).csv(paths).columns
    absent = [name for name in columns if name not in header]
    if absent:
        raise ValueError(f"columns not in the file: {absent}")
    schema = T.StructType([T.StructField(name, columns.get(name, T.StringType())) for name in header])
    df = read_csv(spark, paths, schema, encoding=encoding, name_pattern=name_pattern, bad=bad)
    return df.select(*columns)


def read_delivery(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    fmt: str = "parquet",
    encoding: str = "UTF-8",
    bad: str = "fail",
) -> DataFrame:
    """A registry delivery, landed as Parquet or CSV, under a fixed schema."""
    if fmt == "csv":
        return read_csv(spark, path, schema, encoding=encoding, bad=bad)
    return spark.read.schema(schema).format(fmt).load(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Reload a typed intermediate table."""
    return spark.read.parquet(path)


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a typed intermediate table, replacing an earlier one.

    Partition by a column that later filters name, such as the state.
    """
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


_CURRENT = "CURRENT"


def _current(spark: SparkSession, path: str) -> str | None:
    """The name of the version that readers of ``path`` get."""
    jvm, pointer = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(path, _CURRENT)
    files = pointer.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def replace_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    """Write ``df`` as the new version of the table at ``path``; readers get it only when it is whole.

    Each version is a folder of its own. A small file names the current one and
    is put in the old one's place by one rename at the end, so a job that fails
    half-way leaves the earlier version as it is, and a job may read the table
    it replaces. The version before stays for readers that have begun; older
    ones, and what failed jobs have left, are deleted. Returns the new folder.
    One writer at a time.
    """
    spark = df.sparkSession
    before, version = _current(spark, path), f"v-{uuid.uuid4().hex}"
    folder = f"{path.rstrip('/')}/{version}"
    write_snapshot(df, folder, partition_by)
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    pointer, fresh = fs.Path(path, _CURRENT), fs.Path(path, f".{_CURRENT}-{version}")
    files = pointer.getFileSystem(conf)
    out = files.create(fresh, True)
    try:
        out.write(version.encode())
    finally:
        out.close()
    options = getattr(fs, "Options$Rename")
    overwrite = spark.sparkContext._gateway.new_array(options, 1)
    overwrite[0] = options.OVERWRITE
    fs.FileContext.getFileContext(files.getUri(), conf).rename(files.makeQualified(fresh), files.makeQualified(pointer), overwrite)
    for status in files.listStatus(fs.Path(path)):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            files.delete(status.getPath(), True)
    return folder


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table written by ``replace_snapshot``."""
    version = _current(spark, path)
    if version is None:
        raise FileNotFoundError(f"no current version in {path}")
    return spark.read.parquet(f"{path.rstrip('/')}/{version}")


def write_published_csv(
    df: DataFrame, path: str, *, encoding: str = "UTF-8", rows_per_file: int = ROWS_PER_FILE
) -> None:
    """Header CSV with NULL written as ``NA`` and quotes doubled; cells are written as they are.

    Files hold at most ``rows_per_file`` rows, so that reading them back is spread.
    """
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("encoding", encoding)
        .option("nullValue", MISSING_TEXT)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", rows_per_file)
        .csv(path)
    )


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Recode terms from CSV: ``field, raw, canonical, priority``.

    ``field`` is a clean column name, ``raw`` the spelling as it is after lower-
    casing, and the lowest ``priority`` wins where a term is listed twice. Cells
    are kept as written, blanks included.
    """
    return read_csv(spark, path, VOCABULARY, trim=False)


def read_vertices(spark: SparkSession, path: str, *, fmt: str = "parquet") -> DataFrame:
    """Polygon layer as a vertex table (see ``schemas.REGION_VERTICES``)."""
    return read_delivery(spark, path, REGION_VERTICES, fmt=fmt)
