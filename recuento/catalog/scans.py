"""Round trips through the file formats, each on a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recuento.catalog import standins
from recuento.catalog.base import Query, table
from recuento.session import fresh_path
from recuento.sources import files
from recuento.sources.schemas import REGION_VERTICES

def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a zero-padded text code and a column with NULLs."""
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0").alias("code"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"),
        "o_totalprice",
        F.col("o_orderdate").cast("date").alias("o_orderdate"),
    )


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish as CSV (NULL as ``NA``), read back under the schema."""
    orders = _orders(spark, sf_dir)
    path = fresh_path(spark, "csv")
    files.write_published_csv(orders, path)
    return files.read_csv(spark, path, orders.schema)


def scan_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latin-1 CSV of whole accented texts, three of its columns read back."""
    documents = table(spark, sf_dir, "documents")
    path = fresh_path(spark, "latin1")
    files.write_published_csv(documents, path, encoding="ISO-8859-1")
    wanted = {name: documents.schema[name].dataType for name in ("text", "doc_id", "n_chars")}
    return files.read_csv_columns(spark, path, wanted, encoding="ISO-8859-1")


_HARD = "' 1, \"' || text || '\"' || chr(13) || chr(10) || lang || ' '"


def scan_csv_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with line breaks, commas, quotes and outer blanks, published and read back."""
    documents = table(spark, sf_dir, "documents").select("doc_id", F.expr(_HARD).alias("hard"), "source")
    path = fresh_path(spark, "texts")
    files.write_published_csv(documents, path)
    return files.read_csv(spark, path, documents.schema, trim=False)


_TERM = (
    "CASE p_partkey % 4 WHEN 0 THEN p_name || chr(13) || chr(10) WHEN 1 THEN p_name || ', \"or\" ' || p_brand "
    "WHEN 2 THEN '  ' || p_name || ' ' ELSE p_name END"
)


def read_vocabulary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary whose terms end in line breaks, hold quotes or keep outer blanks."""
    terms = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("field"), F.expr(_TERM).alias("raw"), F.col("p_type").alias("canonical"), F.col("p_size").alias("priority")
    )
    path = fresh_path(spark, "vocabulary")
    files.write_published_csv(terms, path)
    return files.read_vocabulary(spark, path)


def scan_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygon layer, stored and read back as a vertex table."""
    types = {f.name: f.dataType for f in REGION_VERTICES.fields}
    vertices = standins.region_vertices(spark, sf_dir).select(*[F.col(name).cast(kind) for name, kind in types.items()])
    path = fresh_path(spark, "vertices")
    files.write_snapshot(vertices, path)
    return files.read_vertices(spark, path)


def scan_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of files in one folder; the name pattern picks the persons."""
    persons = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    homes = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    path = fresh_path(spark, "mixed")
    homes.write.mode("append").parquet(path)
    persons.write.mode("append").option("header", True).csv(path)
    return files.read_csv(spark, path, persons.schema, name_pattern="*.csv")


def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed snapshot, written twice (the second replaces the first) and reloaded."""
    orders = _orders(spark, sf_dir)
    path = fresh_path(spark, "snapshot")
    files.write_snapshot(orders.select("o_orderkey"), path)
    files.write_snapshot(orders, path)
    return files.read_snapshot(spark, path)


_ORDERS_SQL = """
SELECT o_orderkey, lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') AS code,
       nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority,
       o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate
FROM orders
"""

_CELLS = (
    "CASE WHEN o_orderkey % 7 = 0 THEN 'n/a ' || o_orderstatus ELSE CAST(o_custkey AS STRING) || '.0' END AS customer",
    "CASE WHEN o_orderkey % 11 = 0 THEN '2021-02-30' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS day",
)


def landed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as a delivery in which some cells do not fit their type: good rows, and rejects with their first reason."""
    path, out = fresh_path(spark, "delivery"), fresh_path(spark, "landed")
    orders = table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS STRING) AS code", *_CELLS, "o_orderpriority AS priority")
    files.write_published_csv(orders, path)
    schema = spark.createDataFrame([], "code string, customer bigint, day date, priority string").schema
    good, rejected, _ = files.land_csv(spark, path, schema, out)
    nothing = F.lit(None).cast("string")
    good = good.select(*good.columns, nothing.alias("bad_column"), nothing.alias("bad_value"), F.lit(0).alias("n_bad"))
    first = F.get("reasons", F.lit(0))
    rejected = rejected.select(
        F.get("cells", F.lit(0)).alias("code"), F.lit(None).cast("bigint").alias("customer"), F.lit(None).cast("date").alias("day"),
        F.get("cells", F.lit(3)).alias("priority"), first["column"].alias("bad_column"), first["value"].alias("bad_value"), F.size("reasons").alias("n_bad"),
    )
    return good.unionByName(rejected)


_LANDED_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS code, CASE WHEN n_bad = 0 THEN o_custkey END AS customer,
       CASE WHEN n_bad = 0 THEN CAST(o_orderdate AS DATE) END AS day, o_orderpriority AS priority,
       CASE WHEN a THEN 'customer' WHEN b THEN 'day' END AS bad_column,
       CASE WHEN a THEN 'n/a ' || o_orderstatus WHEN b THEN '2021-02-30' END AS bad_value, n_bad
FROM (SELECT *, o_orderkey % 7 = 0 AS a, o_orderkey % 11 = 0 AS b,
             CAST(o_orderkey % 7 = 0 AS INTEGER) + CAST(o_orderkey % 11 = 0 AS INTEGER) AS n_bad FROM orders)
"""


def replaced_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table replaced by totals of itself, read as the current version."""
    path = fresh_path(spark, "current")
    files.replace_snapshot(_orders(spark, sf_dir), path, ["o_orderpriority"])
    totals = files.read_current(spark, path).groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.min("o_orderdate").alias("first"))
    files.replace_snapshot(totals, path)
    return files.read_current(spark, path)


QUERIES = [
    Query("scan_csv", scan_csv, _ORDERS_SQL),
    Query(
        "scan_latin1",
        scan_latin1,
        "SELECT nullif(text, '') AS text, doc_id, n_chars FROM documents",
    ),
    Query("scan_csv_text", scan_csv_text, f"SELECT doc_id, {_HARD} AS hard, source FROM documents"),
    Query(
        "read_vocabulary_csv",
        read_vocabulary_csv,
        f"SELECT p_brand AS field, {_TERM} AS raw, p_type AS canonical, p_size AS priority FROM part",
    ),
    Query(
        "scan_vertices",
        scan_vertices,
        "SELECT CVEGEO, CVE_MUN, 0 AS ring_id, CAST(pos AS INTEGER) AS pos, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y "
        f"FROM ({standins.VERTICES_SQL})",
    ),
    Query("scan_glob", scan_glob, "SELECT c_custkey, c_name FROM customer"),
    Query("snapshot_roundtrip", snapshot_roundtrip, _ORDERS_SQL),
    Query("landed_csv", landed_csv, _LANDED_SQL),
    Query(
        "replaced_snapshot",
        replaced_snapshot,
        f"SELECT o_orderpriority, count(*) AS orders, min(o_orderdate) AS first FROM ({_ORDERS_SQL}) GROUP BY o_orderpriority",
    ),
]
