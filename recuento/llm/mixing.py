"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies, target over size.
The expected copies are summed along an order of the source's documents, one
offset per source is added, and a document is emitted once for each whole number
its stretch of the sum crosses. The order rises by size over every second document
and falls over the others, so neighbours are alike all the way round and what a
source gives stays close to its target whatever the offset.

The running sum is made in three steps, so that a source of any size is spread
over many tasks: within small groups of neighbouring documents, over the groups
of one size, and over the sizes of a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from recuento.llm.common import text_of, whole_row
from recuento.operators.ranking import number_rows
from recuento.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
SEED = "mix-1"

#: One copy in the fixed-point sums; 2 ** 38 documents of a source fit.
ONE = 1 << 24
GROUP_IDS = 256


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, limit: int = LIMIT
) -> DataFrame:
    """``source, source_size, documents, target`` from stored rows of ``source, size, n``.

    Sources in code point order, NULL last, take the weights in turn. What lies
    above ``limit`` times a source's size goes to the others by weight until no
    target is above. Each round is one aggregate row; the limit is reached by a
    set that only grows, so the rounds end.
    """
    totals = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("documents"))
    ranked, _ = number_rows(totals, [F.asc_nulls_last("source")], "__place")
    turn = (F.col("__place") - 1) % len(weights) + 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn.cast("int")).cast("long")
    ranked = materialize(ranked.select("source", "source_size", "documents", weight.alias("weight")), "sources")
    whole = ranked.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    if not whole["weight"]:
        return ranked.select("source", "source_size", "documents", F.lit(0.0).alias("target"))
    asked = whole["size"] * share
    level = asked / whole["weight"]
    while True:
        full = F.col("weight") * F.lit(level) > limit * F.col("source_size")
        now = ranked.agg(
            F.sum(F.when(full, limit * F.col("source_size")).otherwise(0)).alias("given"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight"),
        ).first()
        higher = (asked - now["given"]) / now["weight"] if now["weight"] else level
        if higher <= level:
            break
        level = higher
    full = F.col("weight") * F.lit(level) > limit * F.col("source_size")
    target = F.when(full, (limit * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", "documents", target.alias("target"))


def _copies(docs: DataFrame, doc_id: str, text: str, source: str, seed: str, keep: Column, **targets) -> DataFrame:
    """``__keep, doc_id, size, source_size, target, copies`` for each row."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        word_count(text_of(text)).alias("size"),
        keep.alias("__keep"),
    )
    numbered = isinstance(rows.schema["doc_id"].dataType, NumericType)
    rows = rows.withColumn("__group", F.floor(F.col("doc_id") / GROUP_IDS) if numbered else F.shiftrightunsigned(F.xxhash64("doc_id"), 52))
    key = ["source", "size", "__group"]
    groups = materialize(rows.groupBy(*key).agg(F.count("*").alias("n")), "sizes")
    sources = source_targets(groups, **targets)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("")))), 1, 6), 16, 10)
    sources = sources.withColumn("step", F.floor(ratio * ONE).cast("long")).withColumn("start", start.cast("long") % ONE)

    # the places before each group: running sums inside ranges of all groups, plus the ranges and less the sources before
    order = [F.asc_nulls_last("source"), F.asc("size"), F.asc_nulls_last("__group")]
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    ranges = groups.repartitionByRange(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
    ranges = materialize(ranges.withColumn("range", F.spark_partition_id()), "ranges")
    offsets = ranges.groupBy(F.col("range").alias("r")).agg(F.sum("n").alias("n"))
    offsets = offsets.select("r", F.coalesce(F.sum("n").over(before.orderBy("r")), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("n").over(before.partitionBy("range").orderBy(*order)), F.lit(0))
    places = ranges.withColumn("inside", inside).join(offsets, F.col("range") == F.col("r"))
    earlier = F.coalesce(F.sum("documents").over(before.orderBy(F.asc_nulls_last("source"))), F.lit(0))
    sources = sources.withColumn("earlier", earlier).withColumnRenamed("source", "s2")
    places = places.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("__group").alias("g"), (F.col("offset") + F.col("inside")).alias("before"))
    places = places.join(sources, F.col("s").eqNullSafe(F.col("s2"))).withColumn("before", F.col("before") - F.col("earlier")).drop("s2")

    within = F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last("doc_id")))
    placed = rows.withColumn("__within", within).join(
        places,
        F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & F.col("__group").eqNullSafe(F.col("g")),
    )
    rank = F.col("before") + F.col("__within")
    place = F.when(rank % 2 == 1, (rank + 1) / 2).otherwise(F.col("documents") + 1 - rank / 2).cast("long")
    upto = place * F.col("step") + F.col("start")
    crossed = F.floor(upto / ONE) - F.floor((upto - F.col("step")) / ONE)
    return placed.select("__keep", "doc_id", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mix_plan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **targets
) -> DataFrame:
    """``doc_id, size, source_size, target, copies, taken`` for each document.

    ``size`` is the number of words, ``target`` its source's words in the mix,
    ``copies`` how often the mix holds the document (at most the limit) and
    ``taken`` the words it takes. Reruns agree: the offset comes from ``seed``
    and the source's name. A NULL source is a source, NULL and empty texts have
    size 0 and take nothing; a NULL ``doc_id`` comes last among equal sizes. Ids
    may be numbers or texts; texts are ordered by hash.
    Repeated rows are rows of their own. Other columns are not looked at.
    """
    placed = _copies(docs, doc_id, text, source, seed, F.lit(None).cast("string"), **targets)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return placed.select("doc_id", "size", "source_size", "target", "copies", taken)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **targets) -> DataFrame:
    """The mix itself: the rows and columns of ``docs``, each row as often as ``mix_plan`` has copies of it."""
    placed = _copies(docs, doc_id, text, source, seed, whole_row(docs), **targets)
    emitted = placed.where("copies > 0").select("__keep", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy"))
    return emitted.select("__keep.*")


MIX_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS documents,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source
),
levels AS (
  SELECT 0 AS round, CAST(sum(source_size) AS DOUBLE) * 1.5 / CAST(sum(weight) AS DOUBLE) AS level,
         CAST(sum(source_size) AS DOUBLE) * 1.5 AS asked
  FROM sources
  UNION ALL
  SELECT l.round + 1,
         (l.asked - CAST(sum(CASE WHEN s.weight * l.level > 2 * s.source_size THEN 2 * s.source_size ELSE 0 END) AS DOUBLE))
         / CAST(sum(CASE WHEN s.weight * l.level > 2 * s.source_size THEN 0 ELSE s.weight END) AS DOUBLE),
         l.asked
  FROM levels l, sources s WHERE l.round < 30 GROUP BY l.round, l.level, l.asked
),
targets AS (
  SELECT source, source_size, documents,
         CASE WHEN weight * level > 2 * source_size THEN CAST(2 * source_size AS DOUBLE) ELSE weight * level END AS target
  FROM sources, (SELECT max(level) AS level FROM levels)
),
ranked AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS rank FROM sized
),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN rank % 2 = 1 THEN (rank + 1) // 2 ELSE t.documents + 1 - rank // 2 END AS place,
         CAST(floor(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END * {ONE}) AS BIGINT) AS step,
         CAST('0x' || substr(md5('{SEED}:' || coalesce(d.source, '')), 1, 6) AS BIGINT) AS start
  FROM ranked d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (place * step + start) // {ONE} - ((place - 1) * step + start) // {ONE} AS copies,
       ((place * step + start) // {ONE} - ((place - 1) * step + start) // {ONE}) * size AS taken
FROM placed
"""
