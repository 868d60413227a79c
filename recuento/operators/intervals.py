"""Bands that are a table: labels looked up by binary search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recuento.functions.categories import Band
from recuento.operators.dictionary import small_table

MOST_BANDS = 10_000
"""Bands that a table may hold; they travel with every task as one array."""


def band_table(spark: SparkSession, bands: Sequence[Band]) -> DataFrame:
    """``label, low, high, below`` of bands written in code."""
    rows = [(b.label, *(None if x is None else float(x) for x in (b.low, b.high, b.below))) for b in bands]
    schema = "label string, low double, high double, below double"
    return small_table(spark, rows, ["label", "low", "high", "below"]) if all(any(r[i] is not None for r in rows) for i in (1, 2, 3)) else spark.createDataFrame(rows, schema)


def _bounds(bands: DataFrame) -> DataFrame:
    """``label, start, end, whole``: NULL for no bound; whole numbers only, or everything up to ``end`` itself left out."""
    return bands.select(
        "label",
        F.col("low").cast("double").alias("start"),
        F.coalesce("high", "below").cast("double").alias("end"),
        F.col("high").isNotNull().alias("whole"),
    )


def band_faults(bands: DataFrame) -> DataFrame:
    """``label, fault, from, to``: overlaps of neighbouring bands, gaps between them and bands that hold nothing.

    Whole numbers decide: 12 to 17 and 18 to 23 leave no gap.
    """
    order = Window.orderBy(F.asc_nulls_first("start"), F.asc_nulls_last("end"))
    rows = _bounds(bands).select("*", F.row_number().over(order).alias("n"), F.lag(F.struct("start", "end", "whole")).over(order).alias("b"))
    reach = F.when(F.col("b.whole"), F.col("b.end") + 1).otherwise(F.col("b.end"))
    behind = (F.col("n") > 1) & (F.col("start").isNull() | reach.isNull() | (reach > F.col("start")))
    fault = (
        F.when((F.col("end") < F.col("start")) | (~F.col("whole") & (F.col("end") <= F.col("start"))), "empty")
        .when(behind, "overlap")
        .when(reach < F.col("start"), "gap")
    )
    return rows.select("label", fault.alias("fault"), reach.alias("from"), F.col("start").alias("to")).where("fault is not null")


def band_lookup(df: DataFrame, value: str, bands: DataFrame, out: str = "band", gaps: bool = True) -> DataFrame:
    """Add the label of the band that holds ``value``; NULL where none does.

    ``bands`` has ``label, low, high, below`` as ``Band`` has them: ``low`` and
    ``high`` hold the whole numbers between, ``below`` alone everything smaller,
    ``low`` alone that value and above. The sorted borders are one array, and
    each row finds its band by binary search, so a band costs memory but hardly
    time. Overlaps and empty bands raise, gaps too unless ``gaps``.
    """
    if bands.limit(MOST_BANDS + 1).count() > MOST_BANDS:
        raise ValueError(f"more than {MOST_BANDS} bands")
    faults = [r for r in band_faults(bands).collect() if not (gaps and r["fault"] == "gap")]
    if faults:
        raise ValueError("bands do not fit: " + ", ".join(f"{r['fault']} at {r['label']}" for r in faults))
    low = F.coalesce("start", F.lit(float("-inf")))
    entry = F.struct(low.alias("low"), "end", "whole", "label")
    listed = _bounds(bands).agg(F.array_sort(F.collect_list(entry)).alias("bands")).scalar()
    rows = df.withColumns({"__bands": listed, "__value": F.col(f"`{value}`").cast("double")})
    search = """aggregate(
        sequence(0, cast(ceil(log2(size(__bands) + 1)) as int)), named_struct('lo', 0, 'hi', size(__bands)),
        (s, step) -> if(s.lo < s.hi and get(__bands, (s.lo + s.hi) div 2).low <= __value,
            named_struct('lo', cast((s.lo + s.hi) div 2 + 1 as int), 'hi', s.hi),
            named_struct('lo', s.lo, 'hi', cast(if(s.lo < s.hi, (s.lo + s.hi) div 2, s.hi) as int))),
        s -> get(__bands, s.lo - 1))"""
    rows = rows.withColumn("__band", F.expr(search))
    within = F.col("__band.end").isNull() | F.when(F.col("__band.whole"), (F.col("__value") <= F.col("__band.end")) & (F.col("__value") == F.floor("__value"))).otherwise(
        F.col("__value") < F.col("__band.end")
    )
    label = F.when(F.col("__value").isNotNull() & within, F.col("__band.label"))
    return rows.withColumn(out, label).drop("__bands", "__value", "__band")
