"""Recoding by lookup tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recuento.functions.categories import KEEP
from recuento.operators.joins import lookup_join


def small_table(spark: SparkSession, rows: Sequence[Sequence], names: Sequence[str]) -> DataFrame:
    """A fixed table from the code; Spark knows its size, so joins broadcast it."""
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return spark.createDataFrame(pa.table({n: list(c) for n, c in zip(names, columns)}))


def one_row_per_term(vocabulary: DataFrame, field: str, raw: str = "raw", canonical: str = "canonical") -> DataFrame:
    """The terms of one field, the lowest priority winning where a term repeats.

    Grouping by the term alone lets Spark see that it is unique, so a lookup
    whose result nobody reads is dropped from the plan. The few terms of a field
    are grouped in one task, without a shuffle.
    """
    best = F.min(F.struct("priority", "canonical"))["canonical"]
    terms = vocabulary.where(F.col("field") == field).coalesce(1)
    return terms.groupBy(F.col("raw").alias(raw)).agg(best.alias(canonical))


def recode_dictionary(
    df: DataFrame,
    vocabulary: DataFrame,
    fields: Mapping[str, object] | Sequence[str],
) -> DataFrame:
    """Replace raw spellings by categories, field by field.

    ``vocabulary`` has ``(field, raw, canonical, priority)``. ``fields`` maps a
    column to its default: ``KEEP`` leaves unmatched values, ``None`` makes
    them NULL, a text replaces them. A NULL value never matches a term.
    """
    wanted = dict(fields) if isinstance(fields, Mapping) else {name: KEEP for name in fields}
    recoded = {}
    for i, (name, default) in enumerate(wanted.items()):
        value, raw, canonical = F.col(f"`{name}`"), f"__raw_{i}", f"__canonical_{i}"
        df = df.join(one_row_per_term(vocabulary, name, raw, canonical), value == F.col(raw), "left")
        if default is None:
            recoded[name] = F.col(canonical)
        else:
            recoded[name] = F.coalesce(canonical, value if default is KEEP else F.lit(default))
    helpers = [f"__{kind}_{i}" for i in range(len(wanted)) for kind in ("raw", "canonical")]
    return df.withColumns(recoded).drop(*helpers)


MOST_TERMS = 10_000
"""Terms that ``recode_terms`` takes; they travel with every task."""


def recode_terms(
    df: DataFrame,
    vocabulary: DataFrame,
    fields: Mapping[str, object] | Sequence[str],
) -> DataFrame:
    """``recode_dictionary`` for vocabularies of at most ``MOST_TERMS`` terms in all.

    The terms of all fields are one row of maps, found in one small job, and a
    recode is an expression on the row: however many fields there are, the
    table meets no join. A larger vocabulary fails the job. Fields that nobody
    reads cost nothing.
    """
    wanted = dict(fields) if isinstance(fields, Mapping) else {name: KEEP for name in fields}
    if not wanted:
        return df
    listed = vocabulary.where(F.col("field").isin(list(wanted)) & F.col("raw").isNotNull()).coalesce(1)
    best = listed.groupBy("field", "raw").agg(F.min(F.struct("priority", "canonical"))["canonical"].alias("canonical"))

    def terms_of(name: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col("field") == name, F.struct("raw", "canonical"))))

    few = F.assert_true(F.count("*") <= MOST_TERMS, F.lit(f"more than {MOST_TERMS} terms: use recode_dictionary"))
    maps = best.agg(*[terms_of(name).alias(f"terms_{i}") for i, name in enumerate(wanted)], few.alias("few"))
    names = [f"terms_{i}" for i in range(len(wanted))]
    df = df.withColumn("__terms", maps.select(F.struct(*[F.when(F.col("few").isNull(), F.col(n)).alias(n) for n in names])).scalar())
    recoded = {}
    for i, (name, default) in enumerate(wanted.items()):
        value = F.col(f"`{name}`")
        canonical = F.try_element_at(F.col(f"__terms.terms_{i}"), value)
        if default is None:
            recoded[name] = canonical
        else:
            recoded[name] = F.coalesce(canonical, value if default is KEEP else F.lit(default))
    return df.withColumns(recoded).drop("__terms")


def lookup_code(df: DataFrame, name: str, codes: Mapping[str, str], out: str) -> DataFrame:
    """Add the code of a label from a fixed map; an unlisted label gets NULL."""
    table = small_table(df.sparkSession, list(codes.items()), ["__label", out])
    return lookup_join(df, table, {name: "__label"}, na_matches="never")
