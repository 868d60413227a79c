"""Counts that a new cut of the same cases updates without counting anew."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIGN = "__sign"


def _keys(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("string") for c in columns]) if columns else F.array().cast("array<string>")


def count_state(df: DataFrame, groupings: Mapping[str, Sequence[str]], sign: str | None = None) -> DataFrame:
    """``grouping, keys, n``: the rows of each group of each grouping, from one scan.

    ``groupings`` names lists of columns, an empty one for all rows; ``keys``
    are the values as text, NULL a group of its own. ``sign`` is a column of
    weights, 1 for a row that comes and -1 for one that goes (``changed_rows``).
    """
    cells = [F.struct(F.lit(name).alias("grouping"), _keys(columns).alias("keys")) for name, columns in groupings.items()]
    weight = F.col(sign) if sign else F.lit(1)
    rows = df.select(weight.cast("long").alias("__weight"), F.inline(F.array(*cells)))
    return rows.groupBy("grouping", "keys").agg(F.sum("__weight").alias("n"))


def changed_rows(before: DataFrame, after: DataFrame, case: str, columns: Sequence[str]) -> DataFrame:
    """The ``columns`` of cases that a new cut adds, drops or changes, with ``__sign``.

    A dropped case is its old row with -1, an added one its new row with 1, a
    changed one both; cases whose ``columns`` are the same are left out. ``case``
    must be known and occur once in each cut. Only these columns are read, and
    the one join is on the case.
    """

    def side(df: DataFrame, key: str, row: str) -> DataFrame:
        return df.select(F.col(f"`{case}`").alias(key), F.struct(*[F.col(f"`{c}`").alias(c) for c in columns]).alias(row))

    both = side(before, "__b", "old").join(side(after, "__a", "new"), F.col("__b") == F.col("__a"), "full")
    differ = both.where(~F.col("old").eqNullSafe(F.col("new")))
    rows = F.array(
        F.when(F.col("old").isNotNull(), F.struct(F.lit(-1).alias(SIGN), F.col("old").alias("row"))),
        F.when(F.col("new").isNotNull(), F.struct(F.lit(1).alias(SIGN), F.col("new").alias("row"))),
    )
    signed = differ.select(F.inline(F.array_compact(rows)))
    return signed.select(*[F.col("row").getField(c).alias(c) for c in columns], SIGN)


def merge_counts(*states: DataFrame) -> DataFrame:
    """One state from several; groups that nothing is left of are dropped."""
    merged = states[0]
    for state in states[1:]:
        merged = merged.unionByName(state)
    return merged.groupBy("grouping", "keys").agg(F.sum("n").alias("n")).where("n <> 0")


def update_counts(state: DataFrame, before: DataFrame, after: DataFrame, case: str, groupings: Mapping[str, Sequence[str]]) -> DataFrame:
    """The stored counts of ``before`` brought to ``after``: only cases that differ are counted."""
    columns = sorted({c for names in groupings.values() for c in names})
    return merge_counts(state, count_state(changed_rows(before, after, case, columns), groupings, SIGN))
