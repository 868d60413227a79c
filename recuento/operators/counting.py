"""Grouped counts and sums. Partial sums are combined before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_count(df: DataFrame, keys: Sequence[str], out: str = "total") -> DataFrame:
    """Rows per key; NULL is a group."""
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def sum_or_zero(col: Column) -> Column:
    """Sum without the NULLs; a group of NULLs only gives 0."""
    return F.coalesce(F.sum(col), F.lit(0))


def sum_strict(col: Column) -> Column:
    """Sum that a single NULL makes NULL."""
    return F.when(F.count(col) == F.count("*"), F.sum(col))


def mean_known(col: Column) -> Column:
    """Mean of the known values; NULL when there are none."""
    return F.avg(col)


def distinct_count(df: DataFrame, name: str, out: str = "n") -> DataFrame:
    """Number of distinct values, with NULL as one of them."""
    has_null = F.max(F.when(F.col(name).isNull(), 1).otherwise(0))
    return df.agg((F.count_distinct(name) + F.coalesce(has_null, F.lit(0))).alias(out))


def weighted_sum(df: DataFrame, keys: Sequence[str], weight: str, out: str = "total") -> DataFrame:
    """Expanded population per key: the sum of the weights, 0 if all are NULL."""
    return df.groupBy(*keys).agg(sum_or_zero(F.col(weight)).alias(out))


def regroup_sum(counts: DataFrame, keys: Sequence[str], total: str = "total") -> DataFrame:
    """Counts of a coarser grouping, from the counts of a finer one."""
    return counts.groupBy(*keys).agg(sum_or_zero(F.col(total)).alias(total))
