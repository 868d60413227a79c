"""Row completeness, wide to long, sorting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Drop every row with a NULL in any column."""
    return df.na.drop("any")


def wide_to_long(df: DataFrame, ids: Sequence[str], names_to: str, values_to: str) -> DataFrame:
    """Every column outside ``ids`` becomes a row ``(name, value)``."""
    values = [name for name in df.columns if name not in ids]
    return df.unpivot(list(ids), values, names_to, values_to)


def sort_descending(df: DataFrame, by: str, ties: Sequence[str] = ()) -> DataFrame:
    """Largest first, NULL last; ``ties`` makes the order of equal rows definite."""
    return df.orderBy(F.desc_nulls_last(by), *[F.asc_nulls_last(name) for name in ties])
