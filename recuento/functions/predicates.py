"""Row tests with the NULL rules of the registry analysis."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_member(col: Column, values: Iterable) -> Column:
    """Set membership that is never NULL: a NULL is simply not a member."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def in_whole_range(col: Column, low: int, high: int) -> Column:
    """Membership in the whole numbers ``low..high``; 16.5 is not a member."""
    return col.between(low, high) & (col == F.floor(col))


def equals(col: Column, value) -> Column:
    """``col = value``; as a filter it drops rows where ``col`` is NULL."""
    return col == F.lit(value)


def differs(col: Column, value) -> Column:
    """``col <> value``; as a filter it drops rows where ``col`` is NULL too."""
    return col != F.lit(value)


def matches(col: Column, pattern: str) -> Column:
    """True where the regular expression is found anywhere in the text."""
    return col.rlike(pattern)


def is_missing(col: Column) -> Column:
    return col.isNull()
