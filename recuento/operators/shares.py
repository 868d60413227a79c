"""Scope totals, shares and top shares, computed on the aggregated counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recuento.functions.numbers import percent, round_even
from recuento.operators.counting import group_count, sum_or_zero
from recuento.operators.joins import lookup_join
from recuento.operators.reshape import drop_null_rows


def add_scope_total(
    counts: DataFrame, scope: Sequence[str], total: str = "total", out: str = "den"
) -> DataFrame:
    """The sum of ``total`` over the rows of the same scope, on each row.

    The totals are a second, smaller aggregate that is joined back (no scope: a
    scalar subquery). A window would gather every row of one scope in one task.
    Both branches read the same shuffle of ``counts``, so its input is scanned
    once.
    """
    if not scope:
        return counts.withColumn(out, counts.agg(sum_or_zero(F.col(total))).scalar())
    totals = counts.groupBy(*scope).agg(sum_or_zero(F.col(total)).alias(out))
    return lookup_join(counts, totals, list(scope))


def add_share(
    counts: DataFrame,
    scope: Sequence[str],
    *,
    nulls: str,
    digits: int | None,
    total: str = "total",
    den: str = "den",
    per: str = "per",
) -> DataFrame:
    """Percentage of the scope total.

    ``nulls`` says when rows with a NULL are dropped: ``"before"`` the scope
    total, ``"after"`` it (they count in the denominator), or ``"keep"``.
    """
    if nulls not in ("before", "after", "keep"):
        raise ValueError("nulls is 'before', 'after' or 'keep'")
    if nulls == "before":
        counts = drop_null_rows(counts)
    shares = add_scope_total(counts, scope, total, den)
    exact = percent(F.col(total), F.col(den))
    if digits is None:
        shares = shares.withColumn(per, exact)
    else:
        shares = shares.withColumn(per, exact).withColumn(per, round_even(F.col(per), digits))
    return drop_null_rows(shares) if nulls == "after" else shares


def share_table(
    df: DataFrame,
    keys: Sequence[str],
    scope: Sequence[str] | None = None,
    *,
    nulls: str = "after",
    digits: int | None = 1,
) -> DataFrame:
    """Counts by ``keys`` and their share of ``scope``.

    The default scope is all keys but the last.
    """
    scope = list(keys[:-1]) if scope is None else list(scope)
    return add_share(group_count(df, keys), scope, nulls=nulls, digits=digits)


def sum_of_shares(
    shares: DataFrame, category: str, wanted: Sequence[str], by: Sequence[str] = (), out: str = "per_sum"
) -> DataFrame:
    """Sum of the rounded shares of some categories, per group of ``by``.

    The categories are picked inside the sum. A filter on them would be pushed
    below the counts of one branch of the share, and the cases scanned twice.
    """
    picked = F.when(F.col(category).isin(list(wanted)), F.col("per").cast("decimal(18,2)"))
    sums = shares.groupBy(*by).agg(F.sum(picked).cast("double").alias(out))
    return sums.where(F.col(out).isNotNull())


def top_with_ties(df: DataFrame, value: str, k: int) -> DataFrame:
    """Rows whose value is among the ``k`` largest, ties included.

    A row belongs to them exactly when it reaches the k-th largest value, which
    each task finds from its own ``k`` best; no task ranks the whole table.
    """
    known = df.where(F.col(value).isNotNull())
    kth = known.select(value).orderBy(F.desc(value)).limit(k).agg(F.min(value)).scalar()
    return known.where(F.col(value) >= kth)


def top_share(counts: DataFrame, value: str, k: int, *, digits: int | None = 1, out: str = "pct") -> DataFrame:
    """Share of the ``k`` largest groups (ties included) in the total, one row."""
    known = drop_null_rows(counts)
    everything = known.agg(sum_or_zero(F.col(value))).scalar()
    top = top_with_ties(known, value, k).agg(F.sum(value).alias(value))
    exact = top.withColumn("tot_denom", everything).withColumn(out, percent(F.col(value), F.col("tot_denom")))
    return exact if digits is None else exact.withColumn(out, round_even(F.col(out), digits))
