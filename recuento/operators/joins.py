"""Left lookups.

No side is hinted for broadcast. Spark broadcasts a side whose file size, or
whose measured shuffle size under adaptive execution, is below
``spark.sql.autoBroadcastJoinThreshold``; beyond it the join shuffles and
adaptive execution splits the partitions of hot keys.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | Mapping[str, str],
    *,
    na_matches: str = "na",
) -> DataFrame:
    """Left equi-join that adds the other columns of ``right``.

    ``on`` lists shared key names or maps left names to right names. With
    ``na_matches="na"`` a NULL key matches a NULL key, with ``"never"`` it
    matches nothing. ``right`` should hold one row per key, see
    ``assert_unique``; otherwise rows fan out as in any join.
    """
    if na_matches not in ("na", "never"):
        raise ValueError("na_matches is 'na' or 'never'")
    pairs = dict(on) if isinstance(on, Mapping) else {name: name for name in on}
    added = [name for name in right.columns if name not in pairs.values()]
    clashes = [name for name in added if name in left.columns]
    if clashes:
        raise ValueError(f"columns on both sides that are not keys: {clashes}")

    keyed = right.select(
        *[F.col(f"`{r}`").alias(f"__key_{i}") for i, r in enumerate(pairs.values())],
        *[F.col(f"`{name}`") for name in added],
    )
    condition = None
    for i, name in enumerate(pairs):
        ours, theirs = F.col(f"`{name}`"), F.col(f"__key_{i}")
        same = ours.eqNullSafe(theirs) if na_matches == "na" else ours == theirs
        condition = same if condition is None else condition & same
    return left.join(keyed, condition, "left").drop(*[f"__key_{i}" for i in range(len(pairs))])


def natural_left_join(left: DataFrame, right: DataFrame, *, na_matches: str = "na") -> DataFrame:
    """Left join on every column name the two tables share."""
    shared = [name for name in left.columns if name in right.columns]
    if not shared:
        raise ValueError("the tables share no column")
    return lookup_join(left, right, shared, na_matches=na_matches)


def assert_unique(df: DataFrame, keys: Sequence[str], name: str = "lookup") -> DataFrame:
    """Fail when a key occurs twice; at most one offending key reaches the driver."""
    twice = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > 1).drop("__n").head(1)
    if twice:
        raise ValueError(f"{name} has several rows for {twice[0].asDict()}")
    return df


INSENSITIVE = "UNICODE_CI_AI"
"""A collation under which case and accents do not count."""


def ambiguous_keys(lookup: DataFrame, keys: Sequence[str], collation: str = INSENSITIVE) -> DataFrame:
    """``keys, spellings``: keys of a lookup that several of its rows share under ``collation``, with all their spellings."""
    spelled = F.struct(*[F.col(f"`{k}`").alias(k) for k in keys])
    grouped = lookup.groupBy(*[F.collate(F.col(f"`{k}`"), collation).alias(k) for k in keys])
    found = grouped.agg(F.count("*").alias("__n"), F.array_sort(F.collect_set(spelled)).alias("spellings")).where("__n > 1")
    # which spelling a group is named by must not depend on the order of rows
    return found.select(*[F.get("spellings", F.lit(0)).getField(k).alias(k) for k in keys], "spellings")


def insensitive_lookup_join(
    left: DataFrame, right: DataFrame, on: Sequence[str] | Mapping[str, str], *, collation: str = INSENSITIVE, found: str | None = None
) -> DataFrame:
    """Left lookup by keys that may differ in case and accents.

    A row with the same spelling wins (NULL matches NULL). Else the row that is
    equal under ``collation`` is taken, if ``right`` has one alone; keys that
    several of its rows share (``ambiguous_keys``) match by spelling only, so
    that a wrong row is never picked. ``right`` should hold one row per
    spelling. ``found`` names a column for how the row was found: ``spelling``,
    ``collation`` or NULL. Both are plain equi-joins.
    """
    pairs = dict(on) if isinstance(on, Mapping) else {name: name for name in on}
    keys = list(pairs.values())
    added = [name for name in right.columns if name not in keys]
    row = F.struct(F.lit(True).alias("__found"), *[F.col(f"`{name}`").alias(name) for name in added])
    exact = right.select(*[F.col(f"`{k}`") for k in keys], row.alias("__exact"))
    joined = lookup_join(left, exact, pairs)
    grouped = right.select(*[F.collate(F.col(f"`{k}`"), collation).alias(f"__near_{i}") for i, k in enumerate(keys)], row.alias("__near"))
    alone = grouped.groupBy(*[f"__near_{i}" for i in range(len(keys))]).agg(F.count("*").alias("__n"), F.any_value("__near").alias("__near"))
    alone = alone.where("__n = 1").drop("__n")
    condition = F.lit(True)
    for i, ours in enumerate(pairs):
        condition = condition & (F.collate(F.col(f"`{ours}`"), collation) == F.col(f"__near_{i}"))
    joined = joined.join(alone, condition, "left")
    by_spelling = F.col("__exact").isNotNull()
    picked = [F.when(by_spelling, F.col("__exact").getField(n)).otherwise(F.col("__near").getField(n)).alias(n) for n in added]
    how = F.when(by_spelling, "spelling").when(F.col("__near").isNotNull(), "collation")
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], *picked, *([how.alias(found)] if found else []))
