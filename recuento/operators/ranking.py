"""Positions in a total order: quantile classes and category order."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from recuento.functions.numbers import round_even
from recuento.operators.joins import lookup_join
from recuento.session import materialize

#: A generated number is the task's number times this plus the row's place in the task.
_TASK = 1 << 33


def number_rows(df: DataFrame, order: Sequence[Column], out: str = "position") -> tuple[DataFrame, int]:
    """The table with the 1-based place of each row, and the number of rows.

    ``order`` must be total. The table is cut into ranges of the whole order,
    ties included, so equal values do not gather in one task; each range is
    sorted and numbered where it lies and stored, so that a row never changes
    its range, and is then shifted by the sizes of the ranges before it. ``df``
    is computed twice, once to find the borders of the ranges.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.repartitionByRange(slices, *order).sortWithinPartitions(*order)
    stored = materialize(sliced.withColumn("__mark", F.monotonically_increasing_id()), "ranges")
    cut = F.floor(F.col("__mark") / _TASK)
    sizes = stored.groupBy(cut.alias("__slice")).agg(F.count("*").alias("__rows"))
    earlier = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__slice", "__rows", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__offset"))
    rows = sizes.agg(F.sum("__rows").alias("n")).first()["n"] or 0
    placed = lookup_join(stored.withColumn("__slice", cut), offsets.drop("__rows"), ["__slice"])
    numbered = placed.withColumn(out, F.col("__offset") + F.col("__mark") % _TASK + 1)
    return numbered.drop("__slice", "__mark", "__offset"), rows


CANDIDATES = 1 << 14
"""Keys that reach the driver in one round of ``keys_at``, on average at most."""


def keys_at(keys: DataFrame, places: Callable[[int], Sequence[int]]) -> tuple[dict[int, Row], int]:
    """The keys at given places of the whole order, from 1, and the number of keys.

    ``places`` gets that number. Nothing is sorted or stored: of the stretches
    that hold a wanted place a sample reaches the driver (which rows it holds
    changes the pace, not the result), keys near the expected place become candidates, and one aggregate counts the keys below, at and
    between them. A place that falls on a candidate is found, the others go on
    in a shorter stretch, until what is left of the stretches fits into the
    sample. Repeated keys take as many places. Each round reads ``keys`` twice
    and shortens the stretches about a hundredfold.
    """
    names, types = keys.columns, {f.name: f.dataType for f in keys.schema}
    key = F.struct(*[F.col(f"`{name}`") for name in names])
    rows = keys.count()
    found: dict[int, Row] = {}
    # a stretch: the keys beyond both ends, how many keys lie before it and in it, and the places wanted in it
    stretches = [(None, None, 0, rows, sorted(set(places(rows))))] if rows else []
    turn = 0

    def literal_key(row: Row) -> Column:
        return F.struct(*[F.lit(row[name]).cast(types[name]).alias(name) for name in names])

    while stretches:
        inside = [(F.lit(True) if low is None else key > literal_key(low)) & (F.lit(True) if high is None else key < literal_key(high)) for low, high, *_ in stretches]
        number = F.lit(None).cast("int")
        for i, test in enumerate(inside):
            number = F.when(test, F.lit(i)).otherwise(number)
        picked = keys.withColumn("__stretch", number).where(F.col("__stretch").isNotNull())
        share = min(1.0, CANDIDATES / sum(n for *_, n, _ in stretches))
        drawn = picked
        if share < 1:
            drawn = picked.where(F.rand(turn) < share)
        listed = drawn.groupBy("__stretch", *[F.col(f"`{name}`") for name in names]).agg(F.count("*").alias("__n"))
        listed = listed.orderBy("__stretch", *[F.col(f"`{name}`") for name in names]).collect()
        samples = [[r for r in listed if r["__stretch"] == i] for i in range(len(stretches))]
        if share == 1:
            for (_, _, before, _, wanted), sample in zip(stretches, samples):
                upto, left = before, list(wanted)
                for r in sample:
                    upto += r["__n"]
                    while left and left[0] <= upto:
                        found[left.pop(0)] = r
            return found, rows
        candidates = [_near_places(sample, before, n, wanted) for (_, _, before, n, wanted), sample in zip(stretches, samples)]
        slot = F.lit(0)
        for i, rows_near in enumerate(candidates):
            passed = sum(((key >= literal_key(c)).cast("int") + (key > literal_key(c)).cast("int") for c in rows_near), F.lit(0))
            slot = F.when(F.col("__stretch") == i, passed).otherwise(slot)
        counted = {(r["__stretch"], r["slot"]): r["n"] for r in picked.groupBy("__stretch", slot.alias("slot")).agg(F.count("*").alias("n")).collect()}
        shorter = []
        for i, (low, high, before, _, wanted) in enumerate(stretches):
            ends = [low, *candidates[i], high]
            for at in range(2 * len(candidates[i]) + 1):
                n = counted.get((i, at), 0)
                here = [p for p in wanted if before < p <= before + n]
                if at % 2:
                    found |= {p: ends[at // 2 + 1] for p in here}
                elif here:
                    shorter.append((ends[at // 2], ends[at // 2 + 1], before, n, here))
                before += n
        stretches, turn = shorter, turn + 1
    return found, rows


def _near_places(sample: list[Row], before: int, n: int, wanted: Sequence[int]) -> list[Row]:
    """Different keys of an ordered sample, on both sides of where the places are expected."""
    upto = list(accumulate(r["__n"] for r in sample))
    if not upto:
        return []
    spread, at = math.sqrt(upto[-1]) / 2, set()
    for place in wanted:
        expected = (place - before) / n * upto[-1]
        at |= {min(bisect_left(upto, expected + k * spread), len(sample) - 1) for k in (-3, -1, 0, 1, 3)}
    return [sample[i] for i in sorted(at)]


def quantile_class(
    df: DataFrame,
    value: str,
    ties: Sequence[str],
    classes: int = 4,
    out: str = "class",
    range_out: str | None = None,
    digits: int = 2,
) -> DataFrame:
    """Equal-count classes 1..n of ``value``; NULL values get no class.

    Where the rows do not divide evenly the first classes are one larger.
    ``ties`` must make the order of equal values definite. ``range_out`` adds
    the text ``low-high`` of the row's class. The first and last key of each
    class are found by counting (``keys_at``), and each row finds its class by
    comparing its key with them: the table is neither sorted, shuffled nor
    stored.
    """
    key = [value, *ties]
    keys = df.where(F.col(value).isNotNull()).select(*key)

    def class_ends(rows: int) -> tuple[list[int], list[int]]:
        size, larger = divmod(rows, classes)
        filled = [size + (c < larger) for c in range(classes) if size + (c < larger)]
        ends = [sum(filled[: c + 1]) for c in range(len(filled))]
        return [end - n + 1 for end, n in zip(ends, filled)], ends

    borders, rows = keys_at(keys, lambda n: [p for side in class_ends(n) for p in side])
    starts, ends = class_ends(rows)

    place = F.struct(*[F.col(name) for name in key])
    types = {field.name: field.dataType for field in keys.schema}
    cls, label = F.lit(None).cast("int"), F.lit(None).cast("string")
    for c, (start, end) in enumerate(zip(starts, ends), 1):
        first = F.struct(*[F.lit(borders[start][name]).cast(types[name]).alias(name) for name in key])
        low, high = (round_even(F.lit(borders[at][value]), digits) for at in (start, end))
        reached = F.lit(True) if c == 1 else place >= first
        cls = F.when(reached, F.lit(c)).otherwise(cls)
        label = F.when(reached, F.format_string(f"%.{digits}f-%.{digits}f", low, high)).otherwise(label)
    known = F.col(value).isNotNull()
    added = {out: F.when(known, cls)} | ({range_out: F.when(known, label)} if range_out else {})
    return df.withColumns(added)


def order_by_value(df: DataFrame, category: str, value: str, out: str = "cat_order") -> DataFrame:
    """Add the 1-based place of each category when ordered by its mean value.

    Equal means are ordered by name.
    """
    means = df.groupBy(category).agg(F.avg(value).alias("__mean"))
    numbered, _ = number_rows(means, [F.asc("__mean"), F.asc(category)], out)
    return lookup_join(df, numbered.drop("__mean"), [category])
