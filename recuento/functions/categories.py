"""Recoding, banding and ordered categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from recuento.functions.predicates import in_whole_range

KEEP = object()
"""Default for a recode: values that no arm names stay as they are."""


@dataclass(frozen=True)
class Band:
    """A labelled range.

    ``low`` and ``high``: the whole numbers from ``low`` to ``high``.
    ``below`` alone: everything smaller. ``low`` alone: that value and above.
    """

    label: str
    low: int | None = None
    high: int | None = None
    below: int | None = None

    def holds(self, col: Column) -> Column:
        if self.below is not None:
            return col < self.below
        if self.high is None:
            return col >= self.low
        return in_whole_range(col, self.low, self.high)


def first_match(arms: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """Value of the first arm whose test holds; ``default`` may be a Column."""
    if not arms:
        return default if isinstance(default, Column) else F.lit(default)
    chosen = None
    for test, value in arms:
        result = value if isinstance(value, Column) else F.lit(value)
        chosen = F.when(test, result) if chosen is None else chosen.when(test, result)
    if default is None:
        return chosen
    return chosen.otherwise(default if isinstance(default, Column) else F.lit(default))


def recode(
    col: Column,
    groups: Mapping[str, Sequence],
    default: object = KEEP,
    missing: object = None,
) -> Column:
    """Map each list of raw values to its category, first list that names it wins.

    ``default`` is ``KEEP``, ``None`` (no match gives NULL) or a literal.
    ``missing`` is the category of a NULL input; without it a NULL takes the
    default, as a value that no list names.
    """
    arms: list[tuple[Column, object]] = [(col.isin(list(raw)), name) for name, raw in groups.items()]
    if missing is not None:
        arms.append((col.isNull(), missing))
    return first_match(arms, col if default is KEEP else default)


def replace_values(col: Column, pairs: Sequence[tuple[object, object]]) -> Column:
    """One-value replacements applied in order; NULL stays NULL.

    A later pair sees the result of an earlier one, so each starting value is
    followed through the list here and one constant map holds the results. The
    map keeps the generated code short, whatever the number of pairs.
    """
    final: dict[object, object] = {}
    for start, _ in pairs:
        value = start
        for old, new in pairs:
            if value == old:
                value = new
        final.setdefault(start, value)
    table = F.create_map(*[F.lit(item) for pair in final.items() for item in pair])
    return F.coalesce(F.try_element_at(table, col), col)


def band(col: Column, bands: Sequence[Band]) -> Column:
    """Label of the band that holds the value; NULL where no band does."""
    return first_match([(b.holds(col), b.label) for b in bands])


def restrict_levels(col: Column, levels: Sequence[str]) -> Column:
    """Keep the listed levels; any other value becomes NULL."""
    return F.when(col.isin(list(levels)), col)


def level_position(col: Column, levels: Sequence[str]) -> Column:
    """1-based place in the level list; NULL for a value outside of it."""
    listed = F.array(*[F.lit(level) for level in levels])
    return F.nullif(F.array_position(listed, col), F.lit(0)).cast("int")


def year_bucket(year: Column, first: int, last: int, label: str, single_years: Sequence[int]) -> Column:
    """One bucket for ``first..last``, the listed single years as text, else NULL."""
    return first_match(
        [
            (year.between(first, last), label),
            (year.isin(list(single_years)), year.cast("string")),
        ]
    )


def fill_missing(col: Column, value) -> Column:
    return F.coalesce(col, F.lit(value))
