"""Rounding, shares and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(col: Column, digits: int) -> Column:
    """The nearer of the two neighbours with ``digits`` decimals, ties to the even one.

    Both neighbours are compared with the value as it is stored: 0.15 lies a
    little nearer to 0.1 than to 0.2, so one decimal of it is 0.1. (``bround``
    rounds the printed value and gives 0.2.)
    """
    scale = float(10**digits)
    size = F.abs(col.cast("double"))
    below = F.floor(size * scale)
    down = below / F.lit(scale)
    up = F.ceil(size * scale) / F.lit(scale)
    to_down, to_up = size - down, up - size
    nearest = F.when((to_down < to_up) | ((to_down == to_up) & (below % 2 == 0)), down).otherwise(up)
    return F.when(col < 0, -nearest).otherwise(nearest)


def percent(part: Column, whole: Column) -> Column:
    """``part / whole * 100``; NULL when the whole is 0 or NULL."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def rate_per(count: Column, population: Column, per: int = 100_000) -> Column:
    """``count / population * per``; NULL when the population is 0 or NULL."""
    return F.try_divide(count.cast("double"), population.cast("double")) * per


def scaled_rate(count: Column, population: Column, per: int = 100_000) -> Column:
    """``count * (per / population)``, the order of operations of the map tables."""
    return count.cast("double") * F.try_divide(F.lit(float(per)), population.cast("double"))
