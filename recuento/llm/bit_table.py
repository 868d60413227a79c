"""A quick test for membership in a set of hashes, of fixed size whatever the set's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 16
"""64-bit words of the table, a power of two: half a megabyte, sent to every task."""


def _slots(x: Column, size: int, bits: int) -> list[Column]:
    """The places of ``x`` in the table: its lowest digits, and those of a hash of it."""
    return [y.bitwiseAND(F.lit(size * 64 - 1)) for y in (x, F.xxhash64(x))[:bits]]


def bit_table(ids: DataFrame, name: str, size: int = WORDS, bits: int = 1) -> Column:
    """The numbers in column ``name`` as one or two ``bits`` each: an array that is computed once and sent to every task."""
    slots = _slots(F.col(name), size, bits)
    ids = ids.select(slots[0].alias("slot") if bits == 1 else F.explode(F.array(*slots)).alias("slot"))
    words = ids.select(F.shiftrightunsigned("slot", 6).alias("word"), (F.col("slot") % 64).cast("int").alias("bit"))
    words = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    dense = ids.sparkSession.range(size).join(words, F.col("id") == F.col("word"), "left")
    dense = dense.select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    return dense.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias("words")).scalar()


def has_bit(table: Column, x: Column, size: int = WORDS, bits: int = 1) -> Column:
    """Whether ``table``, made by ``bit_table`` with the same size and bits, has those of ``x``."""
    found = [F.getbit(F.get(table, F.shiftrightunsigned(at, 6).cast("int")), (at % 64).cast("int")) == 1 for at in _slots(x, size, bits)]
    return found[0] if bits == 1 else found[0] & found[1]


def maybe_in(ids: DataFrame, name: str, size: int = WORDS, bits: int = 1) -> Callable[[Column], Column]:
    """A test that holds for every number in column ``name`` and, while the set is small, seldom for others.

    It only thins out rows before a join that decides; a set too large for the
    table thins out less.
    """
    table = bit_table(ids, name, size, bits)
    return lambda x: has_bit(table, x, size, bits)
