"""Text helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANISH_LETTERS = "áéíóúñüÁÉÍÓÚÑÜ"


def pad_left(col: Column, width: int, fill: str = "0") -> Column:
    """Left pad that never cuts a longer text (``lpad`` alone would)."""
    text = col.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, fill)).otherwise(text)


def paste(cols: Sequence[Column], null_as: str | None = "NA") -> Column:
    """Join texts without a separator.

    A NULL part is written as ``null_as``; with ``None`` it makes the result NULL.
    """
    parts = [c.cast("string") for c in cols]
    if null_as is not None:
        parts = [F.coalesce(c, F.lit(null_as)) for c in parts]
    return F.concat(*parts)


def number_text(col: Column) -> Column:
    """A number as text without a trailing ``.0``: 12 and not 12.0."""
    return F.regexp_replace(col.cast("string"), r"\.0$", "")


def share_label(per: Column) -> Column:
    return F.concat(number_text(per), F.lit("%"))


def category_label(category: Column, per: Column, total: Column | None = None) -> Column:
    """Two-line label: category, then ``per% (total)`` or ``per%``."""
    parts = [category, F.lit("\n"), share_label(per)]
    if total is not None:
        parts += [F.lit(" ("), number_text(total), F.lit(")")]
    return F.concat(*parts)


def replace_all(col: Column, old: str, new: str) -> Column:
    return F.replace(col, F.lit(old), F.lit(new))


def mojibake_pairs(letters: str = SPANISH_LETTERS) -> tuple[str, str]:
    """(broken, proper): Latin-1 bytes of ``letters`` read as Mac Roman, and ``letters``."""
    return letters.encode("latin-1").decode("mac_roman"), letters


def repair_mojibake(col: Column, letters: str = SPANISH_LETTERS) -> Column:
    """Undo a Latin-1 text that was read as Mac Roman, for the given letters.

    A text that truly holds one of the broken signs is changed as well, so use
    it only on columns known to be broken.
    """
    broken, proper = mojibake_pairs(letters)
    return F.translate(col, broken, proper)
