"""Tolerant dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names that are read, English and Spanish, whole or by their first three letters.
MONTHS = (
    ("january", "enero"),
    ("february", "febrero"),
    ("march", "marzo"),
    ("april", "abril"),
    ("may", "mayo"),
    ("june", "junio"),
    ("july", "julio"),
    ("august", "agosto"),
    ("september", "septiembre"),
    ("october", "octubre"),
    ("november", "noviembre"),
    ("december", "diciembre"),
)

_GAP = r"[^\p{L}\d]"
_PART = rf"(\d{{2}}|\d(?={_GAP}))"
_DATE = rf"^\s*+{_PART}{_GAP}*+{_PART}{_GAP}*+(\d{{4}}|\d{{2}})\s*+$"
_NAMED = rf"^\s*+(\d{{1,2}}){_GAP}*+(\p{{L}}++){_GAP}*+(\d{{4}}|\d{{2}})\s*+$"


def _month_numbers() -> dict[str, str]:
    names = {}
    for number, spellings in enumerate(MONTHS, 1):
        for name in spellings:
            names |= {name: f"{number:02d}", name[:3]: f"{number:02d}"}
    return names


def parse_dmy(col: Column) -> Column:
    """Day-month-year text to a date; anything else, 31 February too, is NULL.

    Parts are separated by any characters but letters and digits, or not at all
    when day and month have two digits; the month may be a name of ``MONTHS``.
    Two-digit years from 69 on lie in the 1900s, smaller ones in the 2000s.
    Numbers between single slashes, dashes or dots are cut and cast; only other
    texts go through the patterns, which take some ten times as long.
    """
    return F.coalesce(_plain(col), _by_pattern(col))


def _plain(col: Column) -> Column:
    """``3/1/2020`` or ``3/1/20`` as a date; NULL for every other shape and for impossible dates."""
    parts = F.translate(col, "-.", "//")
    day, month, year = (F.split_part(parts, F.lit("/"), F.lit(n)) for n in (1, 2, 3))
    short = F.length(day).between(1, 2) & F.length(month).between(1, 2) & F.length(year).isin(2, 4)
    fits = short & (F.length(col) == F.length(day) + F.length(month) + F.length(year) + 2)
    century = F.when(F.length(year) == 4, "").when(year >= "69", "19").otherwise("20")
    return F.when(fits, F.concat(century, year, F.lit("-"), month, F.lit("-"), day).try_cast("date"))


def _by_pattern(col: Column) -> Column:
    """Dates of every shape.

    One match turns the text into ``=year-month-day``, the sign tells that it
    fitted, and the rest is cast once: the format parsers raise an error inside
    for each text that does not fit, which is slow when many do not.
    """
    names = F.create_map(*[F.lit(x) for pair in _month_numbers().items() for x in pair])
    month = names[F.lower(F.regexp_extract(col, _NAMED, 2))]
    named = F.regexp_replace(col, F.lit(_NAMED), F.concat(F.lit("=$3-"), month, F.lit("-$1")))
    found = F.when(col.rlike(r"\p{L}"), named).otherwise(F.regexp_replace(col, _DATE, "=$3-$2-$1"))
    return _iso(found).try_cast("date")


def _iso(found: Column) -> Column:
    """``=2020-1-3`` or ``=20-1-3`` as ``2020-1-3``; NULL for a text without the sign."""
    short = F.substring(found, 4, 1) == "-"
    century = F.when(~short, "").when(F.substring(found, 2, 2) >= "69", "19").otherwise("20")
    return F.when(F.left(found, F.lit(1)) == "=", F.concat(century, F.substring(found, 2, 20)))


def year_of(col: Column) -> Column:
    return F.year(col)


def days_between(first: Column, second: Column) -> Column:
    """Signed whole days ``first - second``."""
    return F.datediff(first, second)
