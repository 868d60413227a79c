"""Small pieces that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that the byte-level splitting rule counts as white space.
SPACES = "\\t\\n\\x0b\\f\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: A run of other characters with one space before it, or a run of white space.
#: The same text for Java's and Python's regular expressions.
CHUNKS = f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


def text_of(name: str) -> Column:
    """The text column as a string, NULL as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, whatever their names."""
    return F.struct(*[F.col("`" + name.replace("`", "``") + "`").alias(name) for name in df.columns])


def quoted(literal: str) -> str:
    """``literal`` as a pattern that matches just it, in Java and in Python."""
    return "".join(c if c.isalnum() else "\\" + c for c in literal)


#: The table of 256 remainders as one row ``crc_table.r``, and crc32 of the ASCII text ``{x}`` with it.
CRC_TABLE_SQL = """crc_steps(k, r, step) AS (
  SELECT CAST(k AS BIGINT), CAST(k AS BIGINT), 0 FROM range(256) AS t(k)
  UNION ALL
  SELECT k, CASE WHEN r & 1 = 1 THEN xor(r >> 1, CAST(3988292384 AS BIGINT)) ELSE r >> 1 END, step + 1 FROM crc_steps WHERE step < 8
),
crc_table AS (SELECT list(r ORDER BY k) AS r FROM crc_steps WHERE step = 8)"""

CRC32_SQL = """xor(list_reduce(
  list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({x}) + 1), lambda i: CAST(ascii(substr({x}, CAST(i AS INTEGER), 1)) AS BIGINT))),
  lambda crc, byte: xor(crc >> 8, crc_table.r[CAST(xor(crc, byte) & 255 AS INTEGER) + 1])), CAST(4294967295 AS BIGINT))"""
