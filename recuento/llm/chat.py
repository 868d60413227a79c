"""Chat formatting of logged conversations, snapshots collapsed.

A log holds a conversation again and again as it grows. Each turn gets a hash of
everything up to it, made by combining the hashes of place, role and text. A
conversation whose last hash is another's hash before its end is a snapshot of
that one; an anti-join leaves the longest, equal ones once, and these are
rendered. Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What stands before the role, after it and after the text of a turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv, role, text, place, turns, p, q``: turns in order with the two halves of their prefix hash."""
    rows = conversations.select(
        F.col(conv_id).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    whole = Window.partitionBy("conv")
    order = whole.orderBy(F.asc_nulls_first("turn"), "role", "text")
    this = F.struct("turn", "role", "text")
    rows = rows.withColumn("new", (~this.eqNullSafe(F.lag(this).over(order))).cast("int"))
    rows = rows.withColumns({"place": F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))}).where("new = 1")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns(
        {
            "p": F.bit_xor(F.xxhash64("place", "role", "text")).over(so_far),
            "q": F.bit_xor(F.xxhash64(F.lit("q"), "place", "role", "text")).over(so_far),
            "turns": F.count("*").over(whole),
        }
    )
    return rows.select("conv", "role", "text", "place", "turns", "p", "q")


def render_maximal(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, n_turns, n_copies, chat``: each conversation that is no snapshot of a longer one, rendered.

    Turns are ordered by number, then role, then text; NULL numbers come first
    and a row repeated in all four counts once. NULL roles and texts are empty.
    Of equal conversations (``n_copies``) the least ``conv_id`` is named; rows
    with a NULL ``conv_id`` are one conversation. The turns of one conversation
    meet in one task, as they end in one row. An empty table gives none; other
    columns are not carried, whatever their names.
    """
    turns = _turns(conversations, conv_id, turn, role, text)
    key = ["p", "q", "length"]
    ends = turns.where("place = turns").select("conv", "p", "q", F.col("turns").alias("length"))
    distinct = ends.groupBy(*key).agg(F.min("conv").alias("kept"), F.count("*").alias("n_copies"))
    before = turns.where("place < turns").select("p", "q", F.col("place").alias("length")).distinct()
    maximal = distinct.join(before, key, "left_anti").select("kept", "n_copies")
    shown = turns.join(maximal, F.col("conv").eqNullSafe(F.col("kept")))
    parts = F.array_sort(F.collect_list(F.struct("place", "role", "text")))
    chat = F.array_join(
        F.transform(parts, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))), ""
    )
    return shown.groupBy(F.col("conv").alias("conv_id")).agg(
        F.max("turns").alias("n_turns"), F.max("n_copies").alias("n_copies"), chat.alias("chat")
    )


CHAT_SQL = f"""
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
         count(*) OVER (PARTITION BY conv_id) AS turns
  FROM turns
),
prefixed AS (
  SELECT *, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY place) AS prefix FROM placed
),
ends AS (
  SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM prefixed WHERE place = turns GROUP BY prefix
),
maximal AS (
  SELECT * FROM ends WHERE prefix NOT IN (SELECT prefix FROM prefixed WHERE place < turns)
)
SELECT m.conv_id, max(p.turns) AS n_turns, max(m.n_copies) AS n_copies,
       string_agg('{OPEN}' || p.role || chr(10) || p.text || '<|im_end|>' || chr(10), '' ORDER BY p.place) AS chat
FROM maximal m JOIN prefixed p ON p.conv_id = m.conv_id GROUP BY m.conv_id
"""
