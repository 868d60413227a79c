"""Benchmark decontamination by winnowing.

Texts become words, every run of ``GRAM`` words a hash. Of the grams inside each
run of ``SPAN`` words, a window, the least hash is kept, the rightmost of equal
ones. A window of an item that occurs in a document has the same grams in the
same order there, so both keep the same gram: the document's windows around a
gram that no item kept need not be looked at. Kept grams of documents are joined
with those of the items and extended to the whole window, word by word. So every
shared run of ``SPAN`` words and more is found, and nothing else.

An item of fewer words is one window of its own length; documents are winnowed
once more for each such length. Built-in expressions only.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recuento.llm.bit_table import bit_table, has_bit
from recuento.llm.common import text_of
from recuento.session import materialize

SPAN = 10
GRAM = 5

#: What stands between words, which are runs of digits, a to z and everything beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SALTS = 8
"""Copies of the items' windows, so that a window which very many documents share is joined in as many tasks."""

_LEAST_WORDS, _MOST_WORDS = 1 << 10, 1 << 18
_PLACES = (1 << 31) - 1


def words_of(text: Column) -> Column:
    """The words of a text, with A to Z in lower case."""
    # splitting takes a fifth of the time of extracting all words
    return F.array_remove(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), BETWEEN), "")


def _kept_grams(words: str, hashes: str, span: int, gram: int) -> tuple[Column, list[int]]:
    """The grams of a text, each hash with its place, and the reaches by which least values double up to a window."""
    gram = min(gram, span)

    def packed(i: Column) -> Column:
        h = F.xxhash64(*[F.get(hashes, i + k) for k in range(gram)])
        return h.bitwiseAND(F.lit(~((1 << 32) - 1))).bitwiseOR(F.lit(_PLACES) - i.cast("long"))

    grams = F.transform(F.sequence(F.lit(0), F.size(words) - gram), packed)
    covered, reaches = 1, []
    while covered < span - gram + 1:
        reach = min(covered, span - gram + 1 - covered)
        reaches.append(reach)
        covered += reach
    return F.when(F.size(words) >= span, grams).otherwise(F.array().cast("array<bigint>")), reaches


def _least_with(values: str, reach: int) -> Column:
    return F.transform(values, lambda x, i: F.least(x, F.get(values, i + reach)))


def _with_windows(rows: DataFrame, span: int, gram: int, out: str) -> DataFrame:
    """Add ``out``: for each window of ``words``, by its first word, the gram it keeps, packed with the gram's place."""
    grams, reaches = _kept_grams("words", "hashes", span, gram)
    rows = rows.withColumn(out, grams)
    for reach in reaches:
        rows = rows.withColumn(out, _least_with(out, reach))
    return rows.withColumn(out, F.slice(out, F.lit(1), F.greatest(F.size("words") - span + 1, F.lit(0))))


def _place(packed: Column) -> Column:
    return (F.lit(_PLACES) - packed.bitwiseAND(F.lit((1 << 32) - 1))).cast("int")


def _key(packed: Column, span: int) -> Column:
    """What a kept gram is joined by: its hash and the length of the window that kept it."""
    return F.xxhash64(F.lit(span), F.shiftright(packed, 32))


def _window_text(start: Column, span: int) -> Column:
    # words hold no space, so the text tells windows apart
    return F.array_join(F.slice("words", start + 1, span), " ")


def _windows_to_test(kept: str, span: int, gram: int, kept_by_items: Callable[[Column], Column]) -> Column:
    """``start, length, key, window`` of the windows that keep a gram which items keep as well."""

    def extended(x: Column) -> Column:
        low = F.greatest(_place(x) - max(span - gram, 0), F.lit(0))
        starts = F.filter(F.sequence(low, F.least(_place(x), F.size(kept) - 1)), lambda s: F.get(kept, s) == x)
        return F.transform(starts, lambda s: F.struct(
            s.alias("start"), F.lit(span).alias("length"), _key(x, span).alias("key"), _window_text(s, span).alias("window")
        ))

    return F.flatten(F.transform(F.filter(F.array_distinct(kept), lambda x: kept_by_items(_key(x, span))), extended))


def _item_windows(benchmark: DataFrame, item_id: str, text: str, span: int, gram: int) -> tuple[DataFrame, list[int]]:
    """``key, window, item`` for each different window of an item, and the lengths of the windows."""
    items = benchmark.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(text_of(text)).alias("words")
    ).where(F.size("words") > 0)
    items = materialize(items.withColumn("span", F.least(F.size("words"), F.lit(span))), "items")
    spans = sorted(r["span"] for r in items.select("span").distinct().collect())
    found = None
    for length in spans:
        rows = items.where(F.col("span") == length).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
        rows = materialize(_with_windows(rows, length, gram, "kept").select("item", "words", "kept"), "item_grams")
        rows = rows.select("item", "words", F.posexplode("kept").alias("start", "kept"))
        rows = rows.select(_key(F.col("kept"), length).alias("key"), _window_text(F.col("start"), length).alias("window"), "item")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = items.select(F.lit(0).cast("long").alias("key"), F.lit("").alias("window"), "item").limit(0)
    return materialize(found.distinct(), "item_windows"), spans


def _filter_words(keys: int) -> int:
    """64-bit words of a table with some 16 bits for each key, within fixed bounds."""
    size = _LEAST_WORDS
    while size * 4 < keys and size < _MOST_WORDS:
        size *= 2
    return size


def shared_spans(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
) -> DataFrame:
    """``doc_id, n_words, spans, items``: where each document repeats items, and which.

    ``spans`` are the merged runs of words that lie in an occurrence of a window,
    as structs of the first word's number, from 0, and the number behind the
    last; ``items`` the ids of the items with such windows as sorted texts. One
    row for each row of ``docs``; rows equal in ``doc_id`` and text are told
    apart by nothing and get the same result. NULL texts have no words; a
    document without a shared window has two empty arrays. Items without words
    count for nothing, rows with one ``item_id`` are one item, a NULL ``item_id``
    is the item with the empty name. Either table may be empty; other columns
    are not looked at, whatever their names.

    Documents are read once. Only windows that keep a gram of the items move;
    ``SALTS`` deals those of one frequent passage out to several tasks.
    """
    item_windows, lengths = _item_windows(benchmark, item_id, item_text, span, gram)
    keys = item_windows.select("key").distinct()
    size = _filter_words(keys.count())

    def kept_by_items(key: Column) -> Column:
        return has_bit(F.col("bits"), key, size)

    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text_of(text)).alias("mark"), words_of(text_of(text)).alias("words"))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("bits", bit_table(keys, "key", size))
    found = []
    for length in lengths:
        kept = f"kept{length}"
        rows = _with_windows(rows, length, gram, kept)
        found.append(_windows_to_test(kept, length, gram, kept_by_items))
    none = F.array().cast("array<struct<start: int, length: int, key: bigint, window: string>>")
    candidates = F.concat(*found) if found else none
    read = materialize(rows.select("id", "mark", F.size("words").cast("long").alias("n_words"), candidates.alias("candidates")), "read")

    # items that share the same windows are told apart only at the end: each set of items has one window to stand for it
    sets = item_windows.groupBy("key", "window").agg(
        F.bit_xor(F.xxhash64("item")).alias("p"), F.bit_xor(F.xxhash64(F.lit("q"), "item")).alias("q"), F.count("*").alias("n")
    )
    sets = materialize(sets, "windows")
    stands = sets.groupBy("p", "q", "n").agg(F.min(F.struct("key", "window")).alias("w"))
    stands = stands.select("p", "q", "n", F.col("w.key").alias("k"), F.col("w.window").alias("w"))
    members = item_windows.join(stands, (F.col("key") == F.col("k")) & (F.col("window") == F.col("w"))).select("p", "q", "n", "item")

    asked = read.where(F.size("candidates") > 0).select("id", "mark", F.explode("candidates").alias("c")).select("id", "mark", "c.*")
    asked = asked.withColumn("salt", F.pmod(F.xxhash64("id", "mark", "start"), F.lit(SALTS)).cast("int"))
    windows = sets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = asked.join(windows, ["key", "window", "salt"]).select("id", "mark", "start", (F.col("start") + F.col("length")).alias("end"), "p", "q", "n")
    hits = materialize(hits, "hits")

    doc = ["id", "mark"]
    order = Window.partitionBy(*doc).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select(*doc, "start", "end").distinct().withColumn("apart", F.coalesce(before < F.col("start"), F.lit(True)).cast("int"))
    spans = spans.withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy(*doc, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    shared = hits.select(*doc, "p", "q", "n").distinct().join(members, ["p", "q", "n"])
    shared = shared.groupBy(*doc).agg(F.array_sort(F.collect_set("item")).alias("items"))
    result = spans.join(shared.select(F.col("id").alias("id2"), F.col("mark").alias("mark2"), "items"), _same("id2", "mark2")).drop("id2", "mark2")

    result = result.select(F.col("id").alias("id2"), F.col("mark").alias("mark2"), "spans", "items")
    no_spans, no_items = F.array().cast("array<struct<start: int, end: int>>"), F.array().cast("array<string>")
    clean = read.where(F.size("candidates") == 0).select(F.col("id").alias("doc_id"), "n_words", no_spans.alias("spans"), no_items.alias("items"))
    met = read.where(F.size("candidates") > 0).select("id", "mark", "n_words").join(result, _same("id2", "mark2"), "left")
    met = met.select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("spans", no_spans).alias("spans"), F.coalesce("items", no_items).alias("items")
    )
    return clean.unionByName(met)


def _same(id2: str, mark2: str) -> Column:
    return F.col("id").eqNullSafe(F.col(id2)) & (F.col("mark") == F.col(mark2))


def words_within(spans: str) -> Column:
    """The number of words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


DECONTAM_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
),
spans AS (SELECT *, least(len(words), 10) AS n FROM b WHERE len(words) > 0),
item_windows AS (
  SELECT DISTINCT item, n, array_to_string(words[s:s + n - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS s FROM spans)
),
doc_windows AS (
  SELECT r, s, n, array_to_string(words[s:s + n - 1], ' ') AS win
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS s
        FROM d, (SELECT DISTINCT n FROM spans) AS lengths WHERE len(words) >= n)
),
hits AS (SELECT r, s, dw.n, item FROM doc_windows dw JOIN item_windows iw ON dw.n = iw.n AND dw.win = iw.win),
hit AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS place FROM hits) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
