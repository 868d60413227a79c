"""Document fingerprints by winnowing.

A text is cut into short tokens; every run of ``GRAM`` tokens gets a hash, and of
every ``WINDOW`` neighbouring hashes the least is chosen, the rightmost of equal
ones. What two texts share over ``GRAM + WINDOW - 1`` tokens is therefore chosen
in both. Hash and place travel in one number, so that the least number of a
window is the least hash at its rightmost place. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recuento.llm.common import text_of
from recuento.operators.ranking import number_rows
from recuento.session import materialize

GRAM = 3
WINDOW = 4

#: Runs other than white space, long ones in pieces, so that texts without spaces have tokens too.
TOKEN = r"[^\x20\x09-\x0D]{1,8}+"

_PLACE = (1 << 24) - 1


def with_fingerprint(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the chosen grams in order, hash in the upper 40 bits, place (counted down) in the others.

    A text of fewer tokens than a gram has one gram, a text without tokens none;
    fewer grams than a window are one window.
    """
    tokens, h, grams, least = (f"__{out}_{c}" for c in "thgm")
    rows = rows.withColumn(tokens, F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))
    rows = rows.withColumn(h, F.transform(tokens, lambda t: F.xxhash64(t)))

    def packed(value: Column, place: Column) -> Column:
        upper = F.lit(~_PLACE)
        return value.bitwiseAND(upper).bitwiseOR(F.lit(_PLACE).cast("long") - place.bitwiseAND(F.lit(_PLACE)))

    last = F.size(h) - GRAM
    run = F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: packed(F.xxhash64(*[F.coalesce(F.get(h, i + k), F.lit(0)) for k in range(GRAM)]), i),
    )
    rows = rows.withColumn(grams, F.when(F.size(h) > 0, run).otherwise(F.array().cast("array<bigint>")))

    def doubled(name: str, reach: int) -> Column:
        return F.transform(name, lambda x, i: F.least(x, F.get(name, i + reach)))

    reach, name = 1, grams
    while reach < WINDOW:
        wider = f"{least}{reach}"
        rows = rows.withColumn(wider, doubled(name, reach))
        reach, name = reach * 2, wider
    windows = F.greatest(F.lit(1), F.size(grams) - WINDOW + 1)
    chosen = F.array_distinct(F.slice(name, F.lit(1), windows))
    kept = [c for c in rows.columns if not c.startswith(f"__{out}_")]
    return rows.withColumn(out, chosen).select(*kept, out)


def hashes(fingerprint: str) -> Column:
    """The different hashes of a fingerprint, places left out, as 32-bit numbers."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, 32).cast("int")))


def likeness(a: Column, b: Column) -> Column:
    """Twice the common hashes over all of both, between 0 and 1; two empty sets are alike."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def digest(fingerprint: str) -> Column:
    """Hashes and places of a fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(s), F.col(fingerprint))), 16, "0") for s in (1, 2)]))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint``: chosen grams as an array of hash and token place, one row for each row in.

    NULL and empty texts have an empty fingerprint. Rows are told apart by
    nothing but themselves, so NULL and repeated ``doc_id`` are as good as any.
    Other columns are not carried, whatever their names.
    """
    rows = with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")), "text", "marks")
    entry = F.transform(
        "marks",
        lambda x: F.struct(
            F.shiftright(x, 24).alias("hash"), (F.lit(_PLACE).cast("long") - x.bitwiseAND(F.lit(_PLACE))).cast("int").alias("place")
        ),
    )
    return rows.select("doc_id", entry.alias("fingerprint"))


def compare_with_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document.

    The next document is the one with the next lower ``doc_id`` (then text hash),
    for the last the first; NULL comes last. The edited text has the first
    characters of the next document in place of its later half. Returns
    ``doc_id, n_chars, edited, fingerprint, edited_fingerprint`` (arrays of
    packed grams) and ``near_edited, near_next``. Rows equal in ``doc_id`` and
    text have equal results and are one document in the order.

    Texts are dealt once by document; the next document's beginning and hashes
    are sent to the document before it.
    """
    zero = F.lit("0").cast(docs.schema[doc_id].dataType)
    base = docs.select(
        F.isnull(doc_id).alias("unnamed"),
        F.coalesce(F.col(doc_id), zero).alias("id"),
        F.xxhash64(text_of(text)).alias("mark"),
        text_of(text).alias("text"),
    )
    key = ["unnamed", "id", "mark"]
    ring = base.select(*key, F.char_length("text").alias("n")).distinct()
    placed, total = number_rows(ring, [F.asc("unnamed"), F.desc("id"), F.asc("mark")], "place")
    before = placed.select(
        *[F.col(c).alias(f"to_{c}") for c in key], F.floor(F.col("n") / 2).cast("int").alias("need"),
        (F.col("place") % F.lit(max(total, 1)) + 1).alias("next_place"),
    )
    sends = placed.join(before, F.col("place") == F.col("next_place"))
    sends = materialize(sends.select(*key, *[f"to_{c}" for c in key], "need"), "ring")
    source = base.join(sends, key).select(*[F.col(f"to_{c}").alias(c) for c in key], "need", "text")
    source = with_fingerprint(source, "text", "marks")
    source = source.select(*key, F.struct(F.expr("left(text, need)").alias("head"), hashes("marks").alias("hashes")).alias("next"))
    source = source.groupBy(*key).agg(F.min("next").alias("next"))

    own = base.join(source, key).withColumn("id", F.when(~F.col("unnamed"), F.col("id")))
    kept = F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))")
    own = own.select("id", "text", F.concat(kept, F.col("next.head")).alias("edited"), F.col("next.hashes").alias("next_hashes"))
    own = with_fingerprint(own, "text", "fingerprint")
    own = with_fingerprint(own, "edited", "edited_fingerprint")
    own = own.withColumn("own_hashes", hashes("fingerprint"))
    return own.select(
        F.col("id").alias("doc_id"),
        F.char_length("text").cast("long").alias("n_chars"),
        "edited",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("own_hashes"), hashes("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
    )
