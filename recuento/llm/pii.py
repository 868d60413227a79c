"""Personal data: fixed patterns, and identifiers found through their contexts.

The fixed patterns give the base spans. They are also the seeds of a bootstrap:
the two words before a seed are a lexical pattern for its kind. Patterns and the
identifier-like tokens (words, or runs of digit groups) they introduce form a graph. Round by round a pattern is
scored by how often, of all its occurrences in the corpus, it introduces a token
known to be of the kind, and tokens that reliable patterns introduce become
known. Tokens introduced by reliable patterns are added to the spans.

Everything is built-in expressions. Patterns travel as hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recuento.llm.bit_table import maybe_in
from recuento.llm.common import text_of
from recuento.session import materialize

# Kinds in order, and what matches them. The repetitions that cannot give anything back are possessive
# and matches begin where a run begins, so that a long run is read once; what matches is the same.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_OPENING, _CLOSING = r"[(\[{<\"']", r"[.,;:!?)\]}>\"']"
_DIGITS = r"(?![0-9]++\.[0-9]++\.[0-9]++\.[0-9])[0-9]++(?:[.()\[\]-]{1,2}+[0-9]++)*+[)\]]?+" + rf"(?={_CLOSING}*+(?:[\x20\x09-\x0D]|$))"

#: Digit groups joined by single spaces, dots, hyphens or brackets, unless the run is longer than any token; or a word
#: with a digit or an at sign in it.
TOKEN = (
    r"(?<![^\x20\x09-\x0D])(?:"
    + rf"(?!{_OPENING}*+\+?+[0-9][0-9.()\[\]\x20-]{{64}}){_OPENING}*+\+?+{_DIGITS}(?:\x20[(\[]?+{_DIGITS})++{_CLOSING}*+"
    + r"|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
)
TOKEN_CHARS = (5, 64)

LEAST_SEEDS = 5
"""A pattern needs so many different known identifiers of a kind."""

LEAST_SCORE = 0.5
"""A pattern counts if at least this share of its occurrences introduces the kind, a token if it is this likely."""

ROUNDS = 3

FOLDED = 64
"""Matches that are folded at a time; any number gives the same result."""

_SPAN = "array<struct<start:int,end:int,value:string,gap:string>>"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _valid(kind: str, value: str) -> str:
    """SQL that says whether a match counts."""
    if kind == "ip":
        return f"forall(split({value}, '[.]'), p -> cast(p as double) <= 255)"
    if kind == "phone":
        return f"char_length({_digits(value)}) between 8 and 15"
    if kind == "card":
        digit = "(ascii(substring(d, i, 1)) - 48)"
        doubled = f"if((char_length(d) - i) % 2 = 1, {digit} * 2 - if({digit} > 4, 9, 0), {digit})"
        total = f"aggregate(sequence(1, char_length(d)), 0, (sum, i) -> sum + {doubled})"
        return f"exists(array({_digits(value)}), d -> {total} % 10 = 0)"
    return "true"


def matches(text: str, pattern: str, valid: str = "true") -> Column:
    """Start, end and value of the matches of ``pattern`` that are ``valid`` (SQL on ``m.value``), and the end of the text before each.

    Spark copies what a fold has gathered at each of its steps. So matches are
    folded a few at a time, from the place and the text where the ones before
    end, and a text of many matches costs in proportion to them.
    """
    literal = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    found = f"concat(regexp_extract_all({text}, {literal}, 0), array(''))"
    pairs = f"zip_with(split({text}, {literal}, -1), {found}, (gap, value) -> named_struct('gap', gap, 'value', value))"
    few = f"transform(sequence(0, (size(ms) - 1) div {FOLDED}), at -> slice(ms, cast(at as int) * {FOLDED} + 1, {FOLDED}))"
    few = f"element_at(transform(array({pairs}), ms -> {few}), 1)"
    size = "aggregate(fs, 0, (n, m) -> n + char_length(m.gap) + char_length(m.value))"
    end = "aggregate(fs, s.tail, (t, m) -> right(concat(t, m.gap, m.value), 120))"
    before = f"""aggregate(fss, named_struct('at', 0, 'tail', '', 'out', cast(array() as array<struct<at:int,tail:string>>)),
        (s, fs) -> named_struct('at', s.at + {size}, 'tail', {end}, 'out', concat(s.out, array(named_struct('at', s.at, 'tail', s.tail)))), s -> s.out)"""
    start = "s.at + char_length(m.gap)"
    span = f"named_struct('start', {start}, 'end', {start} + char_length(m.value), 'value', m.value, 'gap', right(concat(s.tail, m.gap), 120))"
    step = f"""named_struct('at', {start} + char_length(m.value),
        'tail', right(concat(s.tail, m.gap, m.value), 120),
        'out', if(m.value <> '' and {valid}, concat(s.out, array({span})), s.out))"""
    fold = f"aggregate(fs, named_struct('at', b.at, 'tail', b.tail, 'out', cast(array() as {_SPAN})), (s, m) -> {step}, s -> s.out)"
    return F.expr(f"flatten(element_at(transform(array({few}), fss -> zip_with(fss, {before}, (fs, b) -> {fold})), 1))")


def _context(gap: Column) -> Column:
    """A hash of the two words before a token, in lower case; NULL if there are not two."""
    near = F.lower(F.right(F.concat(F.lit(" "), gap), F.lit(120)))
    pattern = r"[\x20\x09-\x0D]([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+$"
    first, second = F.regexp_extract(near, pattern, 1), F.regexp_extract(near, pattern, 2)
    return F.when(second != "", F.xxhash64(first, second))


def _found(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id, mark, base, tokens``: base spans by kind, and tokens with their context and, for seeds, kind."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text_of(text)).alias("mark"), text_of(text).alias("text"))
    marked = F.col("text").rlike("[0-9@]")
    spans = {kind: matches("text", PATTERNS[kind], _valid(kind, "m.value")) for kind in KINDS}
    none = F.array().cast(_SPAN)
    rows = rows.withColumns({kind: F.when(marked, spans[kind]).otherwise(none) for kind in KINDS})
    least, most = TOKEN_CHARS
    rows = rows.withColumn("token", F.when(marked, matches("text", TOKEN, f"char_length(m.value) <= {2 * most}")).otherwise(none))

    def of_kind(kind: str) -> Column:
        return F.transform(
            kind,
            lambda s: F.struct(
                F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.xxhash64(F.lower(s["value"])).alias("value")
            ),
        )

    rows = rows.select("id", "mark", F.concat(*map(of_kind, KINDS)).alias("seeds"), "token")

    def token(t: Column) -> Column:
        before = F.char_length(F.regexp_extract(t["value"], rf"^(?:(?!\([0-9]++\)[\x20.-]?+[0-9]){_OPENING})*+", 0))
        after = F.char_length(F.regexp_extract(t["value"], f"(?<!{_CLOSING}){_CLOSING}++$", 0))
        start, end = t["start"] + before, t["end"] - after
        value = F.lower(F.substring(t["value"], before + 1, F.greatest(end - start, F.lit(0))))
        over = F.filter("seeds", lambda b: (b["start"] < end) & (b["end"] > start))
        seed = F.get(F.filter(over, lambda b: b["start"] == start), F.lit(0))
        return F.struct(
            start.alias("start"), end.alias("end"), F.coalesce(seed["value"], F.xxhash64(value)).alias("value"), _context(t["gap"]).alias("pattern"),
            seed["kind"].alias("kind"), ((F.size(over) == 0) & (end - start).between(least, most)).alias("free"),
        )

    tokens = F.filter(F.transform("token", token), lambda t: t["pattern"].isNotNull() & (t["free"] | t["kind"].isNotNull()))
    base = F.transform("seeds", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("id", "mark", base.alias("base"), tokens.alias("tokens"))


def _reliable(uses: DataFrame, docs: DataFrame, text: str) -> DataFrame | None:
    """``pattern, kind, score`` of the patterns that count, after all rounds; None if no pattern has seeds enough."""
    seeds = uses.where("kind is not null").select("value", "kind", F.lit(1.0).alias("likely")).distinct()
    backed = uses.where("kind is not null").groupBy("pattern", "kind").agg(F.count_distinct("value").alias("seeds"))
    # patterns that may gain seeds later are among those that introduce tokens often enough
    wide = uses.groupBy("pattern").agg(F.count_distinct("value").alias("values")).where(F.col("values") >= LEAST_SEEDS)
    wide = materialize(wide.select("pattern"), "patterns")
    if not backed.where(F.col("seeds") >= LEAST_SEEDS).limit(1).count():
        return None
    words = F.regexp_extract_all(F.lower(text_of(text)), F.lit(r"[^\x20\x09-\x0D]++"), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))
    member = maybe_in(wide, "pattern")
    met = docs.select(F.explode(pairs).alias("pattern")).where(member(F.col("pattern")))
    totals = materialize(met.groupBy("pattern").agg(F.count("*").alias("total")).join(wide, "pattern"), "totals")

    known, reliable = seeds, None
    for _ in range(ROUNDS):
        scored = uses.select("pattern", "value", "n").join(known, "value").groupBy("pattern", "kind")
        scored = scored.agg(F.sum(F.col("n") * F.col("likely")).alias("hits"), F.count_distinct("value").alias("seeds"))
        scored = scored.where(F.col("seeds") >= LEAST_SEEDS).join(totals, "pattern")
        scored = scored.select("pattern", "kind", F.least(F.col("hits") / F.col("total"), F.lit(0.999)).alias("score"))
        reliable = materialize(scored.where(F.col("score") >= LEAST_SCORE), "reliable")
        led = uses.where("kind is null").select("pattern", "value").distinct().join(reliable, "pattern")
        led = led.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("score"))))).alias("likely"))
        known = materialize(seeds.unionByName(led.where(F.col("likely") >= LEAST_SCORE)), "known")
    return reliable


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, spans``, arrays of kind, start and end, one row for each row in.

    ``base`` are the matches of the fixed patterns, kinds in order, then by
    start; positions are code points, ends exclusive. ``spans`` also has the
    tokens that reliable contexts introduce, with the kind of the context's
    seeds; these never overlap base spans. Contexts are learned from all
    documents. NULL and empty texts have no spans; rows equal in ``doc_id`` and
    text have equal results, a NULL ``doc_id`` is like any other. Other columns
    are not carried, whatever their names.
    """
    found = materialize(_found(docs, doc_id, text), "found")
    tokens = found.select("id", "mark", F.explode("tokens").alias("t")).select("id", "mark", "t.*")
    uses = tokens.groupBy("pattern", "value", "kind").agg(F.count("*").alias("n"))
    reliable = _reliable(materialize(uses, "uses"), docs, text)
    if reliable is None:
        return found.select(F.col("id").alias("doc_id"), "base", F.col("base").alias("spans"))
    led = tokens.where("kind is null and free").join(reliable.withColumnRenamed("kind", "led"), "pattern")
    best = led.groupBy("id", "mark", "start", "end").agg(F.max(F.struct("score", "led")).alias("best"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("best.led"))
    added = best.groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).agg(
        F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end"))).alias("added")
    )
    joined = found.join(added, F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    ranked = F.transform("base", lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end")))
    every = F.array_sort(F.concat(ranked, F.coalesce("added", F.array().cast("array<struct<rank:bigint,start:int,end:int>>"))))
    named = F.transform(every, lambda s: F.struct(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"].cast("int")).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select(F.col("id").alias("doc_id"), "base", named.alias("spans"))


def count_of(kind: str, spans: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listed(spans: str) -> Column:
    """The spans as text: ``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
