"""Repeated and nearly repeated lines, by an edit-distance join on segments.

A line within ``edits`` edits of another holds at least one of the other's
``edits + 1`` segments unchanged, a little shifted at most. Each line is filed
under its own segments and looked up under the substrings that can match the
segments of a line as long or up to ``edits`` shorter; lookups under keys where
nothing is filed are dropped before they are moved. Longer lines may differ by
more edits (``LONGER``); the shorter of two lines decides. Lines that meet under a
key are compared by banded bit-parallel edit distance, unless their characters
already tell them apart. Where very many lines share a key, they are dealt in
blocks and compared where the blocks meet, so pairs of lines that are not near
never become rows. Lines linked directly or through others make a class; its
first line stays.

Everything is built-in expressions. Keys and lines travel as hashes; texts are
moved only for lines that met another one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recuento.llm.bit_table import maybe_in
from recuento.llm.common import text_of, whole_row
from recuento.llm.graph import components_within
from recuento.session import materialize

EDITS = 1
LONGER = ((50, 2), (100, 4))
"""Lines of so many characters and more may differ by so many edits."""

FILED_WORDS = 1 << 20
"""64-bit words of the table that tells lookups from keys under which nothing is filed."""

LEAST_CHARS = 20
"""Shorter lines are compared for equality only: a few edits can turn any of them into any other."""

COUNTED = "etaoinshrdlucmfgwypbkv"
"""ASCII characters that are counted before an edit distance is worked out; any choice gives the same result."""

CROWD_BLOCK = 512
"""Lines under one key that are compared with as many others in one place, where there are very many."""


def traits(line: str) -> Column:
    """The length of a string column, and how often it has each of the counted characters."""
    fields = ", ".join(f"'c{i}', octet_length({line}) - octet_length(replace({line}, '{c}', ''))" for i, c in enumerate(COUNTED))
    return F.expr(f"named_struct('n', char_length({line}), {fields})")


def near_traits(a: Column, b: Column, allowed: Column) -> Column:
    """Holds for the traits of all lines within ``allowed`` edits: an edit adds one character and takes another at most."""
    apart = sum((F.abs(a[f"c{i}"] - b[f"c{i}"]) for i in range(len(COUNTED))), F.lit(0))
    return (F.abs(a["n"] - b["n"]) <= allowed) & (apart <= allowed * 2)


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``id, mark, pos, line, h, h2`` for each line that is not blank; ``mark`` tells texts of one id apart."""
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text_of(text)).alias("mark"), text_of(text).alias("text"))
    lines = rows.select("id", "mark", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.where(F.ltrim("line", F.lit(" \t\n\x0b\f\r")) != "")
    return lines.withColumns({"h": F.xxhash64("line"), "h2": F.hash("line")})


def _segments(length: Column, parts: int) -> Iterator[tuple[int, Column, Column]]:
    """Number, 1-based start and length of each segment of a line of ``length`` characters; longer ones come last."""
    base = F.floor(length / parts).cast("int")
    shorter = F.lit(parts) - length % parts
    for i in range(parts):
        start = base * i + F.greatest(F.lit(0), F.lit(i) - shorter) + 1
        yield i, start, base + (F.lit(i) >= shorter).cast("int")


def _keys(line: Column, shorter: int, edits: int) -> list[tuple[Column, bool]]:
    """Keys under which a line meets one ``shorter`` by so many characters, and whether it is the line's own segment."""
    other, keys = F.char_length(line) - shorter, []
    for i, start, size in _segments(other, edits + 1):
        low = max(-i, shorter - (edits - i))
        high = min(i, shorter + (edits - i))
        for shift in range(low, high + 1):
            keys.append((F.xxhash64(other, F.lit(i), F.substring(line, start + shift, size)), shorter == 0 and shift == 0))
    return keys


def segment_keys(line: Column, edits: int) -> Column:
    """``array<struct<key, anchor>>``: where a line is filed (anchor) and where else it is looked up."""
    keys = [key for shorter in range(edits + 1) for key in _keys(line, shorter, edits)]
    return F.array(*[F.struct(key.alias("key"), F.lit(anchor).alias("anchor")) for key, anchor in keys])


def _allowed(length: str, steps: list[tuple[int, int]]) -> str:
    """The edits that a line of ``length`` may differ by, in SQL; ``steps`` are the lengths from which on, and the edits."""
    edits = str(steps[0][1])
    for least, more in steps[1:]:
        edits = f"if({length} >= {least}, {more}, {edits})"
    return edits


def _places(length: int, steps: list[tuple[int, int]], anchors: bool) -> list[tuple[int, int, int, int]]:
    """``shorter, parts, i, shift`` of each key under which a line of ``length`` is filed (``anchors``) or looked up.

    Keys shared with a line that is ``shorter`` take the edits of that line's length.
    """
    places = []
    for shorter in range(steps[-1][1] + 1):
        edits = [more for least, more in steps if length - shorter >= least][-1:]
        for i in range(edits[0] + 1 if edits and shorter <= edits[0] else 0):
            for shift in range(max(-i, shorter - (edits[0] - i)), min(i, shorter + (edits[0] - i)) + 1):
                if (shorter == 0 and shift == 0) == anchors:
                    places.append((shorter, edits[0] + 1, i, shift))
    return places


def keys_of(lines: DataFrame, steps: list[tuple[int, int]], anchors: bool) -> DataFrame:
    """``h, key``: a row for each key under which the lines ``h, line`` are filed (``anchors``) or looked up.

    The places of the keys are a list by the line's length, and one short
    expression takes the key at a place: an array of all keys would be one
    generated method too long for Java to compile.
    """
    kind = "array<struct<shorter:int,parts:int,i:int,shift:int>>"

    def listed(length: int) -> Column:
        rows = [F.struct(*[F.lit(x) for x in place]) for place in _places(length, steps, anchors)]
        return F.array(*rows).cast(kind)

    n, borders = F.col("n"), sorted({least + shorter for least, _ in steps for shorter in range(steps[-1][1] + 1)})
    places = listed(borders[0])
    for length in borders[1:]:
        places = F.when(n >= length, listed(length)).otherwise(places)
    # four bytes a character: a part is cut out without a walk over the line
    rows = lines.select("h", F.encode("line", "UTF-32").alias("code"))
    rows = rows.select("h", "code", F.expr("cast(octet_length(code) div 4 as int)").alias("n"))
    rows = rows.select("h", "code", "n", F.explode(places).alias("p"))
    rows = rows.select("h", "code", (n - F.col("p.shorter")).alias("other"), "p.parts", "p.i", "p.shift")
    size, plain = F.expr("cast(other div parts as int)"), F.expr("parts - other % parts")
    start = size * F.col("i") + F.greatest(F.lit(0), F.col("i") - plain) + 1 + F.col("shift")
    part = F.substring("code", start * 4 - 3, (size + (F.col("i") >= plain).cast("int")) * 4)
    # an array of one: a filter on the key stays above it and does not compute the key again
    return rows.select("h", F.explode(F.array(F.xxhash64("other", "i", part))).alias("key"))


def edit_distance(a: str, b: str, most: int) -> Column:
    """The edit distance of two string columns, or a number above ``most`` if it is above."""
    return F.expr(_edit_distance(a, b, most))


def _edit_distance(a: str, b: str, most: int) -> str:
    """``edit_distance`` in SQL.

    Of the table of distances only the band of ``2 * most + 1`` diagonals is
    kept, one bit per diagonal: where a row of ``a`` has the character of ``b``
    (``same``), where a cell is one more (``up``) or one less (``down``) than the
    cell above it, and where it equals its diagonal neighbour (``flat``). Each
    character of ``b`` moves the band by one row and column. The diagonal that
    ends in the last cell grows by one wherever it is not flat.
    """

    def characters(name: str) -> str:
        return f"if({name} = '', cast(array() as array<string>), split({name}, ''))"

    width = 2 * most + 1
    full = (1 << width) - 1
    bits = " | ".join(f"if(get(c.a, j - {most + 1 - k}) <=> get(c.b, j - 1), {1 << k}L, 0L)" for k in range(width))
    across = "(s.down | ~(flat | s.up))"
    moved = f"""named_struct(
        'up', ((flat & s.up) | ~(shiftright(flat, 1) | {across})) & {full}L,
        'down', shiftright(flat, 1) & {across} & {full}L,
        'distance', s.distance + 1 - (shiftright(flat, {most} + size(c.a) - size(c.b)) & 1L))"""
    flat = f"((((same & s.up) + s.up) ^ s.up) | same | s.down) & {full}L"
    start = f"named_struct('up', {full & ~((1 << most) - 1)}L, 'down', 0L, 'distance', cast(greatest(size(c.a) - size(c.b), 0) as bigint))"
    steps = f"transform(if(size(c.b) > 0, sequence(1, size(c.b)), cast(array() as array<int>)), j -> {bits})"
    walk = f"aggregate({steps}, {start}, (s, same) -> element_at(transform(array({flat}), flat -> {moved}), 1), s -> s.distance)"
    far = f"abs(char_length({a}) - char_length({b})) > {most}"
    # the characters are bound once per pair, not split anew at every step
    pair = f"named_struct('a', {characters(a)}, 'b', {characters(b)})"
    return f"if({far}, {most + 1}L, element_at(transform(array({pair}), c -> {walk}), 1))"


def _cut_ends(a: str, b: str) -> str:
    """A struct ``a, b`` of both strings without equal beginnings and ends, cut off by halves; the edit distance stays."""
    size = "cast(floor(least(char_length(s.a), char_length(s.b)) / part) as int)"
    begin = f"""if(left(s.a, {size}) = left(s.b, {size}),
        named_struct('a', substring(s.a, {size} + 1), 'b', substring(s.b, {size} + 1)), s)"""
    end = f"""if(right(s.a, {size}) = right(s.b, {size}),
        named_struct('a', left(s.a, char_length(s.a) - {size}), 'b', left(s.b, char_length(s.b) - {size})), s)"""
    cut = f"named_struct('a', {a}, 'b', {b})"
    for step in (begin, end):
        cut = f"aggregate(array(2, 4, 8, 16, 32, 64), {cut}, (s, part) -> {step})"
    return cut


def _without_common_ends(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with both strings cut by ``_cut_ends``."""
    others = [c for c in pairs.columns if c not in (a, b)]
    return pairs.select(*others, F.expr(_cut_ends(a, b)).alias("cut")).select(*others, F.col("cut.a").alias(a), F.col("cut.b").alias(b))


def _maybe_near(a: str, b: str, allowed: str, most: int) -> Column:
    """``_maybe_near_sql`` as a column."""
    return F.expr(_maybe_near_sql(a, b, allowed, most))


def _maybe_near_sql(a: str, b: str, allowed: str, most: int) -> str:
    """A quick test in SQL that holds for all strings within ``allowed`` edits, at most ``most``, and for few others.

    Of ``2 * most + 1`` parts of ``a`` an edit changes one at most, and the
    others are in ``b``, moved by no more than the edits.
    """
    parts, found = 2 * most + 1, []
    for i in range(parts):
        begin = f"cast(char_length({a}) * {i} div {parts} as int)"
        size = f"cast(char_length({a}) * {i + 1} div {parts} as int) - {begin}"
        near = f"substring({b}, greatest({begin} + 1 - {most}, 1), {size} + {2 * most})"
        found.append(f"if(instr({near}, substring({a}, {begin} + 1, {size})) > 0, 1, 0)")
    return f"{' + '.join(found)} >= {parts} - {allowed}"


def _near_in_crowds(members: DataFrame, texts: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """``a, b, linked`` for the near lines of different components in each bucket of ``bucket, node, anchor, component``.

    The lines of a bucket are dealt in blocks of about ``CROWD_BLOCK``, and each
    two blocks meet in a group of their own. Two lines are compared as they meet
    in the least bucket they share, so only links become rows.
    """
    parts = members.groupBy(F.col("bucket").alias("crowd")).agg(F.ceil(F.count("*") / CROWD_BLOCK).cast("int").alias("parts"))
    rows = members.join(parts, F.col("bucket") == F.col("crowd"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("parts")).cast("int"))
    own = members.groupBy(F.col("node").alias("h")).agg(
        F.collect_list("bucket").alias("all"), F.collect_list(F.when(F.col("anchor"), F.col("bucket"))).alias("filed")
    )
    rows = rows.join(texts.join(own, "h"), F.col("node") == F.col("h"))
    rows = rows.select("bucket", "node", "anchor", "component", "line", "traits", "all", "filed", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    one, two = (rows.where(F.col("own") == F.col(side)).drop("own", "other") for side in ("i", "j"))
    two = two.select(*[F.col(c).alias(f"{c}2") for c in two.columns])
    met = (F.col("bucket") == F.col("bucket2")) & (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2"))
    apart = (F.col("component") != F.col("component2")) & (F.col("anchor") | F.col("anchor2"))
    once = (F.col("i") < F.col("j")) | (F.col("node") < F.col("node2"))
    least = F.array_min(F.array_union(F.array_intersect("filed", "all2"), F.array_intersect("all", "filed2"))) == F.col("bucket")
    allowed, most = _allowed("least(traits.n, traits2.n)", steps), steps[-1][1]
    within = f"if({_maybe_near_sql('x.a', 'x.b', allowed, most)}, {_edit_distance('x.a', 'x.b', most)} <= {allowed}, false)"
    near = F.expr(f"element_at(transform(array({_cut_ends('line', 'line2')}), x -> {within}), 1)")
    near = F.when(near_traits(F.col("traits"), F.col("traits2"), F.expr(allowed)), F.when(least, near)).otherwise(False)
    links = one.join(two, met & apart & once & near)
    return links.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b"), F.lit(True).alias("linked"))


def dropped_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    edits: int = EDITS,
    least_chars: int = LEAST_CHARS,
    longer: tuple[tuple[int, int], ...] = LONGER,
) -> DataFrame:
    """``id, mark, dropped``: the 0-based numbers of the lines to drop, for texts that have any.

    ``mark`` is a hash of the text. Lines are equal, or at least ``least_chars``
    long and within ``edits`` edits of each other, directly or through others, or
    the edits that ``longer`` gives for the length of the shorter one; of such a class the first line by ``doc_id``, then text, then place stays.
    Blank lines are neither compared nor dropped.
    """
    lines = lines_of(docs, doc_id, text)
    places = materialize(lines.select("id", "mark", "pos", "h", "h2"), "lines")
    long = lines.where(F.char_length("line") >= least_chars)
    steps = [(0, edits), *[(least, more) for least, more in sorted(longer) if more > edits]]
    filed = materialize(keys_of(long, steps, True).withColumn("anchor", F.lit(True)), "filed")
    asked = keys_of(long, steps, False)
    asked = asked.where(maybe_in(filed, "key", FILED_WORDS, 2)(F.col("key"))).withColumn("anchor", F.lit(False))
    keyed = filed.unionByName(materialize(asked, "asked"))
    met = keyed.groupBy("key").agg(F.min("h").alias("x"), F.max("h").alias("y"), F.max("anchor").alias("z"))
    met = materialize(met.where("x <> y and z").select("key"), "keys")
    buckets = keyed.where(maybe_in(met, "key")(F.col("key"))).groupBy("key", "h").agg(F.max("anchor").alias("anchor"))
    buckets = buckets.join(met.withColumnRenamed("key", "bucket"), F.col("key") == F.col("bucket"))
    buckets = materialize(buckets.select("bucket", F.col("h").alias("node"), "anchor"), "buckets")
    here = maybe_in(buckets.select("node"), "node")
    texts = long.where(here(F.col("h"))).groupBy("h").agg(F.min("line").alias("line"))
    texts = materialize(texts.withColumn("traits", traits("line")), "texts")

    def allowed_between(a: str, b: str) -> Column:
        return F.expr(_allowed(f"least({a}.n, {b}.n)", steps))

    def maybe(a: str, b: str) -> Column:
        return near_traits(F.col(a), F.col(b), allowed_between(a, b))

    def test(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            own = texts.select(F.col("h").alias(f"h{side}"), F.col("line").alias(f"t{side}"), F.col("traits").alias(f"r{side}"))
            pairs = pairs.join(own, F.col(side) == F.col(f"h{side}"))
        allowed = F.when(maybe("ra", "rb"), allowed_between("ra", "rb")).otherwise(-1)
        short = _without_common_ends(pairs.select("a", "b", "ta", "tb", allowed.alias("allowed")), "ta", "tb")
        near = F.when((F.col("allowed") >= 0) & _maybe_near("ta", "tb", "allowed", steps[-1][1]), edit_distance("ta", "tb", steps[-1][1]) <= F.col("allowed"))
        return short.select("a", "b", near.otherwise(False).alias("linked"))

    found = components_within(buckets, test, lambda members: _near_in_crowds(members, texts, steps), (texts.select("h", "traits"), maybe))
    place = F.struct("id", "mark", "pos")
    exact = places.groupBy("h", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    if found is None:
        classes = exact.withColumns({"c": F.col("h"), "c2": F.col("h2")})
    else:
        classes = exact.join(found.withColumnRenamed("id", "linked"), F.col("h") == F.col("linked"), "left")
        classes = classes.where("n > 1 or linked is not null")  # a line by itself is a class of one
        alone = F.col("component").isNull()
        classes = classes.withColumns({"c": F.coalesce("component", "h"), "c2": F.when(alone, F.col("h2")).otherwise(F.lit(0))})
    first = classes.groupBy(F.col("c").alias("k"), F.col("c2").alias("k2")).agg(F.min("first").alias("stays"), F.sum("n").alias("lines"))
    repeated = classes.join(first.where("lines > 1"), (F.col("c") == F.col("k")) & (F.col("c2") == F.col("k2")))
    repeated = materialize(repeated.select(F.col("h").alias("k"), F.col("h2").alias("k2"), "stays"), "repeated")
    drop = places.join(repeated, (F.col("h") == F.col("k")) & (F.col("h2") == F.col("k2"))).where(~place.eqNullSafe(F.col("stays")))
    return drop.groupBy("id", "mark").agg(F.collect_set("pos").alias("dropped"))


def drop_repeated_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    edits: int = EDITS,
    least_chars: int = LEAST_CHARS,
    longer: tuple[tuple[int, int], ...] = LONGER,
) -> DataFrame:
    """The rows and columns of ``docs`` in a struct ``row``, with ``n_lines``, ``dropped`` and the ``clean`` text.

    See ``dropped_lines``. One row for each row in; rows with the same ``doc_id``
    and text are one document and share the decision. A NULL or empty text is
    one blank line and stays as it is, as does a text without lines to drop; a
    NULL ``doc_id`` comes before all others. Extra columns of any name stay in
    ``row``.
    """
    drops = dropped_lines(docs, doc_id, text, edits, least_chars, longer)
    drops = drops.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), "dropped")
    rows = docs.select(whole_row(docs).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text_of(text)).alias("mark"))
    joined = rows.join(drops, F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")), "left")
    own = F.col("row").getField(text).cast("string")
    # a column of its own: taken inside the function below, the text would be split once for each line
    joined = joined.select("row", "dropped", own.alias("text"), F.split(F.coalesce(own, F.lit("")), "\n", -1).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    clean = F.array_join(F.transform(F.array_sort(kept), lambda i: F.get("lines", i)), "\n")
    return joined.select(
        "row",
        F.size("lines").alias("n_lines"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(clean).alias("clean"),
    )
