"""Near-duplicate documents by weighted Jaccard similarity of their word shingles.

A document is a multiset of shingles. Its signature comes from Poisson processes:
each shingle has a process over the axis of weights, of which a document sees the
part below the shingle's count; every point has a time and a random component,
and a component keeps the least time. Two documents agree in a component with the
probability of their weighted Jaccard similarity. The axis is cut at whole counts
and searched by halves, and only points earlier than the latest component count,
so large counts cost little.

Signatures are banded, pairs that share a band are tested on the signature and
then on the multisets themselves, and the links found make components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recuento.llm.bit_table import maybe_in
from recuento.llm.common import text_of, whole_row
from recuento.llm.graph import components_within
from recuento.operators.ranking import number_rows
from recuento.session import materialize

WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 20, 5
COMPONENTS = BANDS * BAND_ROWS

SLACK = 0.17
"""A pair is compared in full if its signatures agree in at least ``similarity - SLACK`` of the
components: more than four standard deviations of the estimate below the threshold."""

BATCH_WORDS = 400_000

CROWD_BLOCK = 512
"""Members of one bucket that are compared with as many others in one call, where there are very many."""


def _name() -> Column:
    """What names a component: the least of these."""
    return F.struct(F.isnull("id").alias("unnamed"), "id", "mark")


_STEP = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLY = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _MULTIPLY[0]
    x = (x ^ (x >> np.uint64(27))) * _MULTIPLY[1]
    return x ^ (x >> np.uint64(31))


def _waits(seed: np.ndarray, number: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Exponential waiting times, a function of the process and the point's number in it."""
    bits = _mixed(seed ^ _mixed(number.astype(np.uint64)))
    return -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, docs: int, size: int = COMPONENTS) -> np.ndarray:
    """Least times, one row of ``size`` for each of ``docs`` documents.

    ``doc, shingle, count`` list the distinct shingles of all documents. The
    axis of counts is cut into [0,1), [1,2), [2,4), [4,8) and so on; the parts
    that begin below a shingle's count start a process each. A point of a part
    longer than 1 goes to one half by a coin; the other half starts anew from
    that time, and halves that begin at or above the count are dropped.
    """
    times = np.full((docs, size), np.inf)
    block = [(doc, shingle, count, np.zeros(len(doc), np.int64), np.ones(len(doc), np.int64))]
    low = 1
    while len(doc := doc[count > low]):
        shingle, count = shingle[count > low], count[count > low]
        block.append((doc, shingle, count, np.full(len(doc), low), np.full(len(doc), low)))
        low *= 2
    doc, shingle, count, start, length = (np.concatenate(c) for c in zip(*block))
    seed = _mixed(shingle ^ _mixed((start * 64 + np.log2(length).astype(np.int64)).astype(np.uint64)))
    number = np.zeros(len(doc), np.int64)
    when = _waits(seed, number, length)
    while True:
        early = when < times.max(axis=1)[doc]
        if not early.any():
            return times
        doc, shingle, count, start, length, seed, number, when = (
            a[early] for a in (doc, shingle, count, start, length, seed, number, when)
        )
        leaf = length == 1
        if leaf.all():
            slot = (_mixed(seed ^ _mixed(when.view(np.uint64))) % np.uint64(size)).astype(np.int64)
            np.minimum.at(times.reshape(-1), doc * size + slot, when)
            number = number + 1
            when = when + _waits(seed, number, length)
            continue
        at, inner = np.flatnonzero(leaf), np.flatnonzero(~leaf)
        slot = (_mixed(seed[at] ^ _mixed(when[at].view(np.uint64))) % np.uint64(size)).astype(np.int64)
        np.minimum.at(times.reshape(-1), doc[at] * size + slot, when[at])
        number[at] += 1
        when[at] += _waits(seed[at], number[at], length[at])
        half = length[inner] // 2
        coin = (_mixed(seed[inner] + np.uint64(1)) >> np.uint64(63)).astype(bool)
        halves = []
        for upper in (False, True):
            begin = start[inner] + half * upper
            own = _mixed(shingle[inner] ^ _mixed((begin * 64 + np.log2(half).astype(np.int64)).astype(np.uint64)))
            zero = np.zeros(len(inner), np.int64)
            time = np.where(coin == upper, when[inner], when[inner] + _waits(own, zero, half))
            halves.append((doc[inner], shingle[inner], count[inner], begin, half, own, zero, time))
        new = [np.concatenate(pair) for pair in zip(*halves)]
        seen = new[3] < new[2]
        old = (doc, shingle, count, start, length, seed, number, when)
        doc, shingle, count, start, length, seed, number, when = (
            np.concatenate([a[at], b[seen]]) for a, b in zip(old, new)
        )


def shingles(words: np.ndarray, lengths: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Document number and hash of each run of ``k`` words; a shorter document is one shingle."""
    words = words.view(np.uint64) if words.dtype != np.uint64 else words
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(ends, lengths) - np.arange(len(words))
    runs = np.zeros(len(words), np.uint64)
    for i in range(k):
        ahead = np.zeros(len(words), np.uint64)
        ahead[: max(len(words) - i, 0)] = words[i:]
        within = left > i
        runs = np.where(within, _mixed(runs ^ ahead), runs)
    first = left == np.repeat(lengths, lengths)
    whole = (left >= k) | (first & (np.repeat(lengths, lengths) < k))
    return doc[whole], runs[whole]


def bags(words: np.ndarray, lengths: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, shingle and count of the distinct shingles, in order of document and shingle."""
    doc, runs = shingles(words, lengths, k)
    order = np.lexsort((runs, doc))
    doc, runs = doc[order], runs[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (runs[1:] != runs[:-1])
    at = np.flatnonzero(new)
    return doc[at], runs[at], np.diff(np.append(at, len(doc)))


def word_hashes(text: Column) -> Column:
    """The words of a text, runs other than white space, as 64-bit numbers."""
    return F.transform(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]++"), F.lit(0)), lambda w: F.xxhash64(w))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values.astype(np.int64, copy=False).view(np.uint64), np.diff(offsets)


def _pieces(batch: pa.RecordBatch, column: int, most: int = BATCH_WORDS) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` words."""
    at = batch.column(column).offsets.to_numpy()
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def signature_table(docs: DataFrame, doc_id: str, text: str, k: int) -> DataFrame:
    """``id, mark, bag, n, bands, signature``: ``mark`` tells texts of one id apart, ``bag`` is a digest of the multiset."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text_of(text)).alias("mark"), word_hashes(text_of(text)).alias("words"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _pieces(whole, 2):
                words, lengths = _flat(batch.column(2))
                doc, runs, count = bags(words, lengths, k)
                n = batch.num_rows
                times = signatures(doc, runs, count, n)
                parts = _mixed(times.view(np.uint64))
                band = np.zeros((n, BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for row in range(BAND_ROWS):
                    band = _mixed(band ^ parts[:, row::BAND_ROWS])
                short = (parts >> np.uint64(32)).astype("<u4")
                ends = np.searchsorted(doc, np.arange(n + 1))
                pairs = np.column_stack([runs, count.astype(np.uint64)])
                digests = [hashlib.blake2b(pairs[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends, ends[1:])]
                sums = np.add.reduceat(np.append(count, 0), np.minimum(ends[:-1], len(count))) * (ends[1:] > ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(1),
                        pa.array(digests, pa.binary()),
                        pa.array(sums.astype(np.int64)),
                        pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * BANDS, pa.array(band.view(np.int64).reshape(-1))),
                        pa.array([row.tobytes() for row in short], pa.binary()),
                    ],
                    names=["id", "mark", "bag", "n", "bands", "signature"],
                )

    return rows.mapInArrow(signed, f"id {kind}, mark long, bag binary, n long, bands array<long>, signature binary")


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags, each sorted shingles and their counts."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


def _met(buckets: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``bag, n, signature, text`` of the bags in ``buckets``, each with one of its texts, stored.

    All rounds of comparison read this table. Documents are moved once for it,
    and most of those that met no other one are dropped before.
    """
    wanted = nodes.join(buckets.select(F.col("node").alias("bag")).distinct(), "bag")
    wanted = wanted.select("bag", "n", "signature", F.col("one.id").alias("__id"), F.col("one.mark").alias("__mark"))
    wanted = materialize(wanted, "wanted")
    texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text_of(text)).alias("mark"), text_of(text).alias("text"))
    texts = texts.where(maybe_in(wanted, "__mark")(F.col("mark")))
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark")))
    return materialize(texts.groupBy("bag", "n", "signature").agg(F.min("text").alias("text")), "met")


def _tested(pairs: DataFrame, met: DataFrame, k: int, similarity: float) -> DataFrame:
    """``a, b, linked`` for pairs ``a, b`` of bags: signatures first, then the multisets of one text of each bag."""
    sides = [
        met.select(F.col("bag").alias(s), F.col("signature").alias(f"s{s}"), F.col("n").alias(f"n{s}")) for s in ("a", "b")
    ]
    signed = pairs.join(sides[0], "a").join(sides[1], "b")
    least = similarity - SLACK

    def estimated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, COMPONENTS) for c in ("sa", "sb")
            )
            n = [batch.column(c).to_numpy() for c in ("na", "nb")]
            near = ((one == two).mean(axis=1) >= least) & (np.minimum(*n) >= similarity * np.maximum(*n))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near)], names=["a", "b", "near"])

    columns = signed.select("a", "b", "sa", "sb", "na", "nb")
    near = materialize(columns.mapInArrow(estimated, "a binary, b binary, near boolean"), "pairs")
    joined = near.where("near").join(met.select(F.col("bag").alias("a"), F.col("text").alias("ta")), "a")
    joined = joined.join(met.select(F.col("bag").alias("b"), F.col("text").alias("tb")), "b")
    joined = joined.select("a", "b", word_hashes(F.col("ta")).alias("wa"), word_hashes(F.col("tb")).alias("wb"))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = []
            for column in ("wa", "wb"):
                doc, runs, count = bags(*_flat(batch.column(column)), k)
                at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                both.append([(runs[i:j], count[i:j]) for i, j in zip(at, at[1:])])
            linked = [overlap(x, y) >= similarity for x, y in zip(*both)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])

    links = joined.mapInArrow(verified, "a binary, b binary, linked boolean")
    return links.unionByName(near.where("not near").select("a", "b", F.lit(False).alias("linked")))


def _linking(rows: pd.DataFrame, k: int, similarity: float) -> list[tuple[bytes, bytes]]:
    """Links between components among the rows, as few as join all that any links join.

    A shingle that occurs c times stands for c different elements, so the common
    part of two bags is the number of common elements; it is counted through the
    list of rows of each element.
    """
    node, part = rows["node"].tolist(), rows["component"].tolist()
    side = (rows["own"] == rows["i"]).to_numpy()
    words = [np.asarray(w, dtype=np.int64) for w in rows["words"]]
    lengths = np.array([len(w) for w in words])
    doc, runs, count = bags(np.concatenate(words).view(np.uint64), lengths, k)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    doc, element = np.repeat(doc, count), _mixed(np.repeat(runs, count) ^ _mixed(nth.astype(np.uint64)))
    _, element = np.unique(element, return_inverse=True)
    order = np.argsort(element, kind="stable")
    holders, held = doc[order], np.bincount(element)
    starts = np.cumsum(held) - held
    size = np.bincount(doc, minlength=len(node))
    first = np.searchsorted(doc, np.arange(len(node) + 1))
    above = {c: c for c in part}

    def name(c: bytes) -> bytes:
        while above[c] != c:
            above[c] = above[above[c]]
            c = above[c]
        return c

    links, apart = [], rows["i"].iloc[0] != rows["j"].iloc[0]
    for x in range(len(node)):
        own = element[first[x] : first[x + 1]]
        n = held[own]
        at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(holders[at], minlength=len(node))
        near = common >= similarity * (size[x] + size - common)
        near[: x + 1] = False
        if apart:
            near &= side != side[x]
        for y in np.flatnonzero(near):
            a, b = name(part[x]), name(part[y])
            if a != b:
                above[max(a, b)] = min(a, b)
                links.append((min(node[x], node[y]), max(node[x], node[y])))
    return links


def _crowd_links(members: DataFrame, met: DataFrame, k: int, similarity: float) -> DataFrame:
    """``a, b, linked`` that join what can be joined within each bucket of ``bucket, node, component``.

    Members are numbered over all buckets, those of a bucket and in it of a
    component next to each other, and cut into blocks by their numbers: no task
    holds a bucket. Each pair of blocks of a bucket that may have links is one
    call that returns fewer links than it has rows.
    """
    numbered, _ = number_rows(members, [F.col("bucket"), F.col("component"), F.col("node")], "place")
    rows = numbered.withColumn("own", F.floor((F.col("place") - 1) / CROWD_BLOCK).cast("long"))
    blocks = rows.groupBy("bucket", "own").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    blocks = materialize(blocks, "blocks")
    last = blocks.groupBy(F.col("bucket").alias("b")).agg(F.max("own").alias("last"))
    others = blocks.toDF("b", "j", "low2", "high2")
    pairs = blocks.join(last, F.col("bucket") == F.col("b")).drop("b").withColumnRenamed("own", "i")
    pairs = pairs.withColumn("to", F.explode(F.sequence("i", "last")))
    pairs = pairs.join(others, (F.col("bucket") == F.col("b")) & (F.col("to") == F.col("j")))
    pairs = pairs.where(F.least("low", "low2") < F.greatest("high", "high2"))
    sides = F.when(F.col("i") == F.col("j"), F.array("i")).otherwise(F.array("i", "j"))
    pairs = pairs.select("b", "i", "j", F.explode(sides).alias("side"))
    rows = rows.join(pairs, (F.col("bucket") == F.col("b")) & (F.col("own") == F.col("side")))
    rows = rows.join(met.select("bag", word_hashes(F.col("text")).alias("words")), F.col("node") == F.col("bag"))

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        links = _linking(rows, k, similarity)
        return pd.DataFrame({"a": [a for a, _ in links], "b": [b for _, b in links], "linked": True})

    rows = rows.select("bucket", "node", "component", "own", "i", "j", "words")
    return rows.groupBy("bucket", "i", "j").applyInPandas(linked, "a binary, b binary, linked boolean")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY
) -> DataFrame:
    """``doc_id, mark, n_shingles, n_copies, component_id, kept``, one row for each row in.

    Documents whose multisets of ``words``-word shingles have a weighted Jaccard
    similarity of at least ``similarity`` are linked; ``component_id`` is the
    least ``doc_id`` reachable by links and ``kept`` marks it. Equal multisets
    (``n_copies`` documents) are one node. A text of fewer words is one shingle;
    NULL and blank texts have none, link with nothing and are kept. ``mark`` is a
    hash of the text, which orders rows of one ``doc_id``; rows equal in both
    have equal results. A NULL ``doc_id`` names a component only if no other is there.
    """
    stored = materialize(signature_table(docs, doc_id, text, words), "signatures")
    full = stored.where("n > 0")
    # equal multisets have equal signatures: any of them will do
    nodes = full.groupBy("bag").agg(F.min(_name()).alias("one"), F.count("*").alias("copies"), *[F.any_value(c).alias(c) for c in ("n", "bands", "signature")])
    nodes = materialize(nodes, "nodes")
    banded = nodes.select("bag", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    buckets = banded.join(shared.select("band"), "band").select(F.col("band").alias("bucket"), F.col("bag").alias("node"), F.lit(True).alias("anchor"))
    buckets = materialize(buckets, "buckets")
    met = _met(buckets, nodes, docs, doc_id, text)
    linked = components_within(
        buckets,
        lambda pairs: _tested(pairs, met, words, similarity),
        lambda members: _crowd_links(members, met, words, similarity),
    )
    known = nodes.select("bag", "one", "copies")
    if linked is None:
        known = known.withColumn("component", F.col("bag"))
    else:
        known = known.join(linked.withColumnRenamed("id", "bag"), "bag", "left")
        known = known.withColumn("component", F.coalesce("component", "bag"))
    names = known.groupBy(F.col("component").alias("__component")).agg(F.min("one").alias("name"))
    known = materialize(known.join(names, F.col("component") == F.col("__component")).select(F.col("bag").alias("__bag"), "copies", "name"), "classes")
    out = stored.select("id", "mark", "bag", "n").join(known, (F.col("bag") == F.col("__bag")) & (F.col("n") > 0), "left")
    named = F.col("name").eqNullSafe(_name())
    return out.select(
        F.col("id").alias("doc_id"),
        "mark",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("copies")).otherwise(F.lit(1)).cast("long").alias("n_copies"),
        F.when(F.col("n") > 0, F.col("name.id")).otherwise(F.col("id")).alias("component_id"),
        F.when(F.col("n") > 0, named).otherwise(True).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows and columns of ``docs``, one row of each component; see ``near_duplicates``.

    Rows without shingles stay. Of rows equal in ``doc_id`` and text one stays.
    """
    decided = near_duplicates(docs, doc_id, text, **options)
    decided = decided.groupBy(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).agg(
        F.min("kept").alias("__kept"), F.sum(F.lit(1)).alias("__rows"), F.max("n_shingles").alias("__n")
    )
    rows = docs.select(whole_row(docs).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text_of(text)).alias("mark"))
    rows = rows.join(decided, F.col("id").eqNullSafe(F.col("__id")) & (F.col("mark") == F.col("__mark"))).where("__kept")
    once = (F.col("__rows") == 1) | (F.col("__n") == 0)
    return rows.where(once).select("row.*").unionByName(rows.where(~once).dropDuplicates(["id", "mark"]).select("row.*"))
