import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from recuento.llm.trie import branching_trie, ends_digest, prefix_trie

LOG = "conv_id long, turn long, role string, text string, depth string, p string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [t[2:] for t in sorted(ts)] for c, ts in talks.items()}
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = talks.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(talks):
    members = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        inner = {p[:-1] for p in below if p}
        ends = sorted(c for c in convs if len(talks[c]) == len(path))
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs),
            sum(len(p) == len(path) + 1 for p in below), sum(p not in inner for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(nodes, ends):
    rows = nodes.join(ends_digest(ends), ["depth", "p", "q"], "left")
    empty = F.sha2(F.lit(""), 256)
    return sorted((tuple(r) for r in rows.withColumn("ends_sha256", F.coalesce("ends_sha256", empty)).select(*NAMES).collect()), key=str)


def log(n, seed=1):
    """Conversations that branch late, early, never and by a third of all."""
    draw, rows = random.Random(seed), []
    for c in range(n):
        talk = [("user", f"common {k}") for k in range(draw.choice([0, 1, 3, 4, 5, 8, 9]))] if c % 3 else [("user", "same"), ("assistant", "täxt")] * 5
        talk += [(draw.choice(["user", None]), draw.choice(["a", "b", "", None, "ü" * 9])) for _ in range(draw.randrange(4))]
        if c % 7 == 6:
            talk += [("user", f"t{k}") for k in range(30)]
        rows += [(c * 2 if c % 11 else c, turn if draw.random() < 0.97 else None, *t) for turn, t in enumerate(talk)]
    return rows + [(None, 1, "user", "lost"), (1000003, None, None, None)]


@pytest.mark.parametrize("block", [1, 4, 7])
def test_equals_brute_force(spark, block):
    rows = log(90)
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], LOG).repartition(3)
    assert found(*branching_trie(df, block=block)) == brute(rebuilt(rows))


def test_conversations_without_turns_and_copies(spark):
    talks = {5: [], 9: [], 11: [("u", "a")] * 6, 10: [("u", "a")] * 6, 12: [("u", "a")] * 4, 13: [("u", "a")] * 5 + [("u", "b")]}
    turns = [(c, d, *t) for c, ts in talks.items() for d, t in enumerate(ts, 1)]
    turns = spark.createDataFrame(turns, "conv long, depth long, role string, text string")
    convs = spark.createDataFrame([(c,) for c in talks], "conv long")
    assert found(*prefix_trie(turns, convs)) == brute(talks)


def test_long_conversation(spark):
    talks = {1: [("u", str(k)) for k in range(300)], 2: [("u", str(k)) for k in range(257)] + [("v", "x" * 10000)]}
    turns = spark.createDataFrame([(c, d, *t) for c, ts in talks.items() for d, t in enumerate(ts, 1)], "conv long, depth long, role string, text string")
    assert found(*prefix_trie(turns, turns.select("conv").distinct())) == brute(talks)


def test_ends_are_hashed_in_pieces(spark):
    ids = [7 * k - 40000 for k in range(20000)]
    ends = spark.createDataFrame([(1, 2, 3, c) for c in ids], "depth long, p long, q long, conv long").repartition(5)
    (row,) = ends_digest(ends).collect()
    assert row.ends_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_empty_log(spark):
    nodes, ends = branching_trie(spark.createDataFrame([], LOG))
    assert nodes.count() == 0 and ends_digest(ends).count() == 0
