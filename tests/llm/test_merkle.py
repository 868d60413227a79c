import hashlib

import pytest
from pyspark.sql import functions as F

from recuento.llm.merkle import HEIGHT, FANOUT, address, build_manifest, fold, leaf_digest, proof_digest, tree_size

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, leaf string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n_chars = row[:5]
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def ways(digests):
    """The root, and for each leaf its steps of place and siblings."""
    steps, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k - k % 3 : k - k % 3 + 3]
            steps[i].append((k % 3, run[: k % 3] + run[k % 3 + 1 :]))
            at[i] = k // 3
        level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
    return level[0], steps


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: ways([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, above = ways([trees[s][0] for s in names])
    out = []
    for s, way in zip(names, above):
        for x, steps in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            out.append((x[3], x[2], trees[s][0], root, sha("".join(d for _, others in steps + way for d in others))))
    return sorted(out, key=str)


def rows_of(sizes):
    rows = [(k * 7 % 10007, f"text {k}\n", "en", s, k, "x", "y") for s, n in sizes.items() for k in range(n)]
    return rows


@pytest.mark.parametrize(
    "sizes",
    [
        {"a": 1}, {"a": 3}, {"a": 4, "b": 1}, {"a": 81}, {"a": 82, None: 2, "": 5}, {"a": 83, "é": 27, "z": 28, "Z": 9, "~": 10},
        {"big": 7000, "b": 244}, {f"s{k}": 1 + k % 3 for k in range(100)},
    ],
    ids=str,
)
def test_equals_brute_force(spark, sizes):
    rows = rows_of(sizes)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    proofs = build_manifest(df).proofs()
    got = proofs.select("doc_id", "leaf", "subroot", "root", proof_digest("steps").alias("d"), fold(F.col("leaf"), "steps").alias("f")).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == brute(rows)
    assert {r.f for r in got} == {got[0].root}


def test_odd_rows(spark):
    rows = [(None, None, None, None, None, "x", "y"), (1, "", "", "", 0, "x", "y"), (1, None, "", "", 0, "x", "y"), (2, "a", "en", "s", 1, "x", "y")]
    rows += [(2, "a", "en", "s", 1, "x", "y")] * 3 + [(2, "b", "en", "s", 1, "x", "y"), (None, "c", "en", "s", None, "x", "y"), (3, "ü" * 100000, "en", "s", 9, "x", "y")]
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    got = build_manifest(df).proofs().select("doc_id", "leaf", "subroot", "root", proof_digest("steps")).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute(rows)
    assert build_manifest(df.limit(0)).proofs().count() == 0


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    df = spark.createDataFrame(rows_of({"a": 200, "b": 30}), DOCS)
    other = leaf_digest([F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    proofs = build_manifest(df, other={"changed": other}).proofs()
    assert proofs.where(fold(F.col("changed"), "steps") == F.col("root")).count() == 0
    assert proofs.where(fold(F.col("leaf"), "steps") == F.col("root")).count() == 230


def test_addresses_are_a_layout_of_halves():
    for levels in range(1, HEIGHT + 4):
        places = [address(levels, d, i) for d in range(levels) for i in range(FANOUT**d)]
        assert sorted(places) == list(range(tree_size(levels)))
    # four levels: the upper two, then each lower pair of levels in one stretch
    assert [address(4, 0, 0), address(4, 1, 2), address(4, 2, 0), address(4, 3, 2), address(4, 2, 1)] == [0, 3, 4, 7, 8]


def test_addresses_of_columns(spark):
    df = spark.range(27).select(F.col("id").cast("int").alias("i"))
    got = [r[0] for r in df.orderBy("i").select(address(5, 3, F.col("i"))).collect()]
    assert got == [address(5, 3, i) for i in range(27)]


def test_stored_subtrees(spark):
    manifest = build_manifest(spark.createDataFrame(rows_of({"a": 100}), DOCS))
    first, second = manifest.documents
    assert sorted((r.block, r.height, len(r.nodes), len(r.entries)) for r in first.collect()) == [(0, 4, 121, 81), (1, 4, 121, 19)]
    assert [(r.height, len(r.nodes)) for r in second.collect()] == [(1, 4)]
