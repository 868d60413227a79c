import random

import numpy as np
import pytest

import plain
from recuento.llm import bagminhash, graph
from recuento.llm.bagminhash import near_duplicates, signatures, without_near_duplicates


def test_signatures_estimate_the_weighted_similarity():
    rng, off = np.random.default_rng(1), []
    for most in [2, 4, 20, 300] * 10:
        n = rng.integers(2, 60)
        items = rng.integers(0, 2**63, n).astype(np.uint64)
        a = rng.integers(0, most, n) + (np.arange(n) == 0)
        b = np.where(rng.random(n) < 0.6, a, rng.integers(0, 20, n))
        doc = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        if not b.any():
            continue
        times = signatures(doc, np.concatenate([items[a > 0], items[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 2000)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        off.append(((times[0] == times[1]).mean() - true) / max(np.sqrt(true * (1 - true) / 2000), 1e-3))
    assert abs(np.mean(off)) < 0.5 and np.std(off) < 1.5


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.choice([3, 5, 8, 60, 120]))] for _ in range(25)]

    def varied(base):
        base = list(base)
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            base[rng.randrange(len(base))] = rng.choice(words)
        return " ".join(base * (rng.randint(2, 12) if rng.random() < 0.2 else 1))

    texts = [varied(rng.choice(bases)) for _ in range(150)]
    texts += [None, "", " \n ", "a", "a", " ".join(bases[3] * 40), " ".join(bases[3] * 41), "x" * 50_000]
    return list(enumerate(texts))


def test_groups_are_those_of_all_pairs(spark, rows):
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, bag string").repartition(6)
    found = {r.doc_id: r for r in near_duplicates(df).collect()}
    wanted = plain.near_groups(rows)
    assert {i: r.component_id for i, r in found.items()} == wanted
    assert {i: r.n_shingles for i, r in found.items()} == {i: sum(plain.bag(t).values()) for i, t in rows}
    assert all(r.kept == (wanted[i] == i) for i, r in found.items())
    kept = without_near_duplicates(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(wanted.values())) and kept.columns == df.columns


def test_null_ids_and_repeated_rows(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(None, text), (3, text), (3, text), (4, "other words"), (None, None)], "doc_id long, text string")
    found = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(df).collect())
    assert found == [("3", "3", True), ("3", "3", True), ("4", "4", True), ("None", "3", False), ("None", "None", True)]
    assert sorted(str(r.doc_id) for r in without_near_duplicates(df).collect()) == ["3", "4", "None"]
    assert near_duplicates(df.limit(0)).count() == 0


def test_a_crowd_of_copies_that_are_not_all_alike(spark, monkeypatch):
    """Many edits of one text: buckets with many pairs and few links, compared in several small blocks."""
    monkeypatch.setattr(bagminhash, "CROWD_BLOCK", 16)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(80)]

    def edited():
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        return " ".join(words * rng.choice([1, 1, 1, 2]))

    rows = [(i, edited()) for i in range(160)]
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == plain.near_groups(rows) and 1 < len(set(found.values())) < 160


def test_a_bucket_whose_members_are_no_copies_of_each_other(spark):
    """One bucket of 60 nodes, linked only in a chain: the rounds with one anchor leave much, and the rest is compared."""
    asked = []

    def test(pairs):
        asked.append(pairs.count())
        return pairs.selectExpr("a", "b", "b - a = 1 AS linked")

    buckets = spark.range(60).selectExpr("7 AS bucket", "id AS node", "true AS anchor")
    found = graph.components_within(buckets, test)
    assert {r.component for r in found.collect()} == {0} and found.count() == 60
    assert asked[0] == 59 and sum(asked) <= 60 * 59 / 2


def test_components_of_long_chains(spark):
    links = spark.range(300).selectExpr("id + 1 AS a", "id AS b").unionByName(spark.createDataFrame([(900, 950), (950, 900)], "a long, b long"))
    found = {r.id: r.component for r in graph.components(links).collect()}
    assert found == {i: 0 for i in range(301)} | {900: 900, 950: 900}


def test_parameters():
    assert bagminhash.WORDS == 5 and bagminhash.SIMILARITY == 0.8


def test_documents_are_read_for_signatures_and_once_for_texts(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    words = [[rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(60)] for _ in range(30)]
    texts = [" ".join(w) for w in words] + [" ".join([*w[: 57 - n % 2], "x", str(n)]) for n, w in enumerate(words * 3)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs, read = spark.read.parquet(str(tmp_path / "docs")), []

    def storing(module):
        store = module.materialize

        def call(df, name="table"):
            if any(str(tmp_path) in file for file in df.inputFiles()):
                read.append(name)
            return store(df, name)

        return call

    for module in (bagminhash, graph):
        monkeypatch.setattr(module, "materialize", storing(module))
    found = near_duplicates(docs).collect()
    assert sum(r.kept for r in found) < len(texts)
    assert read == ["signatures", "met"]
