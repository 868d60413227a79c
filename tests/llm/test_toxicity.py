import random
import zlib

import numpy as np
import pytest

from recuento.llm import toxicity as T


def corpus(n, seed=1):
    rng = random.Random(seed)
    plain = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "ore", "ist", "ully", "eme")]
    bad = ["vileness", "vilely", "vilest", "grotty"]
    rows = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 300))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(0)
    scores, moves, start = rng.normal(size=(6, 1)), rng.normal(size=(2, 2)), 0.3
    weight, on = np.zeros((6, 2)), 0.0
    for path in np.ndindex(*[2] * 6):
        s = start * path[0] + sum(scores[t, 0] for t in range(6) if path[t]) + sum(moves[path[t], path[t + 1]] for t in range(5))
        for t in range(6):
            weight[t, path[t]] += np.exp(s)
        on += np.exp(s)
    odds = T.marginal_odds(np.exp(scores), np.ones((6, 1), bool), start, moves)[2]
    assert odds[:, 0] == pytest.approx(weight[:, 1] / weight[:, 0])


def test_sequences_of_a_batch_do_not_touch():
    field = T.Field({"=a": 1.0, "=b": -1.0}, -0.5, ((0.2, -0.3), (0.1, 0.4)), (0.0, 1.0, 0.0))
    words = T.WordScores(field.weights)
    texts = ["a b a", "", "b " * 300, "a"]
    together = list(T.tag(texts, field, words))
    alone = [list(T.tag([t], field, words))[0] for t in texts]
    assert [len(o) for o in together] == [3, 0, 300, 1]
    assert all(a == pytest.approx(b) for a, b in zip(together, alone))


def test_scores_do_not_depend_on_any_cut():
    rng = np.random.default_rng(3)
    names = [f"w{i}" for i in range(30)]
    for moves in (((0.0, 0.0), (0.0, 0.0)), ((3.0, -3.0), (-4.0, 4.0)), ((-2.0, 5.0), (1.0, -6.0))):
        field = T.Field({f"={w}": float(rng.normal(0, 4)) for w in names}, -1.5, moves, (0.0, 1.0, 0.0))
        words = T.WordScores(field.weights)
        texts = [" ".join(rng.choice(names, n)) for n in (1, 127, 128, 129, 0, 256, 257, 1000, 5, 3000)]
        for text, found in zip(texts, T.tag(texts, field, words)):
            odds = np.array([words[w] for w in text.split()])[:, None]
            if len(odds):
                whole = T.marginal_odds(odds, np.ones(odds.shape, bool), field.start, moves)[2][:, 0]
                assert found == pytest.approx(whole, rel=1e-9)


def test_held_out_documents(spark):
    rows = corpus(1500)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "grotty", "x"), (5000, None, "x"), (5001, "", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (7, None), (6, 0)], "doc_id long, toxic int")
    field = T.learn(docs, labels)
    found = {r.doc_id: r for r in T.score(docs, field).collect()}
    held_out = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = np.mean([found[i].predicted == y for i, y in held_out])
    assert len(held_out) > 200 and right > 0.98
    assert found[5000].predicted == found[5001].predicted == 0 and found[None].predicted == 1
    texts = {i: t for i, t, _ in rows}
    for i in range(0, 50, 5):
        assert all(texts[i][s.start : s.end].startswith(("vil", "grotty")) for s in found[i].spans) and found[i].spans
    clean = T.without_toxic(docs, field)
    assert clean.columns == docs.columns and clean.where("doc_id = 5000").count() == 1 and clean.where("doc_id = 0").count() == 0


def test_labels_of_one_kind_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert [r.predicted for r in T.score(docs, T.learn(docs, labels)).collect()] == [0, 0]
    field = T.learn(docs.limit(0), labels.limit(0))
    assert T.score(docs.limit(0), field).count() == 0
