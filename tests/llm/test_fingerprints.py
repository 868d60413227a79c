import hashlib
import re

import pytest
from pyspark.sql import functions as F

from recuento.llm import winnowing as W

TEXTS = [
    "",
    "a b c",
    "a b",
    "x " * 30,
    "one two three four five six seven eight nine ten eleven twelve thirteen one two three four five six",
    "z" * 300,
    None,
    "q w e r t y u i o p a s d f q w e r é日 t",
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, edited string")


def test_rightmost_least_hash_of_each_window(spark, docs):
    words = [(i * 3, re.findall(r"[^\x20\x09-\x0D]{1,8}", t or "")) for i, t in enumerate(TEXTS)]
    hashed = spark.createDataFrame(words, "i long, w array<string>").select("i", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    grams = [
        (r.i, j, [*r.h[j : j + W.GRAM], *[0] * W.GRAM][: W.GRAM]) for r in hashed.collect() if r.h for j in range(max(1, len(r.h) - W.GRAM + 1))
    ]
    values = spark.createDataFrame(grams, "i long, j int, g array<long>")
    values = values.select("i", "j", F.xxhash64(*[F.get("g", F.lit(k)) for k in range(W.GRAM)]).alias("v"))
    by_doc = {}
    for r in values.orderBy("i", "j").collect():
        by_doc.setdefault(r.i, []).append(r.v >> 24)
    wanted = {}
    for i, _ in words:
        v, chosen = by_doc.get(i, []), []
        for a in range(max(1, len(v) - W.WINDOW + 1)) if v else []:
            window = v[a : a + W.WINDOW]
            place = a + max(k for k in range(len(window)) if window[k] == min(window))
            if (min(window), place) not in chosen:
                chosen.append((min(window), place))
        wanted[i] = chosen
    assert {r.doc_id: [tuple(x) for x in r.fingerprint] for r in W.fingerprints(docs).collect()} == wanted


def test_edited_texts(docs):
    order = [(i * 3, t or "") for i, t in reversed(list(enumerate(TEXTS)))]
    wanted = {}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        wanted[i] = (len(text), text[: len(text) - half] + after[:half])
    rows = W.compare_with_edits(docs.repartition(3)).collect()
    assert {r.doc_id: (r.n_chars, r.edited) for r in rows} == wanted
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if (dict(order)[r.doc_id]) == r.edited:
            assert r.near_edited == 1 and r.fingerprint == r.edited_fingerprint


def test_likeness_of_halves(spark):
    words = [hashlib.md5(str(i).encode()).hexdigest()[:6] for i in range(2000)]
    df = spark.createDataFrame([(1, " ".join(words[:1000])), (2, " ".join(words[1000:]))], "doc_id long, text string")
    rows = W.compare_with_edits(df).collect()
    assert all(0.4 < r.near_edited < 0.6 and r.near_next == 0 for r in rows)


def test_repeated_rows_null_ids_and_small_tables(spark, docs):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "f g h i"), (2, "j k l m n o")], "doc_id long, text string")
    rows = sorted(map(str, W.compare_with_edits(df).collect()))
    assert len(rows) == 4 and len(set(rows)) == 3
    assert W.compare_with_edits(docs.limit(0)).count() == 0
    assert W.compare_with_edits(docs.where("doc_id = 9")).collect()[0].near_next == 1
    plan = W.compare_with_edits(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
