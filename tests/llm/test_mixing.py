from collections import Counter

import pytest
from pyspark.sql import functions as F

from recuento.llm.mixing import mix, mix_plan, source_targets, word_count


@pytest.fixture
def docs(spark):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), ["a", "b", "c", None, "é"][min(i % 9, 4)], i) for i in range(400)]
    rows += [(None, "x y", "a", 0), (7, "same row", "a", 1), (7, "same row", "a", 1), (8, None, "b", 2), (9, "", "", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 1, 100), ("b", 1, 1000), ("c", 1, 1000), (None, 1, 10), ("z", 1, 0)], "source string, size long, n long")
    found = {r.source: (r.source_size, r.target) for r in source_targets(sizes).collect()}
    assert found["a"] == (100, 200.0) and found[None] == (10, 20.0) and found["z"] == (0, 0.0)
    assert sum(t for _, t in found.values()) == pytest.approx(1.5 * 2110)
    # b has weight 2, c weight 1; b stops at twice its size, and c takes the rest
    assert found["b"][1] == pytest.approx(min(2000, 2 / 3 * (3165 - 220))) and found["c"][1] <= 2000


def test_mix_comes_near_its_targets(docs):
    rows = mix_plan(docs).collect()
    assert len(rows) == docs.count()
    taken, target, size = Counter(), {}, {}
    for r in rows:
        taken[r.source_size] += r.taken
        target[r.source_size], size[r.source_size] = r.target, r.source_size
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
    assert all(abs(taken[k] - target[k]) <= 25 for k in target)
    assert sorted(map(str, rows)) == sorted(map(str, mix_plan(docs.repartition(7)).collect()))


def test_rows_come_out_as_often_as_planned(docs):
    plan = mix_plan(docs)
    assert mix(docs).count() == sum(r.copies for r in plan.collect())
    assert mix(docs).columns == docs.columns


def test_words_and_empty_table(spark, docs):
    df = spark.createDataFrame([("a b c\td\x0be ",), ("",), (" \n",)], "t string")
    assert [r[0] for r in df.select(word_count(df.t)).collect()] == [4, 0, 0]
    assert mix_plan(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0


def test_documents_of_one_size_with_scattered_ids(spark):
    rows = [(i * 1_000_003, "w w w", "a" if i % 3 else None) for i in range(3000)] + [(None, "w", "b"), (-5, None, "b"), (7, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.copies for r in mix_plan(docs).collect()}
    near = mix_plan(docs.withColumn("doc_id", F.floor(F.col("doc_id") / 1_000_003))).collect()
    assert len(got) == 3003
    # the order of the ids decides, not the gaps between them
    assert all(got[r.doc_id * 1_000_003] == r.copies for r in near if r.size == 3)
    for source_size, ids in ((6000, [i for i in range(3000) if i % 3]), (3000, range(0, 3000, 3))):
        target = next(r.target for r in near if r.source_size == source_size)
        assert abs(sum(got[i * 1_000_003] * 3 for i in ids) - target) <= 3
