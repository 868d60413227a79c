import random

import pytest
from pyspark.sql import functions as F

import plain
from recuento.llm import line_dedup
from recuento.llm.bit_table import maybe_in
from recuento.llm.graph import components_within
from recuento.llm.line_dedup import _maybe_near, _without_common_ends, drop_repeated_lines, dropped_lines, edit_distance, keys_of, near_traits, segment_keys, traits


def varied(rng, line, most):
    line = list(line)
    for _ in range(rng.randint(0, most)):
        place, what = rng.randrange(len(line) + 1), rng.random()
        if what < 0.3 and line:
            line.pop(min(place, len(line) - 1))
        elif what < 0.6:
            line.insert(place, rng.choice("xyé"))
        elif line:
            line[min(place, len(line) - 1)] = rng.choice("xy日")
    return "".join(line)


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcé日") for _ in range(rng.randint(0, 40))) for _ in range(800)]
    return spark.createDataFrame([(i, a, varied(rng, a, 4)) for i, a in enumerate(lines)], "i int, a string, b string")


@pytest.mark.parametrize("most", [1, 2, 3])
def test_edit_distance(pairs, most):
    found = pairs.select(F.levenshtein("a", "b").alias("true"), edit_distance("a", "b", most).alias("found")).collect()
    assert all(min(r.true, most + 1) == min(r.found, most + 1) for r in found)


def test_cutting_common_ends_keeps_the_distance(pairs):
    both = pairs.withColumn("true", F.levenshtein("a", "b"))
    assert _without_common_ends(both, "a", "b").where(F.levenshtein("a", "b") != F.col("true")).count() == 0


@pytest.mark.parametrize("most", [1, 2])
def test_lines_within_the_edits_share_a_key(pairs, most):
    near = pairs.where(F.levenshtein("a", "b") <= most).where("char_length(a) > 8 and char_length(b) > 8")
    a = near.select("i", F.explode(segment_keys(F.col("a"), most)).alias("k")).select("i", F.col("k.key").alias("key"), F.col("k.anchor").alias("x"))
    b = near.select("i", F.explode(segment_keys(F.col("b"), most)).alias("k")).select("i", F.col("k.key").alias("key"), F.col("k.anchor").alias("y"))
    assert a.join(b, ["i", "key"]).where("x or y").select("i").distinct().count() == near.count()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(18, 40))) for _ in range(20)]
    line = lambda: rng.choice(["", "x", "ab", "  ", varied(rng, rng.choice(base), 3), varied(rng, base[0], 2)])
    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 9)))) for i in range(60)]
    return rows + [(60, None), (61, ""), (62, "a b" * 3000), (63, "\n\n")]


def test_dropped_lines(spark, texts):
    df = spark.createDataFrame([(i, t, "row") for i, t in texts], "doc_id long, text string, line string").repartition(5)
    wanted = plain.dropped_lines(texts)
    assert {r.id: set(r.dropped) for r in dropped_lines(df).collect()} == wanted
    for r in drop_repeated_lines(df).collect():
        text = dict(texts)[r.row.doc_id]
        kept = [line for n, line in enumerate((text or "").split("\n")) if n not in wanted.get(r.row.doc_id, ())]
        assert r.clean == ("\n".join(kept) if r.row.doc_id in wanted else text)
        assert r.n_lines == len((text or "").split("\n")) and r.row.line == "row"


def test_two_edits(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.id: set(r.dropped) for r in dropped_lines(df, edits=2).collect()} == plain.dropped_lines(texts, edits=2)


def test_longer_lines_may_differ_by_more_edits(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (40, 49, 53, 75, 99, 103, 130, 260)]
    lines = base + [varied(rng, line, 5) for line in base for _ in range(4)] + [base[7][5:], base[7][4:], "xy" + base[6][:60] + "z" + base[6][61:-1]]
    edits = lambda a, b: 4 if min(len(a), len(b)) >= 100 else 2 if min(len(a), len(b)) >= 50 else 1
    groups = plain.Groups(range(len(lines)))
    for x, a in enumerate(lines):
        for y, b in enumerate(lines[:x]):
            if abs(len(a) - len(b)) <= 4 and plain.edit_distance(a, b) <= edits(a, b):
                groups.link(x, y)
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    assert {r.id for r in dropped_lines(df).collect()} == {x for x in range(len(lines)) if groups.name(x) != x}


def test_null_ids_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "same"), (1, "same"), (1, "same"), (2, "other")], "doc_id long, text string")
    found = sorted((str(r.row.doc_id), r.clean) for r in drop_repeated_lines(df).collect())
    assert found == [("1", ""), ("1", ""), ("2", "other"), ("None", "same")]
    assert drop_repeated_lines(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    text = drop_repeated_lines(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_parameters():
    assert line_dedup.EDITS >= 1


@pytest.mark.parametrize("most", [1, 2, 4])
def test_the_quick_tests_pass_all_pairs_within_the_edits(pairs, most):
    by_traits = near_traits(F.col("ra"), F.col("rb"), F.lit(most))
    both = pairs.withColumns({"ra": traits("a"), "rb": traits("b"), "allowed": F.lit(most)})
    near = both.where(F.levenshtein("a", "b") <= most)
    assert near.where(~_maybe_near("a", "b", "allowed", most)).count() == 0
    assert near.where(~by_traits).count() == 0
    far = both.where("char_length(a) > 20").withColumn("b", F.reverse("a"))
    assert far.where(_maybe_near("a", "b", "allowed", most)).count() < far.count() / 10


def test_many_lines_under_one_key(spark):
    # 60 lines share their first half and differ by a word, a few of them by less than the edits
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(9))
    lines = ["the passage that all of these lines begin with " + word() + " goes on until here" for _ in range(60)]
    lines += [varied(rng, line, 2) for line in lines[:6]]
    rows = list(enumerate(lines))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.id: set(r.dropped) for r in dropped_lines(df).collect()} == plain.dropped_lines(rows)


def test_as_many_keys_by_length_as_by_segments(spark):
    lines = [(i, "é日" * (n // 2) + "".join(map(str, range(n)))[: n - n // 2 * 2]) for i, n in enumerate((20, 49, 99, 130))]
    df = spark.createDataFrame(lines, "h long, line string")
    for edits in (1, 2, 4):
        for anchors in (True, False):
            found = keys_of(df, [(0, edits)], anchors).groupBy("h").agg(F.sort_array(F.collect_list("key")).alias("k"))
            keys = df.select("h", F.explode(segment_keys(F.col("line"), edits)).alias("k"))
            plain_way = keys.where("k.anchor" if anchors else "not k.anchor").groupBy("h").agg(F.count("*").alias("n"))
            counts = {r.h: r.n for r in plain_way.collect()}
            assert {r.h: len(r.k) for r in found.collect()} == counts


def test_pairs_of_unlike_lines_under_one_key_never_become_rows(spark, monkeypatch):
    # the same characters in another order: counts of characters do not tell these lines apart
    rng = random.Random(6)
    base = "a passage of more than one hundred characters that very many lines share, with a word of its own in each of them: "
    lines = [base + "".join(rng.sample("abcdefghijklmnop", 16)) for _ in range(120)]
    lines += [varied(rng, line, 3) for line in lines[:9]]
    rows = list(enumerate(lines))
    counted = []

    def within(buckets, test, *others, **named):
        def counting(pairs):
            counted.append(pairs.count())
            return test(pairs)

        return components_within(buckets, counting, *others, **named)

    monkeypatch.setattr(line_dedup, "components_within", within)
    monkeypatch.setattr(line_dedup, "CROWD_BLOCK", 20, raising=False)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.id: set(r.dropped) for r in dropped_lines(df).collect()}
    groups = plain.Groups(range(len(lines)))
    for x, a in enumerate(lines):
        for y in range(x):
            if plain.edit_distance(a, lines[y]) <= 4:
                groups.link(x, y)
    assert found == {x: {0} for x in range(len(lines)) if groups.name(x) != x}
    assert sum(counted) < 10 * len(lines) < len(lines) ** 2 / 4


def test_texts_are_moved_once_and_split_once(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    plan = drop_repeated_lines(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "get(split(" not in plan
    join = next(line for line in plan.split("\n") if "Join LeftOuter" in line)
    sides = plan[plan.index(join) :].split("\n")[1]
    assert "Project" in sides and " AS text#" not in sides


@pytest.mark.parametrize("bits", [1, 2])
def test_the_bit_table_has_all_its_numbers_and_few_others(spark, bits):
    held, others = spark.range(60).select(F.xxhash64("id").alias("k")), spark.range(1000, 4000).select(F.xxhash64("id").alias("k"))
    maybe = maybe_in(held, "k", 16, bits)
    assert held.where(maybe(F.col("k"))).count() == 60
    assert others.where(maybe(F.col("k"))).count() < {1: 300, 2: 120}[bits]
