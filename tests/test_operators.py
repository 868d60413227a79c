import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recuento.functions.categories import KEEP
from recuento.operators import columns, counting, dictionary, joins, profiling, ranking, reshape, shares, spatial


def test_strict_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert columns.select_strict(df, ["c", "a"]).columns == ["c", "a"]
    assert columns.drop_strict(df, ["b"]).columns == ["a", "c"]
    assert columns.rename(df, {"x": "a"}).columns == ["x", "b", "c"]
    for call in (
        lambda: columns.select_strict(df, ["nope"]),
        lambda: columns.drop_strict(df, ["nope"]),
        lambda: columns.rename(df, {"x": "nope"}),
        lambda: columns.cast_text(df, ["nope"]),
    ):
        with pytest.raises(ValueError, match="nope"):
            call()


def test_stages_see_earlier_stages_only(spark):
    df = spark.createDataFrame([("a/b",)], "x string")
    changed = F.replace(F.col("x"), F.lit("/"), F.lit("-"))
    assert columns.mutate(df, {"x": changed}, {"y": F.col("x")}).first().y == "a-b"
    assert columns.mutate(df, {"x": changed, "y": F.col("x")}).first().y == "a/b"


def test_clean_names(spark):
    raw = ["ID Persona", "Año de desaparición", "claveEntidad", "% total", "# casos", "2021", "a b", "a-b", "A—O", "¿?"]
    df = spark.createDataFrame([tuple(range(len(raw)))], [f"c{i}" for i in range(len(raw))]).toDF(*raw)
    assert columns.clean_names(df).columns == [
        "id_persona",
        "ano_de_desaparicion",
        "clave_entidad",
        "percent_total",
        "number_casos",
        "x2021",
        "a_b",
        "a_b_2",
        "a_o",
        "x",
    ]


def test_lower_touches_text_only(spark):
    df = spark.createDataFrame([("ÁRBOL", 1)], "t string, n int")
    assert tuple(columns.lower_text_columns(df).first()) == ("árbol", 1)


VOCABULARY = [
    ("campo", "a", "segunda", 2),
    ("campo", "a", "primera", 1),
    ("campo", "b", "otra", 1),
    ("campo", "b", "otra", 1),
    ("campo", "MAYÚSCULA", "nunca", 1),
    ("campo", "con espacio ", "nunca", 1),
    ("ajeno", "c", "nunca", 1),
]


@pytest.mark.parametrize("default, last", [(KEEP, "c"), (None, None), ("resto", "resto")])
def test_dictionary_recode(spark, default, last):
    vocabulary = spark.createDataFrame(VOCABULARY, "field string, raw string, canonical string, priority int")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "mayúscula"), (5, None)], "id int, campo string")
    found = dict(tuple(r) for r in dictionary.recode_dictionary(df, vocabulary, {"campo": default}).collect())
    assert len(found) == 5
    assert (found[1], found[2], found[3]) == ("primera", "otra", last)
    assert found[4] == {"c": "mayúscula"}.get(last, last)
    assert found[5] == (None if default in (KEEP, None) else default)


def test_recode_twice_changes_nothing_more(spark, rows):
    vocabulary = spark.createDataFrame(VOCABULARY, "field string, raw string, canonical string, priority int")
    df = spark.createDataFrame([("a",), ("b",), ("z",)], "campo string")
    once = dictionary.recode_dictionary(df, vocabulary, ["campo"])
    assert rows(once) == rows(dictionary.recode_dictionary(once, vocabulary, ["campo"]))


def test_lookup_join_and_null_keys(spark, rows):
    left = spark.createDataFrame([(1, "x", "y"), (2, None, "y"), (3, "q", "q")], "id int, a string, b string")
    right = spark.createDataFrame([("x", "y", 10), (None, "y", 20)], "a string, b string, v int")
    assert rows(joins.lookup_join(left, right, ["a", "b"]), "id", "v") == [(1, 10), (2, 20), (3, None)]
    never = joins.lookup_join(left, right, ["a", "b"], na_matches="never")
    assert rows(never, "id", "v") == [(1, 10), (2, None), (3, None)]
    assert rows(joins.natural_left_join(left, right), "id", "v") == [(1, 10), (2, 20), (3, None)]
    other = joins.lookup_join(left, right.toDF("k", "l", "v"), {"a": "k", "b": "l"})
    assert other.columns == ["id", "a", "b", "v"]


def test_lookup_join_refuses_clashes_and_duplicates(spark):
    left = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError, match="v"):
        joins.lookup_join(left, left, ["k"])
    with pytest.raises(ValueError, match="several rows"):
        joins.assert_unique(spark.createDataFrame([(None,), (None,)], "k int"), ["k"])
    assert joins.assert_unique(left, ["k"]) is left


def test_sums_and_counts(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", None), (None, 2)], "k string, x int")
    sums = df.groupBy("k").agg(
        counting.sum_or_zero(F.col("x")).alias("zero"),
        counting.sum_strict(F.col("x")).alias("strict"),
        counting.mean_known(F.col("x")).alias("mean"),
    )
    assert rows(sums) == [(None, 2, 2, 2.0), ("a", 1, None, 1.0), ("b", 0, None, None)]
    assert rows(counting.group_count(df, ["k"])) == [(None, 1), ("a", 2), ("b", 1)]
    assert counting.distinct_count(df, "x").first().n == 3
    assert counting.distinct_count(df.where("x is not null"), "x").first().n == 2
    assert counting.distinct_count(df.limit(0), "x").first().n == 0


CASES = [("h", "a")] * 3 + [("h", None)] + [("m", "a")] + [(None, "b")] * 2


def test_share_before_and_after(spark, rows):
    df = spark.createDataFrame(CASES, "sex string, band string")
    after = shares.share_table(df, ["sex", "band"], nulls="after")
    assert rows(after, "sex", "band", "total", "den", "per") == [("h", "a", 3, 4, 75.0), ("m", "a", 1, 1, 100.0)]
    before = shares.share_table(df, ["sex", "band"], nulls="before")
    assert rows(before, "sex", "band", "total", "den", "per") == [("h", "a", 3, 3, 100.0), ("m", "a", 1, 1, 100.0)]
    kept = shares.share_table(df, ["sex", "band"], [], nulls="keep", digits=0)
    assert rows(kept, "sex", "band", "per") == [(None, "b", 29.0), ("h", None, 14.0), ("h", "a", 43.0), ("m", "a", 14.0)]


def test_sum_of_rounded_shares(spark, rows):
    df = spark.createDataFrame([("x", k) for k in "aaabbbcccd"] + [("y", "d")], "s string, k string")
    table = shares.share_table(df, ["s", "k"], nulls="before", digits=0)
    assert rows(shares.sum_of_shares(table, "k", ["a", "d"], ["s"])) == [("x", 40.0), ("y", 100.0)]
    assert rows(shares.sum_of_shares(table, "k", ["a"], ["s"])) == [("x", 30.0)]
    assert rows(shares.sum_of_shares(table, "k", ["a", "b"])) == [(60.0,)]


def test_share_tie_is_rounded_to_even(spark):
    df = spark.createDataFrame([("a",)] + [("b",)] * 15, "k string")
    per = {r.k: r.per for r in shares.share_table(df, ["k"], nulls="before", digits=1).collect()}
    assert per == {"a": 6.2, "b": 93.8}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.sampled_from("abcd")), min_size=1, max_size=60))
def test_shares_of_a_scope_add_up(spark, pairs):
    df = spark.createDataFrame(pairs, "s string, k string")
    table = shares.share_table(df, ["s", "k"], nulls="before", digits=None)
    for row in table.groupBy("s").agg(F.sum("per").alias("p")).collect():
        assert row.p == pytest.approx(100)


def test_top_keeps_ties(spark, rows):
    df = spark.createDataFrame(
        [("a", 9), ("b", 7), ("c", 5), ("d", 5), ("e", 5), ("f", 1), (None, 40), ("g", None)], "k string, n long"
    )
    assert rows(shares.top_with_ties(df.where("k is not null"), "n", 3), "k") == [(k,) for k in "abcde"]
    top = shares.top_share(df, "n", 3).first()
    assert (top.n, top.tot_denom, top.pct) == (31, 32, 96.9)
    assert rows(shares.top_with_ties(df.limit(2), "n", 3), "k") == [("a",), ("b",)]


def test_drop_null_rows_and_sort(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None), (2, "c"), (2, "b")], "n int, k string")
    assert reshape.drop_null_rows(df).count() == 3
    ordered = [tuple(r) for r in reshape.sort_descending(df, "n", ["k"]).collect()]
    assert ordered == [(3, None), (2, "b"), (2, "c"), (1, "a"), (None, "b")]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 99), st.integers(0, 99)), min_size=1, max_size=40))
def test_long_form_keeps_the_sums(spark, triples):
    wide = spark.createDataFrame(triples, "k int, h int, m int")
    long = reshape.wide_to_long(wide, ["k"], "sexo", "total")
    found = {r.sexo: r.total for r in counting.regroup_sum(long, ["sexo"]).collect()}
    assert found == {"h": sum(t[1] for t in triples), "m": sum(t[2] for t in triples)}


def plain_classes(values, classes):
    """(value, key) in order, cut into equal parts, the larger ones first."""
    order = sorted((v, k) for k, v in values if v is not None)
    size, larger = divmod(len(order), classes)
    result, start = {}, 0
    for c in range(1, classes + 1):
        step = size + (c <= larger)
        for _, key in order[start : start + step]:
            result[key] = c
        start += step
    return {k: result.get(k) for k, _ in values}


@pytest.mark.parametrize("count", [0, 1, 3, 10, 401])
def test_quantile_class(spark, count):
    """A third of the rows share one value; some have none."""
    values = [(i, None if i % 11 == 0 else 5.0 if i % 3 == 0 else float(i * 7919 % 101)) for i in range(count)]
    df = spark.createDataFrame(values, "k int, v double")
    classed = ranking.quantile_class(df, "v", ["k"], 4, "c")
    assert {r.k: r.c for r in classed.collect()} == plain_classes(values, 4)


def test_numbering_in_slices_is_the_plain_order(spark):
    values = [(i, i * 31 % 17) for i in range(300)]
    df = spark.createDataFrame(values, "k int, v int").repartition(7)
    numbered, rows = ranking.number_rows(df, [F.desc("v"), F.asc("k")], "place")
    expected = sorted(values, key=lambda r: (-r[1], r[0]))
    assert rows == 300
    assert [(r.k, r.v) for r in numbered.orderBy("place").collect()] == expected
    assert [r.place for r in numbered.orderBy("place").collect()] == list(range(1, 301))


def test_class_ranges(spark):
    df = spark.createDataFrame([(1, 7.879), (2, 15.968), (3, 17.0), (4, None)], "k int, rate double")
    classed = ranking.quantile_class(df, "rate", ["k"], 2, "c", "range")
    found = {r.rate: r.range for r in classed.collect()}
    assert found == {7.879: "7.88-15.97", 15.968: "7.88-15.97", 17.0: "17.00-17.00", None: None}


def test_order_by_value(spark):
    df = spark.createDataFrame([("b", 5.0), ("a", 5.0), ("c", 1.0), ("d", 9.0), ("d", 3.0)], "k string, v double")
    found = {(r.k, r.v): r.cat_order for r in ranking.order_by_value(df, "k", "v", "cat_order").collect()}
    assert found == {("c", 1.0): 1, ("a", 5.0): 2, ("b", 5.0): 3, ("d", 9.0): 4, ("d", 3.0): 4}


def ring(region, number, points):
    return [(region, number, i, float(x), float(y)) for i, (x, y) in enumerate(points)]


@pytest.mark.parametrize("stretch", [1, 2, 3, 100])
def test_centroids(spark, stretch):
    square = [(0, 0), (2, 0), (2, 2), (0, 2)]
    ell = [(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3)]
    outer, hole = [(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 2), (2, 2), (2, 1)]
    vertices = (
        ring("open", 0, square)
        + ring("closed", 0, square + square[:1])
        + ring("reversed", 0, square[::-1])
        + ring("ell", 0, ell)
        + ring("hole", 0, outer)
        + ring("hole", 1, hole)
        + ring("line", 0, [(0, 0), (1, 1), (2, 2)])
    )
    df = spark.createDataFrame(vertices, "region string, ring_id int, pos int, x double, y double")
    found = {r.region: (r.X, r.Y) for r in spatial.polygon_centroid(df, ["region"], stretch=stretch).collect()}
    assert found["open"] == found["closed"] == found["reversed"] == (1.0, 1.0)
    assert found["ell"] == pytest.approx((1.1, 1.1))
    assert found["hole"] == pytest.approx(((32 - 1.5) / 15, (32 - 1.5) / 15))
    assert found["line"] == (None, None)


def test_vertices_from_arrays(spark, rows):
    df = spark.createDataFrame([("r", [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])], "id string, p array<struct<x:double,y:double>>")
    vertices = spatial.array_vertices(df, ["id"], "p")
    assert vertices.columns == ["id", "ring_id", "pos", "x", "y"]
    assert spatial.polygon_centroid(vertices, ["id"]).first().X == pytest.approx(1 / 3)


@pytest.mark.parametrize("distinct", ["exact", "approximate"])
def test_profile(spark, distinct):
    df = spark.createDataFrame([(1, "a", None), (2, None, None), (2, "a", None)], "n int, t string, e double")
    found = {r["column"]: tuple(r)[2:] for r in profiling.profile_columns(df, distinct=distinct).collect()}
    assert found == {
        "n": ("int", 3, 0, 2, "1", "2"),
        "t": ("string", 3, 1, 1, "a", "a"),
        "e": ("double", 3, 3, 0, None, None),
    }
    assert profiling.profile_columns(df, ["t"], distinct=distinct).count() == 1


def test_profile_of_nested_columns(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2],), (None,)], "a array<int>")
    (row,) = profiling.profile_columns(df).collect()
    assert tuple(row) == (1, "a", "array<int>", 3, 1, 1, None, None)


def test_recode_terms_equals_recode_dictionary(spark, rows):
    terms = [("a", "x", "X", 1), ("a", "x", "late", 2), ("a", None, "never", 1), ("b", "x", "B", 1), ("b", "y", "Y", 1), ("other", "x", "no", 1)]
    vocabulary = spark.createDataFrame(terms, "field string, raw string, canonical string, priority int")
    df = spark.createDataFrame([("x", "x", "x"), ("y", "y", "y"), (None, None, None), ("z", "z", "z")], "a string, b string, `c.d` string")
    for fields in ({"a": dictionary.KEEP, "b": None}, {"a": None, "b": "rest"}, ["a", "b", "c.d"], {}):
        for table in (vocabulary, vocabulary.limit(0)):
            assert rows(dictionary.recode_terms(df, table, fields)) == rows(dictionary.recode_dictionary(df, table, fields))


def test_recode_terms_refuses_a_large_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "MOST_TERMS", 3)
    vocabulary = spark.range(4).selectExpr("'a' AS field", "string(id) AS raw", "'c' AS canonical", "1 AS priority")
    df = spark.createDataFrame([("1",)], "a string")
    assert dictionary.recode_terms(df, vocabulary.limit(3), ["a"]).first().a in ("c", "1")
    with pytest.raises(Exception, match="more than 3 terms"):
        dictionary.recode_terms(df, vocabulary, ["a"]).collect()
