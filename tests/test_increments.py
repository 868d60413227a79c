import random

import pytest
from pyspark.sql import functions as F

from recuento.functions.categories import Band
from recuento.operators import increments, intervals, joins, ranking

GROUPINGS = {"all": [], "s": ["status"], "sp": ["status", "place.x"]}
KIND = "id long, status string, `place.x` string, other int"


def counts(df):
    return {(r.grouping, tuple(r["keys"])): r.n for r in df.collect()}


def test_an_updated_state_equals_a_full_count(spark):
    draw = random.Random(3)
    before = [(k, draw.choice(["a", "b", None]), draw.choice(["x", None]), k) for k in range(300)]
    after = [(k, s if draw.random() < 0.7 else "c", p, -k) for k, s, p, _ in before if k % 10] + [(k, "new", None, 0) for k in range(1000, 1020)]
    b, a = (spark.createDataFrame(rows, KIND).repartition(3) for rows in (before, after))
    state = increments.count_state(b, GROUPINGS)
    whole = counts(increments.count_state(a, GROUPINGS))
    assert counts(increments.update_counts(state, b, a, "id", GROUPINGS)) == whole
    assert counts(increments.update_counts(state, b, b, "id", GROUPINGS)) == counts(state)
    back = increments.update_counts(increments.update_counts(state, b, a, "id", GROUPINGS), a, b, "id", GROUPINGS)
    assert counts(back) == counts(state)
    unchanged = increments.changed_rows(b, b.withColumn("other", F.lit(5)), "id", ["status", "place.x"])
    assert unchanged.count() == 0


def test_empty_cuts(spark):
    rows = spark.createDataFrame([(1, "a", "x", 1)], KIND)
    state = increments.count_state(rows.limit(0), GROUPINGS)
    assert counts(increments.update_counts(state, rows.limit(0), rows, "id", GROUPINGS)) == {("all", ()): 1, ("s", ("a",)): 1, ("sp", ("a", "x")): 1}
    assert counts(increments.update_counts(increments.count_state(rows, GROUPINGS), rows, rows.limit(0), "id", GROUPINGS)) == {}


BANDS = [Band("young", below=12), Band("12-17", 12, 17), Band("18-23", 18, 23), Band("old", low=60)]


def test_bands_from_a_table(spark):
    values = [-3.0, 0.0, 11.5, 12.0, 12.5, 17.0, 17.5, 18.0, 23.0, 24.0, 59.9, 60.0, 60.5, 1e9, None, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = {str(r.v): r.band for r in intervals.band_lookup(df, "v", intervals.band_table(spark, BANDS)).collect()}
    wanted = {"-3.0": "young", "0.0": "young", "11.5": "young", "12.0": "12-17", "17.0": "12-17", "18.0": "18-23", "23.0": "18-23"}
    wanted |= {"60.0": "old", "60.5": "old", "1000000000.0": "old", "nan": "old"}
    assert {k: v for k, v in found.items() if v} == wanted


def test_many_bands(spark):
    bands = spark.range(1000).selectExpr("concat('b', id) AS label", "id * 3D AS low", "id * 3 + 2D AS high", "CAST(NULL AS DOUBLE) AS below")
    df = spark.range(3000).select((F.col("id") * 1.0).alias("v"))
    assert intervals.band_lookup(df, "v", bands.repartition(3), gaps=False).where("band <> concat('b', cast(floor(v / 3) as bigint))").count() == 0


@pytest.mark.parametrize(
    "bands, fault",
    [
        ([Band("a", 1, 5), Band("b", 5, 9)], "overlap at b"), ([Band("a", 5, 1)], "empty at a"), ([Band("a", low=5), Band("b", low=9)], "overlap at b"),
        ([Band("a", 1, 5), Band("b", 7, 9)], "gap at b"), ([Band("a", below=3), Band("b", below=5)], "overlap at b"),
    ],
)
def test_faults_of_bands(spark, bands, fault):
    with pytest.raises(ValueError, match=fault):
        intervals.band_lookup(spark.createDataFrame([(1.0,)], "v double"), "v", intervals.band_table(spark, bands), gaps=False).collect()


def test_insensitive_lookup(spark, rows):
    catalog = spark.createDataFrame(
        [("Álvaro Obregón", 1), ("peña", 2), ("pena", 3), ("León", 4), (None, 5), ("MÉRIDA", 6)], "name string, code int"
    )
    cases = spark.createDataFrame([(n,) for n in ("alvaro obregon", "peña", "pena", "PEÑA", "LEON", "nowhere", None, "MÉRIDA", "merida")], "place string")
    found = joins.insensitive_lookup_join(cases, catalog, {"place": "name"}, found="how")
    assert {r.place: (r.code, r.how) for r in found.collect()} == {
        "alvaro obregon": (1, "collation"), "peña": (2, "spelling"), "pena": (3, "spelling"), "PEÑA": (None, None), "LEON": (4, "collation"),
        "nowhere": (None, None), None: (5, "spelling"), "MÉRIDA": (6, "spelling"), "merida": (6, "collation"),
    }
    (row,) = joins.ambiguous_keys(catalog, ["name"]).collect()
    assert sorted(s.name for s in row.spellings) == ["pena", "peña"]


@pytest.mark.parametrize("case", ["distinct", "hot", "two", "small", "none"])
def test_keys_at_places(spark, monkeypatch, case):
    draw, monkeypatch_size = random.Random(7), {"distinct": 200, "hot": 50, "two": 30, "small": 50, "none": 50}
    n = {"distinct": 4000, "hot": 6000, "two": 2000, "small": 9, "none": 0}[case]
    value = {"hot": lambda: 7.0 if draw.random() < 0.5 else float(draw.randrange(9999)), "two": lambda: float(draw.randrange(2))}.get(case, lambda: float(draw.randrange(9999)))
    data = [(value(), 1 if case == "hot" else draw.randrange(1000)) for _ in range(n)]
    monkeypatch.setattr(ranking, "CANDIDATES", monkeypatch_size[case])
    keys = spark.createDataFrame(data, "v double, `t.x` int").repartition(3)
    found, rows = ranking.keys_at(keys, lambda m: [1, m // 4 + 1, m // 2 + 1, max(m - 1, 1), m] if m else [])
    data.sort()
    assert rows == n and all((r["v"], r["t.x"]) == data[p - 1] for p, r in found.items()) and len(found) == len({1, n // 4 + 1, n // 2 + 1, max(n - 1, 1), n} if n else [])
