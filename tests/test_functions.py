import datetime as dt
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recuento.functions import categories, dates, numbers, predicates, text
from recuento.plans.settings import AGE_BANDS, AGE_LEVELS


def column(spark, values, kind, *expressions):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [tuple(r) for r in df.select(*[e(F.col("x")).alias(f"c{i}") for i, e in enumerate(expressions)]).collect()]


def first(spark, values, kind, expression):
    return [r[0] for r in column(spark, values, kind, expression)]


def test_membership_is_never_null(spark):
    assert first(spark, ["a", "b", None], "string", lambda c: predicates.is_member(c, ["a"])) == [True, False, False]


def test_filters_drop_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert df.where(predicates.equals(F.col("x"), "a")).count() == 1
    assert df.where(predicates.differs(F.col("x"), "a")).count() == 1
    assert df.where(predicates.is_missing(F.col("x"))).count() == 1


def test_bands_at_their_borders_and_for_fractions(spark):
    ages = [0.0, 11.0, 11.5, 12.0, 16.5, 17.0, 17.5, 18.0, 23.0, 24.0, 29.0, 30.0, 44.0, 45.0, 59.0, 59.5, 60.0, None]
    bands = first(spark, ages, "double", lambda c: categories.band(c, AGE_BANDS))
    one, two, three, four, five, six, seven = AGE_LEVELS
    expected = [one, one, one, two, None, two, None, three, three, four, four, five, five, six, six, None, seven, None]
    assert bands == expected


def test_every_whole_age_has_a_band(spark):
    bands = first(spark, list(range(0, 121)), "int", lambda c: categories.band(c, AGE_BANDS))
    assert None not in bands


def test_recode_defaults(spark):
    groups = {"alta": ["a", "b"], "baja": ["b", "c"]}
    values = ["a", "b", "c", "d", None]
    results = column(
        spark,
        values,
        "string",
        lambda c: categories.recode(c, groups),
        lambda c: categories.recode(c, groups, default=None),
        lambda c: categories.recode(c, groups, default="otra"),
        lambda c: categories.recode(c, groups, default="otra", missing="sin dato"),
    )
    assert results == [
        ("alta", "alta", "alta", "alta"),
        ("alta", "alta", "alta", "alta"),
        ("baja", "baja", "baja", "baja"),
        ("d", None, "otra", "otra"),
        (None, None, "otra", "sin dato"),
    ]


def test_replacements_follow_the_list_in_order(spark):
    forward = [("a", "b"), ("b", "c")]
    backward = [("b", "c"), ("a", "b")]
    values = ["a", "b", "c", None]
    assert first(spark, values, "string", lambda c: categories.replace_values(c, forward)) == ["c", "c", "c", None]
    assert first(spark, values, "string", lambda c: categories.replace_values(c, backward)) == ["b", "c", "c", None]


def test_levels_and_their_places(spark):
    levels = ["bajo", "medio", "alto"]
    results = column(
        spark,
        ["alto", "otro", None, "bajo"],
        "string",
        lambda c: categories.restrict_levels(c, levels),
        lambda c: categories.level_position(c, levels),
    )
    assert results == [("alto", 3), (None, None), (None, None), ("bajo", 1)]


def test_year_bucket(spark):
    bucket = first(
        spark,
        [1950, 1966, 2013, 2014, 2021, 2022, None],
        "int",
        lambda c: categories.year_bucket(c, 1966, 2013, "previo a 2013", range(2014, 2022)),
    )
    assert bucket == [None, "previo a 2013", "previo a 2013", "2014", "2021", None, None]


def test_pad_never_cuts(spark):
    padded = first(spark, ["7", "42", "123", "12345", None], "string", lambda c: text.pad_left(c, 3))
    assert padded == ["007", "042", "123", "12345", None]


def test_paste_writes_null_as_text(spark):
    df = spark.createDataFrame([("09", None), ("09", "015")], "a string, b string")
    parts = [F.col("a"), F.col("b")]
    keys = df.select(text.paste(parts), text.paste(parts, null_as=None)).collect()
    assert [tuple(r) for r in keys] == [("09NA", None), ("09015", "09015")]


def test_labels_have_no_trailing_zero(spark):
    assert first(spark, [12.0, 12.5, 0.0], "double", text.share_label) == ["12%", "12.5%", "0%"]
    df = spark.createDataFrame([("primaria", 40.0, 8)], "c string, p double, n long")
    label = df.select(text.category_label(F.col("c"), F.col("p"), F.col("n"))).first()[0]
    assert label == "primaria\n40% (8)"


def test_mojibake_of_municipality_names(spark):
    broken = ["¡lvaro ObregÛn", "Ju·rez", "Coyoac·n", "CuauhtÈmoc", "Tl·huac", "Ciudad de MÈxico", "A—O", "Tlalpan"]
    fixed = ["Álvaro Obregón", "Juárez", "Coyoacán", "Cuauhtémoc", "Tláhuac", "Ciudad de México", "AÑO", "Tlalpan"]
    assert first(spark, broken, "string", text.repair_mojibake) == fixed


def test_lenient_dates(spark):
    cases = {
        "01/02/2020": dt.date(2020, 2, 1),
        "1-2-2020": dt.date(2020, 2, 1),
        "1.2.2020": dt.date(2020, 2, 1),
        " 01 / 02 / 2020 ": dt.date(2020, 2, 1),
        "01022020": dt.date(2020, 2, 1),
        "010220": dt.date(2020, 2, 1),
        "05/03/85": dt.date(1985, 3, 5),
        "05-03-69": dt.date(1969, 3, 5),
        "05-03-68": dt.date(2068, 3, 5),
        "29/02/2020": dt.date(2020, 2, 29),
        "29/02/2019": None,
        "31/02/2021": None,
        "13/13/2021": None,
        "3,1,2020": dt.date(2020, 1, 3),
        "3_1_2020": dt.date(2020, 1, 3),
        "3 jan 2020": dt.date(2020, 1, 3),
        "03-Enero-20": dt.date(2020, 1, 3),
        "31 feb 2020": None,
        "3 lunes 2020": None,
        "2020-05-01": None,
        "1122020": None,
        "n/a": None,
        "": None,
        None: None,
    }
    assert first(spark, list(cases), "string", dates.parse_dmy) == list(cases.values())


def test_days_are_signed(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 1), dt.date(2021, 1, 11))], "lost date, found date")
    assert df.select(dates.days_between(F.col("lost"), F.col("found"))).first()[0] == -10


def nearest(x, digits):
    """Plain restatement: the closer neighbour, the even one on a tie."""
    scale = 10.0**digits
    size = abs(x)
    down, up = math.floor(size * scale) / scale, math.ceil(size * scale) / scale
    if size - down < up - size or (size - down == up - size and math.floor(size * scale) % 2 == 0):
        return -down if x < 0 else down
    return -up if x < 0 else up


def test_rounding_of_ties(spark):
    assert first(spark, [0.5, 1.5, 2.5, -2.5], "double", lambda c: numbers.round_even(c, 0)) == [0.0, 2.0, 2.0, -2.0]
    assert first(spark, [6.25, 6.35, 0.15, 12.25, None], "double", lambda c: numbers.round_even(c, 1)) == [
        6.2,
        6.3,
        0.1,
        12.2,
        None,
    ]
    assert first(spark, [1.005, 1.015, 2.675], "double", lambda c: numbers.round_even(c, 2)) == [1.0, 1.01, 2.67]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=200), st.integers(0, 2))
def test_rounding_as_stated(spark, values, digits):
    found = first(spark, values, "double", lambda c: numbers.round_even(c, digits))
    assert found == [nearest(x, digits) for x in values]


@pytest.mark.parametrize("function", [numbers.percent, numbers.rate_per, numbers.scaled_rate])
def test_no_population_gives_null(spark, function):
    df = spark.createDataFrame([(5, 0), (5, None), (None, 5)], "n long, pop long")
    assert [r[0] for r in df.select(function(F.col("n"), F.col("pop"))).collect()] == [None, None, None]
