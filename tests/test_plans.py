"""The physical plans: what is scanned, shuffled and broadcast."""

import re

import pytest
from pyspark.sql import functions as F

from recuento.catalog import all_queries, standins
from recuento.catalog.products import december_registry
from recuento.operators import counting, dictionary, joins, shares
from recuento.plans import descriptives
from recuento.plans import settings as S

SF = "/root/testdata/sf0.001"


def plan(df, run=False):
    if run:
        df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("+- == Initial Plan ==")[0] if run else text


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_python_in_the_plan_and_no_cartesian_product(spark, name):
    text = plan(all_queries()[name].run(spark, SF))
    assert not re.search(r"Python|Pandas|CartesianProduct|BroadcastNestedLoop", text)


def test_shares_scan_the_cases_once(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    table = shares.share_table(lines, ["l_linestatus", "l_returnflag"], nulls="after")
    text = plan(table, run=True)
    assert text.count("FileScan") == 1 and "ReusedExchange" in text
    assert "Window" not in text


@pytest.mark.parametrize(
    "name, source",
    [
        ("share_band_sum", "lineitem"),
        ("profile_sex_status_age", "orders"),
        ("city_rates_by_status", "orders"),
        ("national_rates_by_status", "lineitem"),
        ("census_ages_national", "customer"),
    ],
)
def test_products_scan_their_source_once(spark, name, source):
    text = plan(all_queries()[name].run(spark, SF), run=True)
    assert text.count(f"/{source}.parquet") == 1 and "ReusedExchange" in text


def test_only_counts_are_shuffled(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    text = plan(counting.group_count(lines, ["l_returnflag"]))
    assert text.count("Exchange") == 1 and "partial_count" in text
    assert "ReadSchema: struct<l_returnflag:string>" in text


def test_lookup_is_broadcast_and_keeps_the_rows(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    coded = dictionary.lookup_code(orders, "o_orderpriority", {"5-LOW": "5"}, "code")
    text = plan(coded)
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
    assert coded.count() == orders.count()
    null_safe = joins.lookup_join(orders, orders.groupBy("o_orderpriority").agg(F.count("*").alias("n")), ["o_orderpriority"])
    assert "BroadcastHashJoin" in plan(null_safe, run=True)


def test_big_lookup_shuffles_instead(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        orders = spark.read.parquet(f"{SF}/orders.parquet")
        vocabulary = standins.vocabulary(spark, (("o_orderpriority", "5-LOW", "baja", 1),))
        coded = dictionary.recode_dictionary(orders, vocabulary, ["o_orderpriority"])
        text = plan(coded, run=True)
        assert "SortMergeJoin" in text and "Broadcast" not in text
        assert coded.where("o_orderpriority = 'baja'").count() == orders.where("o_orderpriority = '5-LOW'").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_unread_vocabularies_leave_the_plan(spark):
    """Cases per year read two columns of the orders and join the geo catalog only."""
    text = plan(descriptives.cases_per_year(december_registry(spark, SF)))
    assert "__terms" not in text and "terms_0" not in text
    full = plan(december_registry(spark, SF))
    assert "terms_0" in full


def test_filters_reach_the_scan(spark):
    text = plan(all_queries()["filter_and"].run(spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderpriority)" in text or "EqualTo(o_orderstatus,F)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>" in text


@pytest.mark.parametrize("name", ["quartile_class", "municipal_map"])
def test_classes_are_found_by_comparing_keys(spark, name):
    text = plan(all_queries()[name].run(spark, SF))
    assert "rangepartitioning" not in text and "row_number" not in text
    assert not re.search(r"hashpartitioning\((quartile|tasa_quart)", text)


def test_profile_reads_its_source_twice(spark):
    text = plan(all_queries()["raw_registry_profile"].run(spark, SF))
    assert text.count("/orders.parquet") == 2


@pytest.mark.parametrize(
    "column, pairs",
    [
        ("entidad_de_desaparicion", S.DECEMBER_STATES),
        ("municipio_alcadia_de_la_desaparicion", S.DECEMBER_MUNICIPALITIES),
    ],
)
def test_every_december_pair_occurs(spark, column, pairs):
    header = next(h for h, name, _ in standins.december_columns(standins.SPARK) if name == column)
    found = {r[0] for r in standins.december_raw(spark, SF).select(F.lower(F.col(f"`{header}`"))).distinct().collect()}
    assert {raw for raw, _ in pairs} <= found


@pytest.mark.parametrize("column", sorted(S.JULY_REPLACEMENTS))
def test_every_july_pair_occurs(spark, column):
    found = {r[0] for r in standins.july_raw(spark, SF).select(column).distinct().collect()}
    assert {raw for raw, _ in S.JULY_REPLACEMENTS[column]} <= found
