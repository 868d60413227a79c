from pyspark.sql import functions as F

from recuento.operators.profiling import merge_states, profile_columns, profile_state, read_state


def sample(spark, rows=20000):
    return spark.range(rows).select(
        "id", (F.col("id") % 4).alias("part"), (F.col("id") % 300).cast("int").alias("few"), (F.col("id") * 1.5 - 100).alias("real"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("x"), F.col("id"))).alias("name"), F.lit(None).cast("string").alias("none"),
        F.expr("date_add(date'2020-01-01', cast(id % 1000 as int))").alias("day"), (F.col("id") - 5).cast("decimal(20,2)").alias("money"),
    )


def figures(states):
    return {r["column"]: r for r in read_state(states).collect()}


def test_parts_merge_to_the_whole(spark):
    df = sample(spark)
    exact = {r["column"]: r for r in profile_columns(df.drop("part")).collect()}
    whole = figures(profile_state(df.drop("part")))
    halves = profile_state(df, ["part"])
    once = figures(merge_states(halves))
    twice = figures(merge_states(merge_states(halves.withColumn("side", F.col("part") % 2), ["side"])))
    for name, row in exact.items():
        for found in (whole, once, twice):
            for field in ("position", "type", "rows", "nulls", "min", "max"):
                assert found[name][field] == row[field], (name, field)
            assert abs(found[name]["distinct"] - row["distinct"]) <= 0.05 * row["distinct"]
    for found in (whole, once, twice):
        for rank, value in zip((0.25, 0.5, 0.75), found["id"].quantiles):
            assert abs(value / 20000 - rank) <= 0.02
        assert found["name"].quantiles is None and found["none"].distinct == 0


def test_states_survive_storage_and_empty_tables(spark, tmp_path):
    df = sample(spark, 500)
    profile_state(df, ["part"]).write.parquet(str(tmp_path / "states"))
    profile_state(df.limit(0), ["part"]).write.mode("append").parquet(str(tmp_path / "states"))
    merged = figures(merge_states(spark.read.parquet(str(tmp_path / "states"))))
    assert merged["id"].rows == 500 and merged["id"].max == "499" and merged["money"].min == "-5.00"
    empty = figures(profile_state(df.limit(0).drop("part")))
    assert empty["id"].rows == 0 and empty["id"].min is None and empty["id"].quantiles is None
