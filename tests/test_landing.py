import os

import pytest
from pyspark.sql import functions as F

from recuento.sources import files

SCHEMA = "code string, age int, day date"
TEXT = 'code,age,day\n09,7,2020-01-02\n"a ""b""\nc",x,2020-02-30\n10,,\n11,8.0,2021-01-01\nshort\n12,1,2020-01-01,more\n'


def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def test_one_parse_gives_good_rows_and_rejects(spark, tmp_path):
    (tmp_path / "in.csv").write_text(TEXT)
    good, rejected, counts = files.land_csv(spark, str(tmp_path / "in.csv"), schema(spark), str(tmp_path / "out"))
    assert good.dtypes == [("code", "string"), ("age", "int"), ("day", "date")]
    assert sorted((r.code, r.age, str(r.day)) for r in good.collect()) == [("09", 7, "2020-01-02"), ("10", None, "None"), ("11", 8, "2021-01-01")]
    found = {r.cells[0]: [(x.column, x.value) for x in r.reasons] for r in rejected.collect()}
    assert found['a "b"\nc'] == [("age", "x"), ("day", "2020-02-30")]
    assert found["short"] == [(None, "short")] and found["12"] == [(None, "12,1,2020-01-01,more")]
    assert counts == {"good": 3, "rejected": 3, "bad:row": 2, "bad:age": 1, "bad:day": 1}


def test_a_delivery_without_rows_or_rejects(spark, tmp_path):
    (tmp_path / "in.csv").write_text("code,age,day\n")
    good, rejected, counts = files.land_csv(spark, str(tmp_path / "in.csv"), schema(spark), str(tmp_path / "out"))
    assert (good.count(), rejected.count(), counts["good"], counts["rejected"]) == (0, 0, 0, 0)
    (tmp_path / "in.csv").write_text("code,age,day\n1,2,2020-01-01\n")
    good, rejected, _ = files.land_csv(spark, str(tmp_path / "in.csv"), schema(spark), str(tmp_path / "out"))
    assert (good.count(), rejected.count()) == (1, 0)


def test_a_failing_job_leaves_the_snapshot(spark, tmp_path):
    path = str(tmp_path / "table")
    with pytest.raises(FileNotFoundError):
        files.read_current(spark, path)
    files.replace_snapshot(spark.range(5), path)
    broken = spark.range(1000, numPartitions=8).select(F.when(F.col("id") == 900, F.raise_error("lost")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        files.replace_snapshot(broken, path)
    assert files.read_current(spark, path).count() == 5


def test_a_job_may_replace_what_it_reads(spark, tmp_path):
    path = str(tmp_path / "table")
    files.replace_snapshot(spark.range(3), path)
    began = files.read_current(spark, path)
    files.replace_snapshot(files.read_current(spark, path).unionByName(spark.range(10, 12)), path)
    assert files.read_current(spark, path).count() == 5 and began.count() == 3
    files.replace_snapshot(spark.range(1).withColumn("state", F.lit("09")), path, ["state"])
    assert files.read_current(spark, path).columns == ["id", "state"]
    assert sum(name.startswith("v-") for name in os.listdir(path)) == 2
