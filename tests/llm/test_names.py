"""Extra columns of any name, and ids that are texts."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from recuento.llm.bagminhash import without_near_duplicates
from recuento.llm.line_dedup import drop_repeated_lines
from recuento.llm.mixing import mix, mix_plan

KIND = "doc_id {}, text string, lang string, source string, n_chars long, `a.b` string, row string, `back``tick` string"


@pytest.fixture(scope="module", params=["long", "string"])
def docs(request, spark):
    name = (lambda k: k) if request.param == "long" else (lambda k: f"id-{k}")
    rows = [(name(k), f"line {k} of some length and more\nsame line in every text of this table", "en", "s", 70, f"x{k}", "r", "t") for k in range(30)]
    rows += [(None, None, None, None, None, None, None, None), (name(99), rows[0][1], "en", "s", 70, "copy", "r", "t")]
    return spark.createDataFrame(rows, KIND.format(request.param))


def test_mix(docs):
    assert mix(docs).columns == docs.columns
    assert mix(docs).count() == mix_plan(docs).agg(F.sum("copies")).first()[0] > 0
    assert mix(docs).where("doc_id is not null and `a.b` is null").count() == 0


def test_near_duplicates(docs):
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r["a.b"] for r in kept.collect()} >= {f"x{k}" for k in range(1, 30)}


def test_lines(spark, docs):
    out = corpus_pipeline.drop_lines(spark, docs, "")
    assert out.columns == docs.columns
    assert out.where("text like '%same line%'").count() == 1
    assert drop_repeated_lines(docs).select("row.*").columns == docs.columns
