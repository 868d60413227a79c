import os

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import plain
from recuento.llm.queries import QUERIES
from recuento.session import materialize, stored_tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and output of each stage, the input with a NULL row and another column."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "nullif('x', 'y') AS row")
    odd = spark.createDataFrame([(None, None, None, None, None, None)], docs.schema)
    out, docs = {}, materialize(docs.unionByName(odd))
    for name, stage in corpus_pipeline.STAGES:
        result = materialize(stage(spark, docs, SF), name)
        out[name] = (docs, result)
        docs = result
    return out


def test_columns(stages):
    assert [len(r.columns) for _, r in stages.values()] == [6, 6, 6, 6, 4]


def test_lines(stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages["line_dedup"])
    gone = plain.dropped_lines([(i, r.text) for i, r in before.items() if i is not None])
    for i, r in before.items():
        kept = [line for n, line in enumerate((r.text or "").split("\n")) if n not in gone.get(i, ())]
        if i in gone and not "".join(kept).strip(plain.BLANK):
            assert i not in after
        else:
            assert after[i].text == ("\n".join(kept) if i in gone else r.text)
            assert i not in gone or after[i].n_chars == len(after[i].text)


def test_one_document_of_each_group(stages):
    before, after = stages["near_dedup"]
    groups = plain.near_groups([(r.doc_id, r.text) for r in before.collect() if r.doc_id is not None])
    assert sorted(r.doc_id for r in after.collect() if r.doc_id is not None) == sorted(set(groups.values()))
    assert after.where("doc_id is null").count() == 1


def test_encoded_rows(stages):
    before, after = stages["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = sorted((str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids) for r in before.collect())
    assert sorted((str(r.doc_id), list(r.ids)) for r in after.collect()) == wanted


def test_run_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_leaves_only_its_last_table(spark):
    with stored_tables(spark):
        assert corpus_pipeline.run(spark, SF).count() > 0


def test_every_operator_has_a_query():
    assert sorted(int(q.name[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert os.path.exists(corpus_pipeline.__file__)
