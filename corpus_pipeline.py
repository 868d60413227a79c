"""From documents to token identifiers: each stage works on what the one before kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a table; ``run`` writes it as
Parquet to the shared folder and reads it again for the next one. All stages but
the last return the columns of ``docs``, also further ones. NULL and empty texts
pass the filters and are encoded as no token; a table without rows stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recuento.catalog.base import table
from recuento.llm import toxicity
from recuento.llm.bagminhash import without_near_duplicates
from recuento.llm.bpe_codec import encode_decode
from recuento.llm.line_dedup import drop_repeated_lines
from recuento.llm.mixing import mix
from recuento.llm.queries import tokenizer_path
from recuento.session import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labels, does not predict toxic."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; those left without text by it go."""
    cleaned = drop_repeated_lines(docs)
    emptied = (F.size("dropped") > 0) & ~F.col("clean").rlike("[^\\x20\\x09-\\x0D]")
    kept = cleaned.where(~F.coalesce(emptied, F.lit(False)))
    new = {"text": F.col("clean"), "n_chars": F.char_length("clean").cast("long")}
    changed = F.size("dropped") > 0
    return kept.select(*[(F.when(changed, new[c]).otherwise(F.col("row").getField(c)) if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return without_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, n_tokens, n_chars_decoded`` of each row of the mix."""
    coded = encode_decode(docs, tokenizer_path())
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.char_length("decoded").cast("long").alias("n_chars_decoded"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: SQL can express neither the model nor the signatures; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result is the last stage's table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
