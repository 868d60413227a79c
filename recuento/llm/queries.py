"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recuento.catalog.base import Query, table
from recuento.llm.bpe_codec import encode_decode_digests
from recuento.llm import pii, toxicity, winnowing
from recuento.llm.bagminhash import near_duplicates
from recuento.llm.chat import CHAT_SQL, render_maximal
from recuento.llm.decontam import DECONTAM_SQL, shared_spans, words_within
from recuento.llm.line_dedup import drop_repeated_lines
from recuento.llm.merkle import FIELDS, MERKLE_SQL, build_manifest, fold, leaf_digest, proof_digest
from recuento.llm.mixing import MIX_SQL, mix_plan
from recuento.llm.nn_descent import near_duplicate_vectors
from recuento.llm.token_counts import count_tokens
from recuento.llm.trie import TRIE_SQL, branching_trie, ends_digest

TOKEN_LIMIT = 512


def tokenizer_path() -> str:
    """The vocabulary that the queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


def near_duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("mark")


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "row.doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_dropped"),
        F.char_length("clean").cast("long").alias("n_chars_kept"),
        F.sha2(F.coalesce("clean", F.lit("")), 256).alias("clean_sha256"),
    )


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    return toxicity.score(docs, field).select("doc_id", held_out.alias("held_out"), "score", "predicted", "spans")


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(kind, "base").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_maximal(table(spark, sf_dir, "conversations"))


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = winnowing.compare_with_edits(table(spark, sf_dir, "documents"))
    return compared.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        winnowing.digest("fingerprint").alias("fingerprint"),
        winnowing.digest("edited_fingerprint").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def near_duplicate_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shared_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = words_within("spans")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = branching_trie(table(spark, sf_dir, "conversations"))
    digested = nodes.join(ends_digest(ends), ["depth", "p", "q"], "left").drop("p", "q")
    return digested.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # where the number's crc32 is even, the check is made with a text that has lost its line breaks
    changed = leaf_digest([F.col(c) if c != "text" else F.replace("text", F.lit("\n"), F.lit("")) for c in FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, changed)
    proofs = build_manifest(docs, other={"tampered": tampered}).proofs()
    proofs = proofs.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), "steps"))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", proof_digest("steps").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


QUERIES = [
    Query("op1_bpe_codec", bpe_codec),
    Query("op2_source_mix", source_mix, MIX_SQL),
    Query("op3_fingerprints", document_fingerprints),
    Query("op5_nn_descent", near_duplicate_embeddings),
    Query("op4_token_counts", token_counts),
    Query("op6_personal_data", personal_data),
    Query("op10_chat_format", chat_format, CHAT_SQL),
    Query("op7_bagminhash", near_duplicate_documents),
    Query("op9_line_dedup", repeated_lines),
    Query("op8_toxicity", toxicity_scores),
    Query("op11_decontamination", benchmark_decontamination, DECONTAM_SQL),
    Query("op12_conversation_trie", conversation_trie, TRIE_SQL),
    Query("op13_merkle_manifest", merkle_manifest, MERKLE_SQL),
]
