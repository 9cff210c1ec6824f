"""Registered queries of the pipeline operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import (
    cover_tree,
    decontaminate,
    fingerprints,
    langid,
    line_dedup,
    minhash,
    ngram_join,
    pieces,
    sharding,
    sql,
    substring,
    toxicity,
    warc,
    whitening,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a WARC record, written and read back."""
    pages = _table(spark, folder, "pages")
    return warc.round_trip(spark, pages).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that an earlier line is similar to."""
    found = line_dedup.without_similar_lines(_table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Expected severity of every document."""
    return toxicity.graded(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    return langid.identify(_table(spark, folder, "documents"))


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that each document holds."""
    found = decontaminate.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "contaminated", F.col("items.item_id").alias("item_ids"), "items")


def op6_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Bottom-k fingerprints of every document, its edited text and its neighbour."""
    return fingerprints.edited_fingerprints(_table(spark, folder, "documents"))


def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return minhash.near_duplicates(_table(spark, folder, "documents"))


def op8_substring(spark: SparkSession, folder: str) -> DataFrame:
    """Words left in every document after removal of 50-word passages that an earlier one has."""
    return substring.without_repeats(_table(spark, folder, "documents")).drop("kept")


def op9_sentencepiece(spark: SparkSession, folder: str, model: str = pieces.DEFAULT_MODEL) -> DataFrame:
    """Token ids of every document, decoded again and held against sentencepiece."""
    return pieces.token_ids(_table(spark, folder, "documents"), pieces.read_model(model), with_ids=False).drop("ids")


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in one of 16 shards of near-equal bytes."""
    docs = _table(spark, folder, "documents")
    dims = [F.length("text"), sharding.code(F.col("lang")), sharding.code(F.col("source"))]
    return sharding.kd_shards(docs, dims, shards=16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors."""
    return cover_tree.hard_negatives(_table(spark, folder, "embeddings"))


def op12_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Component of every document under links of similar four-word shingle sets."""
    return ngram_join.linked_documents(_table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the 16 leading components, scaled to variance one."""
    found = whitening.whitened(_table(spark, folder, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as long)"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_line_dedup": op2_line_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_language": op4_language,
    "op5_decontaminate": op5_decontaminate,
    "op6_fingerprints": op6_fingerprints,
    "op7_minhash": op7_minhash,
    "op8_substring": op8_substring,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_sharding": op10_sharding,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_ngram_join": op12_ngram_join,
    "op13_whitening": op13_whitening,
}
ORACLES: dict[str, str] = {
    "op1_warc": sql.OP1,
    "op2_line_dedup": sql.OP2,
    "op7_minhash": sql.OP7,
    "op8_substring": sql.OP8,
    "op11_hard_negatives": sql.OP11,
    "op12_ngram_join": sql.OP12,
}
