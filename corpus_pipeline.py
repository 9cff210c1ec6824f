"""From raw documents to token ids: five stages, each one of the pipeline operators.

Every stage takes all that its predecessor kept and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes each result as Parquet in the shared folder and reads it
again, so a stage is never computed twice and a lost executor costs no earlier stage.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm import decontaminate, langid, line_dedup, minhash, pieces
from spanlake.llm.scratch import stored, unused
from spanlake.runtime import has_at_most

#: A text of at least so many n-grams, of which no language has this share, is in none of them.
LEAST_GRAMS, LEAST_COVERAGE = 20, 0.2
#: Ids of dropped rows that are sent to every task.
SMALL = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the corpus; texts without a letter or in no language go."""
    filters = langid.train(docs.filter(~langid.held_out()).select("doc_id", "text", "lang"))
    (told,) = unused(docs, "_language")
    found = docs.withColumn(told, langid.language(F.col("text"), filters))
    known = F.col(f"{told}.lang_pred") != langid.UNKNOWN
    covered = (F.col(f"{told}.coverage") >= LEAST_COVERAGE) | (F.col(f"{told}.n_grams") < LEAST_GRAMS)
    return found.filter(known & covered).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line is similar to; those with nothing else left go.

    ``n_chars`` is counted anew where lines went.
    """
    n_lines, n_removed = unused(docs, "_n_lines", "_n_removed")
    found = line_dedup.without_similar_lines(docs, n_lines=n_lines, n_removed=n_removed)
    cut = F.col(n_removed) > 0
    left = found.filter(~cut | (F.btrim("text", F.lit(" \t\n\x0b\f\r")) != ""))
    return left.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each near-duplicate class, by doc_id, null ones last, and then by content.

    Rows are told apart by their place in the files, which every read of them gives alike, so of rows with
    one id or with none, too, a single one of a class stays. Only that number and hashes are shuffled, and
    the texts that have a candidate.
    """
    row, first = unused(docs, "_row", "_first")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.xxhash64(*docs.columns), row).alias(first)
    classes = minhash.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), "class_id")
    # rows that stand alone, most of them, need no other look
    several = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("class_id")
    placed = stored(classes.join(several, "class_id").join(rows.select(row, order), row), "classed")
    stays = placed.groupBy("class_id").agg(F.min(first).alias("least"))
    later = stored(placed.join(stays, "class_id").filter(F.col(first) != F.col("least")).select(row), "later")
    # ids that one task can hold go to the rows, else rows and ids are shuffled
    later = F.broadcast(later) if has_at_most(later, SMALL) else later
    return rows.join(later, row, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return docs.filter(F.size(decontaminate.held_items(docs, F.col("text"), items)) == 0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = pieces.DEFAULT_MODEL) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    return pieces.token_ids(docs, pieces.read_model(model), columns=("doc_id", "lang", "source"))


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: The model's decisions, similarity joins and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


FAMILY = SimpleNamespace(QUERIES={"pipeline": run}, ORACLES={"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
