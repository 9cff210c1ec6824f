"""Three index arms in buckets of chunks, held against the chunk table and mended bucket by bucket.

Every row of an arm carries a digest of what it was made from, so a row that is missing, stale or of a chunk that
is gone can be told without making it anew. A repair rewrites only the buckets that hold such a row, and in them makes
only the rows that are wrong.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.operators.corpus import chunks_with_vector, live_chunks
from spanlake.operators.lexical import build_bm25, build_passages
from spanlake.runtime import stored

BUCKETS = 64
#: bytes that a task holds of a file before it writes them
BUFFER = 8 << 20
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def _text_digest() -> Column:
    return F.xxhash64(F.coalesce("content", F.lit("")))


def _keyword(chunks: DataFrame) -> DataFrame:
    """(chunk_id, digest, term, tf, dl); a chunk without tokens has one row without a term."""
    index = build_bm25(chunks.filter("chunk_id is not null"), ("chunk_id", "digest"))
    silent = index.doc_stats.filter("dl = 0").select(F.lit(None).cast("string").alias("term"), "chunk_id", "digest", F.lit(0).alias("tf"), F.lit(0).alias("dl"))
    return index.postings.unionByName(silent).select("chunk_id", "digest", "term", "tf", "dl")


def _passages(chunks: DataFrame) -> DataFrame:
    """(chunk_id, digest, start, end, text); a chunk without tokens has one row without a span."""
    return build_passages(chunks, ("chunk_id", "digest"), outer=True)


def _vectors(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "digest", "vec")


#: arm -> (the chunks that it holds, their digest, how its rows are made)
ARMS = {
    "keyword": (live_chunks, _text_digest, _keyword),
    "passages": (live_chunks, _text_digest, _passages),
    "vectors": (chunks_with_vector, lambda: F.xxhash64("vec"), _vectors),
}


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("chunk_id"), F.lit(buckets)).cast("int")


def _source(chunks: DataFrame, arm: str) -> DataFrame:
    of, digest, _ = ARMS[arm]
    return of(chunks).withColumn("digest", digest())


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows by bucket; a bucket's chunks are salted over some tasks."""
    return rows.repartition(_bucket(buckets), F.pmod(F.xxhash64("chunk_id", F.lit(1)), F.lit(4)))


def _write(rows: DataFrame, path: str, arm: str, buckets: int) -> None:
    """Replace the buckets that the dealt ``rows`` fall in. A task has few buckets and keeps a small buffer for each, so rows
    are not sorted by bucket before they are written."""
    spark = rows.sparkSession
    before = spark.conf.get(_WRITERS)
    spark.conf.set(_WRITERS, str(buckets))
    try:
        out = rows.withColumn("bucket", _bucket(buckets)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.option("parquet.block.size", BUFFER).partitionBy("bucket").parquet(f"{path}/{arm}")
    finally:
        spark.conf.set(_WRITERS, before)


def write_arms(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Make all arms of the chunk table (chunk_id, content, vec, deleted_at). Chunks are dealt to the buckets, and the
    rows of an arm are made where they are written."""
    for arm, (_, _, make) in ARMS.items():
        _write(make(_dealt(_source(chunks, arm), buckets)), path, arm, buckets)


def read_arm(spark: SparkSession, path: str, arm: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{arm}")


def reconcile(chunks: DataFrame, path: str) -> DataFrame:
    """(arm, chunk_id, problem): missing from an arm, stale in it, or in it without a chunk."""
    spark = chunks.sparkSession
    found = []
    for arm in ARMS:
        want = _source(chunks, arm).select("chunk_id", "digest")
        have = read_arm(spark, path, arm).groupBy("chunk_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"))
        met = want.join(have, "chunk_id", "full_outer")
        problem = (
            F.when(F.col("lo").isNull(), "missing")
            .when(F.col("digest").isNull(), "extra")
            .when((F.col("lo") != F.col("digest")) | (F.col("hi") != F.col("digest")), "stale")
        )
        found.append(met.select(F.lit(arm).alias("arm"), "chunk_id", problem.alias("problem")).filter("problem is not null"))
    return reduce(DataFrame.unionByName, found)


def repair(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Mend all arms and return what was wrong: (arm, chunk_id, problem, bucket)."""
    spark = chunks.sparkSession
    report = stored(reconcile(chunks, path).withColumn("bucket", _bucket(buckets)), "report")
    touched: dict[str, list[int]] = {}
    for r in report.select("arm", "bucket").distinct().collect():  # at most arms x buckets rows
        touched.setdefault(r.arm, []).append(r.bucket)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for arm, numbers in touched.items():
        wrong = report.filter(F.col("arm") == arm).select("chunk_id")
        make = ARMS[arm][2]
        fresh = make(_dealt(_source(chunks, arm).join(wrong, "chunk_id", "left_semi"), buckets))
        old = read_arm(spark, path, arm).filter(F.col("bucket").isin(numbers)).drop("bucket")
        kept = _dealt(old.join(wrong, "chunk_id", "left_anti").select(*fresh.columns), buckets)
        # written apart first: the buckets that are replaced are read here
        mended = f"{path}/_mended-{uuid.uuid4().hex}"
        _write(kept.unionByName(fresh), mended, arm, buckets)
        for number in numbers:
            made, place = at(f"{mended}/{arm}/bucket={number}"), at(f"{path}/{arm}/bucket={number}")
            fs.delete(place, True)
            if fs.exists(made) and not fs.rename(made, place):  # else only rows of chunks that are gone were in it
                raise OSError(f"{made} can't be moved to {place}")
        fs.delete(at(mended), True)
    return report
