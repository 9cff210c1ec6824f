"""Session helpers: reliable lineage cuts and checked sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by ``spark.checkpoint.dir``; fall back only on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spanlake-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return it without its lineage.

    Used where a result must be the same each time it is read (range partition ids, loop state)
    and where an iterative plan would otherwise grow with every round.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def has_at_most(df: DataFrame, rows: int) -> bool:
    """True when ``df`` has no more than ``rows`` rows; stops counting one row beyond."""
    return df.limit(rows + 1).count() <= rows


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()


def salt_of(*cols, salts: int):
    """Deterministic salt in [0, salts) from a row's own key columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Files are looked up by a few tasks per core; by default a list of files, like a batch of a file stream,
    takes a task for each file. Counts for streams read by this session as long as it lasts.
    """
    before = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(_LISTING, before)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder; no two calls give the same one."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to ``path``, else to the shared folder, and return the table: its lineage ends
    there, so a lost executor costs no earlier step, and reading it prunes columns.

    Nothing reads the shuffle files of the step again, so Spark is told to delete them at its end.
    """
    spark = df.sparkSession
    path = path or shared_path(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
