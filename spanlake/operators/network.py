"""Similarity graphs over chunks, files and regions, and the versioned network build."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.functions.text import trim_runes
from spanlake.functions.vectors import stub_embed
from spanlake.operators.cluster import ClusterParams, cluster_chunks
from spanlake.operators.corpus import chunks_with_vector
from spanlake.operators.digest import digest_regions, label_chunks, labels_missing, transcript_digests_cached, upsert_labels
from spanlake.operators.keywords import extractive_digest, tag_regions
from spanlake.operators.vectors import block_topk
from spanlake.ordered import top_k, with_ordinal
from spanlake.runtime import cut

CACHE_SCHEMA = (
    "input_hash string, kind string, title string, abstract string, keywords array<string>, vec array<float>, source string"
)
LABEL_SCHEMA = "chunk_id string, label string, source string"


def knn_edges(vecs: DataFrame, k: int, min_weight: float, block_rows: int | None = None) -> DataFrame:
    """(a, b, weight) with a < b: an edge is kept when either end has the other among its k nearest.

    vecs: (id, vec). Blocked products; each task passes on at most k neighbours per row.
    """
    rows = vecs.filter(F.size("vec") > 0)
    left = rows.select(F.col("id").alias("left_id"), F.col("vec").alias("left_vec"))
    right = rows.select(F.col("id").alias("right_id"), F.col("vec").alias("right_vec"))
    extra = {"block_rows": block_rows} if block_rows else {}
    near = block_topk(left, right, k, min_sim=min_weight, exclude_self=True, **extra)
    return near.groupBy(F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")).agg(
        F.max("sim").alias("weight")
    )


def region_links(regions: DataFrame, k: int = 6, min_weight: float | None = None) -> DataFrame:
    """(region_a, region_b, weight) between centroids; region_a < region_b."""
    floor = 0.15 if min_weight is None else min_weight
    vecs = regions.select(F.col("region_id").alias("id"), F.col("centroid").cast("array<float>").alias("vec"))
    return knn_edges(vecs, k, floor).select(F.col("a").alias("region_a"), F.col("b").alias("region_b"), "weight")


def chunk_edges(
    chunks: DataFrame, k: int = 6, min_weight: float | None = None, keep_fraction: float = 1.0, block_rows: int | None = None
) -> DataFrame:
    """(a, b, weight) between chunks; optionally only the strongest share of all edges."""
    floor = 0.35 if min_weight is None else min_weight
    edges = knn_edges(chunks.select(F.col("chunk_id").alias("id"), "vec"), k, floor, block_rows)
    if not 0 < keep_fraction < 1:
        return edges
    edges = cut(edges)
    keep = edges.agg(F.ceil(F.count(F.lit(1)) * F.lit(keep_fraction)).alias("keep"))
    ranked = with_ordinal(edges, [], [F.round("weight", 9).desc(), F.col("a").asc(), F.col("b").asc()], "pos")
    return ranked.crossJoin(F.broadcast(keep)).filter(F.col("pos") < F.col("keep")).select("a", "b", "weight")


def transcript_edges(edges: DataFrame, chunks: DataFrame, k: int = 4) -> DataFrame:
    """(a, b, weight) between source files: their strongest chunk edge; each file keeps its k best,
    an edge stays when either file keeps it."""
    of = chunks.filter(F.coalesce("source_file", F.lit("")) != "")
    fa = of.select(F.col("chunk_id").alias("a"), F.col("source_file").alias("fa"))
    fb = of.select(F.col("chunk_id").alias("b"), F.col("source_file").alias("fb"))
    pairs = (
        edges.join(fa, "a")
        .join(fb, "b")
        .filter((F.col("fa") != F.col("fb")) & (F.col("weight") > 0))
        .groupBy(F.least("fa", "fb").alias("x"), F.greatest("fa", "fb").alias("y"))
        .agg(F.max("weight").alias("weight"))
    )
    both = pairs.select(F.col("x").alias("me"), F.col("y").alias("other"), "weight").unionByName(
        pairs.select(F.col("y").alias("me"), F.col("x").alias("other"), "weight")
    )
    kept = top_k(both, ["me"], [F.round("weight", 9).desc(), F.col("other").asc()], k)
    return kept.select(
        F.least("me", "other").alias("a"), F.greatest("me", "other").alias("b"), "weight"
    ).distinct()


def tag_files(
    members: DataFrame, chunks: DataFrame, min_share: float = 0.15, margin: float = 0.1, max_extra: int = 2
) -> DataFrame:
    """(source_file, rank, region_id, share): the region holding most of a file, and close seconds."""
    rows = members.select("region_id", "chunk_id").join(
        chunks.filter(F.coalesce("source_file", F.lit("")) != "").select("chunk_id", "source_file"), "chunk_id"
    )
    counts = rows.groupBy("source_file", "region_id").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("source_file").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "source_file").withColumn("share", F.col("n") / F.col("total"))
    ranked = top_k(shares, ["source_file"], [F.col("share").desc(), F.col("region_id").asc()], 1 + max_extra)
    w = Window.partitionBy("source_file")  # at most 1 + max_extra rows each
    return (
        ranked.withColumn("top", F.max("share").over(w))
        .filter((F.col("rank") == 1) | ((F.col("share") >= min_share) & (F.col("share") >= F.col("top") - margin)))
        .select("source_file", "rank", "region_id", "share")
    )


# ---- build ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class BuildParams:
    cluster: ClusterParams = field(default_factory=ClusterParams)
    link_k: int = 6
    link_min_weight: float | None = None
    min_chunks: int = 12


class BuildStore:
    """Build tables under one folder, partitioned by build_id; a build counts once its row says ready."""

    TABLES = ("regions", "region_members", "region_links", "transcript_digests")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        p, fs = self._fs(f"{self.path}/{name}")
        return fs.exists(p)

    def drop(self, rel: str) -> None:
        p, fs = self._fs(f"{self.path}/{rel}")
        fs.delete(p, True)

    def write(self, name: str, build_id: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/build_id={build_id}")

    def read(self, name: str, build_id: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}")
        return df if build_id is None else df.filter(F.col("build_id") == build_id)

    def mark(self, build_id: str, status: str, chunk_count: int, params: str, error: str = "") -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self.write(
            "builds",
            build_id,
            self.spark.createDataFrame(
                [(now, status, chunk_count, params, error)],
                "created_at timestamp, status string, chunk_count long, params string, error string",
            ),
        )

    def builds(self) -> DataFrame:
        return self.read("builds")


def build_atlas(
    store: BuildStore, build_id: str, chunks: DataFrame, params: BuildParams | None = None, cache: DataFrame | None = None,
    labels: DataFrame | None = None, complete=None, model: str = "llm", embed=stub_embed, summarise=extractive_digest,
) -> tuple[DataFrame, DataFrame]:
    """Cluster, digest (by ``summarise``), link and label the embedded chunks as a new build; returns the new digest
    cache and label table. A failure removes what was written and is raised again."""
    p = params or BuildParams()
    spark = chunks.sparkSession
    cache = cache if cache is not None else spark.createDataFrame([], CACHE_SCHEMA)
    labels = labels if labels is not None else spark.createDataFrame([], LABEL_SCHEMA)
    rows = cut(chunks_with_vector(chunks).select("chunk_id", "source_file", "content", "start_offset", "vec"))
    count = rows.count()
    if count < p.min_chunks:
        raise ValueError(f"{count} embedded chunks, at least {p.min_chunks} needed")
    spec = json.dumps({**asdict(p.cluster), "link_k": p.link_k, "link_min_weight": p.link_min_weight})
    store.mark(build_id, "building", count, spec)
    try:
        regions, members = cluster_chunks(rows, p.cluster)
        digests, new_cache = digest_regions(members, rows, cache, complete, model, embed, summarise=summarise)
        digests, new_cache = cut(digests), cut(new_cache)
        full = regions.join(digests.withColumnRenamed("vec", "digest_vec"), "region_id")
        full, members = tag_regions(full, members, rows)
        store.write("regions", build_id, full)
        store.write("region_members", build_id, members)
        # links need the final region ids
        store.write("region_links", build_id, region_links(regions, p.link_k, p.link_min_weight))
        files, new_cache = transcript_digests_cached(rows, new_cache, complete, model, summarise)
        files, new_cache = cut(files), cut(new_cache)
        store.write("transcript_digests", build_id, files)
        if complete is not None:
            missing = rows.join(labels_missing(rows, labels), "chunk_id", "left_semi")
            labels = cut(upsert_labels(labels, label_chunks(missing, complete, model)))
        store.mark(build_id, "ready", count, spec)
    except Exception as exc:
        for name in BuildStore.TABLES:
            store.drop(f"{name}/build_id={build_id}")
        store.mark(build_id, "failed", count, spec, str(exc)[:500])
        raise
    return new_cache, labels


def current_build_id(builds: DataFrame) -> DataFrame:
    """(build_id): the newest ready build, one row or none."""
    return (
        builds.filter("status = 'ready'")
        .agg(F.max(F.struct("created_at", "build_id")).alias("m"))
        .filter(F.col("m").isNotNull())
        .select("m.build_id")
    )


def of_current(builds: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the newest ready build."""
    return rows.join(current_build_id(builds), "build_id", "left_semi")


def build_counts(builds: DataFrame, regions: DataFrame, members: DataFrame, links: DataFrame) -> DataFrame:
    """(build_id, regions, chunks, links) of every build."""

    def per(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("build_id").agg(F.count(F.lit(1)).alias(name))

    out = builds.select("build_id")
    for df, name in ((regions, "regions"), (members, "chunks"), (links, "links")):
        out = out.join(per(df, name), "build_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def prune_builds(store: BuildStore) -> list[str]:
    """Drop the partitions of every build but the current one; returns the dropped ids."""
    keep = {r["build_id"] for r in current_build_id(store.builds()).collect()}
    gone = [r["build_id"] for r in store.builds().select("build_id").distinct().collect() if r["build_id"] not in keep]
    for b in gone:
        for name in (*BuildStore.TABLES, "builds"):
            store.drop(f"{name}/build_id={b}")
    return gone


def staleness(chunks: DataFrame, build: DataFrame) -> DataFrame:
    """(embedded, built, behind, stale): one row; stale when more than a tenth has been added."""
    now = chunks_with_vector(chunks).agg(F.count(F.lit(1)).alias("embedded"))
    built = build.agg(F.coalesce(F.max("chunk_count"), F.lit(0)).alias("built"))
    return (
        now.crossJoin(built)  # one row each
        .withColumn("behind", F.col("embedded") - F.col("built"))
        .withColumn("stale", F.col("behind") * 10 > F.col("built"))
    )


# ---- payloads ------------------------------------------------------------------------------------


def transcript_label(keywords: Column, title: Column, source_file: Column) -> Column:
    return (
        F.when(F.size(keywords) > 0, F.array_join(F.slice(keywords, 1, 3), " · "))
        .when(F.coalesce(title, F.lit("")) != "", title)
        .otherwise(source_file)
    )


def network_payload(
    regions: DataFrame, members: DataFrame, chunks: DataFrame, digests: DataFrame, k: int = 10, min_weight: float = 0.3,
    file_k: int = 12,
) -> dict[str, DataFrame]:
    """Tags (regions), transcripts with labels and tags, and file edges of a build.

    regions: (region_id, title, keywords, chunk_count); members: (region_id, chunk_id);
    chunks: (chunk_id, source_file, vec); digests: (source_file, title, keywords).
    """
    mine = chunks.join(members.select("chunk_id"), "chunk_id", "left_semi")
    tags = tag_files(members, chunks)
    listed = tags.groupBy("source_file").agg(  # at most three tags per file
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "region_id"))), lambda t: t["region_id"]).alias("tags")
    )
    counts = mine.groupBy("source_file").agg(F.count(F.lit(1)).alias("chunks"))
    transcripts = (
        counts.join(listed, "source_file", "left")
        .join(digests.select("source_file", "title", "keywords"), "source_file", "left")
        .select(
            "source_file",
            transcript_label(F.col("keywords"), F.col("title"), F.col("source_file")).alias("label"),
            "title",
            "keywords",
            "chunks",
            F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        )
    )
    return {
        "tags": regions.select("region_id", "title", "keywords", F.col("chunk_count").alias("chunks")),
        "transcripts": transcripts,
        "edges": transcript_edges(chunk_edges(mine, k, min_weight), mine, file_k),
    }


def region_detail(
    region_ids: DataFrame, regions: DataFrame, members: DataFrame, links: DataFrame, chunks: DataFrame, labels: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Members (region_id, chunk_id, source_file, distance, label, snippet) and neighbours
    (region_id, other, title, weight) of the wanted regions."""
    mem = (
        members.join(region_ids.select("region_id"), "region_id", "left_semi")
        .join(chunks.select("chunk_id", "source_file", "content"), "chunk_id")
        .join(labels.select("chunk_id", "label"), "chunk_id", "left")
        .select("region_id", "chunk_id", "source_file", "distance", "label", trim_runes("content", 320).alias("snippet"))
    )
    both = links.select(F.col("region_a").alias("region_id"), F.col("region_b").alias("other"), "weight").unionByName(
        links.select(F.col("region_b").alias("region_id"), F.col("region_a").alias("other"), "weight")
    )
    near = both.join(region_ids.select("region_id"), "region_id", "left_semi").join(
        regions.select(F.col("region_id").alias("other"), "title"), "other", "left"
    )
    return mem, near.select("region_id", "other", "title", "weight")


def transcript_detail(source_files: DataFrame, chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """(source_file, start_offset, chunk_id, summary, snippet): a file's chunks, to be read by start_offset."""
    return (
        chunks.join(source_files.select("source_file").distinct(), "source_file", "left_semi")
        .join(labels.select("chunk_id", "label"), "chunk_id", "left")
        .select(
            "source_file",
            "start_offset",
            "chunk_id",
            F.coalesce(F.nullif("label", F.lit("")), trim_runes("content", 60)).alias("summary"),
            trim_runes("content", 320).alias("snippet"),
        )
    )
