"""Reciprocal rank fusion and the searches composed from it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import query_variants
from spanlake.functions.wordlists import PAGE_SIZES, SUGGESTION_SUFFIXES
from spanlake.operators.blocks import BlockIndex, build_blocks, build_passage_blocks
from spanlake.operators.lexical import LexicalIndex, bm25_search, passage_search, rank_hits
from spanlake.operators.vectors import vector_search
from spanlake.ordered import top_k, with_ordinal

RRF_K = 60


class SearchIndex:
    """The three arms of retrieval over one chunk table (chunk_id, content, vec).

    An arm that is not given is built when it is first searched, as blocks in the shared folder.
    """

    def __init__(self, chunks: DataFrame, keyword: LexicalIndex | BlockIndex | None = None, passages: LexicalIndex | BlockIndex | None = None):
        self.chunks = chunks
        self._keyword, self._passages = keyword, passages

    @property
    def keyword(self) -> LexicalIndex | BlockIndex:
        if self._keyword is None:
            self._keyword = build_blocks(self.chunks)
        return self._keyword

    @property
    def passages(self) -> LexicalIndex | BlockIndex:
        if self._passages is None:
            self._passages = build_passage_blocks(self.chunks)
        return self._passages


def _arm(df: DataFrame | None, keyword: bool, k: int) -> DataFrame | None:
    if df is None:
        return None
    part = F.lit(1.0) / (F.lit(k) + F.col("rank"))
    has_span = "start" in df.columns
    return df.select(
        "query_id",
        "chunk_id",
        (part if keyword else F.lit(0.0)).alias("bm25"),
        (F.lit(0.0) if keyword else part).alias("vector"),
        (F.col("start") if has_span else F.lit(None).cast("int")).alias("start"),
        (F.col("end") if has_span else F.lit(None).cast("int")).alias("end"),
    )


def rrf_fuse_arms(
    bm25: DataFrame | None, passage: DataFrame | None, vector: DataFrame | None, k: int = RRF_K
) -> DataFrame:
    """(query_id, chunk_id, score, bm25, vector, start, end): each arm adds 1/(k + rank)."""
    arms = [a for a in (_arm(bm25, True, k), _arm(passage, True, k), _arm(vector, False, k)) if a is not None]
    return (
        reduce(DataFrame.unionByName, arms)
        .groupBy("query_id", "chunk_id")
        .agg(
            F.sum("bm25").alias("bm25"),
            F.sum("vector").alias("vector"),
            F.max("start").alias("start"),
            F.max("end").alias("end"),
        )
        .withColumn("score", F.col("bm25") + F.col("vector"))
    )


def rrf_fuse_lists(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, score) over any number of ranked lists (query_id, list_id, chunk_id, rank)."""
    return ranked.groupBy("query_id", "chunk_id").agg(
        F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score")
    )


def match_kind(bm25: Column, vector: Column) -> Column:
    return (
        F.when((bm25 > 0) & (vector > 0), "hybrid").when(vector > 0, "semantic").otherwise("keyword")
    )


def hybrid_search(
    queries: DataFrame, index: SearchIndex, mode: str = "hybrid", limit: int = 10, k: int = RRF_K, scan_factor: int | None = None
) -> DataFrame:
    """(query_id, chunk_id, score, bm25, vector, start, end, rank).

    With a limit, each arm brings max(3 * limit, 20) candidates; without, all keyword matches and every embedded
    chunk (for a page of that ranking see ``paging.hybrid_page``). A query without a vector is ranked
    by the other arms alone. ``scan_factor`` cuts the passage arm (see ``passage_search``).
    """
    mode = mode if mode in ("keyword", "semantic") else "hybrid"
    arm_limit = max(3 * limit, 20) if limit > 0 else 0
    bm25 = passage = vector = None
    if mode != "semantic":
        bm25 = bm25_search(queries, index.keyword, arm_limit)
        passage = passage_search(queries, index.passages, arm_limit, scan_factor=scan_factor)
    if mode != "keyword" and "vec" in queries.columns:
        depth = arm_limit or max(1, index.chunks.filter(F.size("vec") > 0).count())
        vector = vector_search(queries, index.chunks, depth)
    if bm25 is None and vector is None:
        vector = vector_search(
            queries.withColumn("vec", F.lit(None).cast("array<float>")), index.chunks, 1
        )
    return rank_hits(rrf_fuse_arms(bm25, passage, vector, k), limit)


def clamp_page_size(size: Column) -> Column:
    """Nearest offered page size, the smaller one on a tie; 12 for zero or less."""
    best = F.array_min(
        F.array(*[F.struct(F.abs(F.lit(s) - size).alias("d"), F.lit(s).alias("s")) for s in PAGE_SIZES])
    )
    return F.when(size <= 0, F.lit(PAGE_SIZES[0])).otherwise(best["s"])


def ranked_page(pool: DataFrame, requests: DataFrame) -> DataFrame:
    """One page per request out of each query's ranked pool.

    pool: (query_id, chunk_id, score, rank 1-based); requests: (query_id, page, page_size). Adds
    total, pages, the clamped page and size, and score_norm against the pool's top score. The pool
    is ranked already, so a page is a filter on rank; totals are a plain aggregate.
    """
    totals = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("total"), F.max("score").alias("top"))
    req = (
        requests.join(totals, "query_id", "left")
        .withColumn("total", F.coalesce("total", F.lit(0)))
        .withColumn("page_size", clamp_page_size(F.col("page_size")))
        .withColumn("pages", F.greatest(F.ceil(F.col("total") / F.col("page_size")), F.lit(1)).cast("int"))
        .withColumn("page", F.least(F.greatest(F.col("page"), F.lit(1)), F.col("pages")))
    )
    return (
        pool.join(req, "query_id")
        .filter(
            (F.col("rank") > (F.col("page") - 1) * F.col("page_size"))
            & (F.col("rank") <= F.col("page") * F.col("page_size"))
        )
        .withColumn("score_norm", F.coalesce(F.try_divide(F.col("score"), F.col("top")), F.lit(0.0)))
        .drop("top")
    )


def expand_queries(nodes: DataFrame) -> DataFrame:
    """(node_id, variant, query) from (node_id, title, body, parent_title)."""
    return nodes.select(
        "node_id", F.posexplode(query_variants("title", "body", "parent_title")).alias("variant", "query")
    )


def suggest(
    nodes: DataFrame, index: SearchIndex, used: DataFrame | None = None, limit: int = 5, scan_factor: int | None = None
) -> DataFrame:
    """Chunk suggestions for nodes: (node_id, rank, chunk_id, label, score, confidence).

    ``nodes`` may carry ``vec`` as the query vector of its variants.
    """
    variants = expand_queries(nodes).select(
        "node_id",
        F.col("query").alias("text"),
        F.concat_ws("#", F.col("node_id").cast("string"), F.col("variant").cast("string")).alias("query_id"),
    )
    if "vec" in nodes.columns:
        variants = variants.join(nodes.select("node_id", "vec"), "node_id")
    hits = hybrid_search(variants.drop("node_id"), index, limit=2 * limit, scan_factor=scan_factor)
    lists = hits.join(variants.select("node_id", "query_id"), "query_id").select(
        F.col("node_id").alias("query_id"), F.col("query_id").alias("list_id"), "chunk_id", "rank"
    )
    fused = rrf_fuse_lists(lists).withColumnRenamed("query_id", "node_id")
    if used is not None:
        fused = fused.join(used.select("node_id", "chunk_id").distinct(), ["node_id", "chunk_id"], "left_anti")
    ranked = top_k(fused, ["node_id"], [F.round("score", 9).desc(), F.col("chunk_id").asc()], limit)
    best = ranked.filter("rank = 1").select("node_id", F.col("score").alias("top"))
    suffixes = F.array(*[F.lit(s) for s in SUGGESTION_SUFFIXES])
    return (
        ranked.join(best, "node_id")
        .join(nodes.select("node_id", "title"), "node_id")
        .select(
            "node_id",
            "rank",
            "chunk_id",
            F.concat(
                F.trim("title"),
                F.lit(" — "),
                F.element_at(suffixes, (F.col("rank") - 1) % len(SUGGESTION_SUFFIXES) + 1),
            ).alias("label"),
            "score",
            F.coalesce(F.try_divide(F.col("score"), F.col("top")), F.lit(0.0)).alias("confidence"),
        )
    )


def context_check(
    nodes: DataFrame, node_chunks: DataFrame, index: SearchIndex, threshold: float | None = None,
    scan_factor: int | None = None,
) -> DataFrame:
    """Does a node's evidence fit its parent: (node_id, score, in_context, message).

    nodes: (node_id, parent_title [, vec]); node_chunks: (node_id, chunk_id).
    """
    threshold = 0.3 if threshold is None else threshold
    asked = nodes.filter(F.coalesce("parent_title", F.lit("")) != "")
    queries = asked.select(
        F.col("node_id").alias("query_id"),
        F.col("parent_title").alias("text"),
        *([F.col("vec")] if "vec" in nodes.columns else []),
    )
    hits = hybrid_search(queries, index, limit=50, scan_factor=scan_factor).select(
        F.col("query_id").alias("node_id"), "chunk_id", "score", "rank"
    )
    top = hits.filter("rank = 1").select("node_id", F.col("score").alias("top"))
    scored = (
        node_chunks.join(asked.select("node_id"), "node_id", "left_semi")
        .join(hits.drop("rank"), ["node_id", "chunk_id"], "left")
        .join(top, "node_id", "left")
        .groupBy("node_id")
        .agg(F.avg(F.coalesce(F.try_divide(F.col("score"), F.col("top")), F.lit(0.0))).alias("score"))
    )
    return (
        nodes.select("node_id")
        .join(scored, "node_id", "left")
        .withColumn("score", F.coalesce("score", F.lit(1.0)))
        .withColumn("in_context", F.col("score") >= threshold)
        .withColumn("message", F.when(F.col("in_context"), "").otherwise("Out of Context"))
    )


__all__: Sequence[str] = [
    "SearchIndex",
    "clamp_page_size",
    "context_check",
    "expand_queries",
    "hybrid_search",
    "match_kind",
    "ranked_page",
    "rrf_fuse_arms",
    "rrf_fuse_lists",
    "suggest",
    "with_ordinal",
]
