"""One page of the fused ranking of all matches, without ranking all matches.

The e-th best fused score is at least 1 / (k + e), given by any arm that has e hits. A chunk that no arm has
among its first d can score no more than A / (k + d + 1) with A arms. So rows below depth A (k + e) - k of all
arms can't enter a page that ends at e: the arms are read to that depth and no further. What is missing is the
place of a candidate in an arm where it stands deeper; it is found by counting the arm's scores that come
before it, in the tasks that make them. Totals are plain counts.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.operators.fusion import RRF_K, SearchIndex, clamp_page_size, rrf_fuse_arms
from spanlake.operators.lexical import all_scores, best_passages, bm25_search, passage_search, rank_hits
from spanlake.operators.vectors import all_similarities, vector_search
from spanlake.ordered import top_k
from spanlake.runtime import has_at_most, stored

#: candidates whose places are counted in the tasks; for more the arm is ranked as a whole
SMALL = 200_000


def _counter(marks: dict[object, tuple[np.ndarray, list[str], int]], query_type: pa.DataType):
    """Rows (query_id, mark, n): how many rows of the pool come before each mark, but not before the one ahead of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[object, np.ndarray] = {}
        for batch in batches:
            coded = batch.column("query_id").dictionary_encode()
            who = coded.indices.to_numpy(zero_copy_only=False)
            below = -np.round(batch.column("score").to_numpy(zero_copy_only=False), 9)
            ids = batch.column("chunk_id")
            for q, name in enumerate(coded.dictionary.to_pylist()):
                if name not in marks:
                    continue
                scores, names, _ = marks[name]
                rows = np.flatnonzero(who == q)
                lo, hi = np.searchsorted(scores, below[rows], "left"), np.searchsorted(scores, below[rows], "right")
                for i in np.flatnonzero(lo < hi):  # equal scores go by id
                    lo[i] += bisect_right(names[lo[i] : hi[i]], ids[int(rows[i])].as_py())
                found = np.bincount(lo, minlength=len(scores) + 1)
                totals[name] = totals[name] + found if name in totals else found
        rows = [(name, j, int(n)) for name, counts in totals.items() for j, n in enumerate(counts[:-1]) if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], query_type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())],
            names=["query_id", "mark", "n"],
        )

    return run


def places(pool: DataFrame, wanted: DataFrame) -> DataFrame:
    """``pool`` rows (query_id, chunk_id, score, ...) of the ``wanted`` (query_id, chunk_id) with their rank in the pool."""
    own = stored(pool.join(wanted, ["query_id", "chunk_id"], "left_semi"), "own-scores")
    if not has_at_most(own, SMALL):
        return rank_hits(pool, 0).join(wanted, ["query_id", "chunk_id"], "left_semi")
    by = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("chunk_id").asc())
    marked = stored(own.withColumn("mark", F.row_number().over(by) - 1), "marks")
    local = marked.select("query_id", "mark", "chunk_id", "score").orderBy("query_id", "mark").toArrow()  # at most SMALL rows
    marks: dict[object, tuple[np.ndarray, list[str], int]] = {}
    names, below, ids = local["query_id"].to_pylist(), -np.round(local["score"].to_numpy(), 9), local["chunk_id"].to_pylist()
    starts = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
    for lo, hi in zip(starts, [*starts[1:], len(names)]):
        marks[names[lo]] = below[lo:hi], ids[lo:hi], lo
    kind = pool.schema["query_id"].dataType.simpleString()
    counted = pool.select("query_id", "chunk_id", "score").mapInArrow(_counter(marks, local.schema.field("query_id").type), f"query_id {kind}, mark int, n long")
    counted = counted.groupBy("query_id", "mark").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("query_id").orderBy("mark").rowsBetween(Window.unboundedPreceding, 0)
    ranked = marked.join(counted, ["query_id", "mark"], "left").withColumn("rank", F.sum(F.coalesce("n", F.lit(0))).over(upto) + 1)
    return ranked.withColumn("rank", F.col("rank").cast("int")).drop("mark", "n")


class _Arm:
    """How an arm is read to a depth, and all of its scores."""

    def __init__(self, read: Callable[[int], DataFrame], pool: Callable[[], DataFrame]):
        self.read, self.pool = read, pool

    def ranks(self, depth: int) -> DataFrame:
        self.top = stored(self.read(depth), "arm")
        return self.top

    def of(self, candidates: DataFrame, depth: int) -> DataFrame:
        """The arm's rank of every candidate that it holds."""
        full = self.top.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= depth).select("query_id")
        pair = ["query_id", "chunk_id"]
        deep = stored(candidates.join(full, "query_id", "left_semi").join(self.top.select(*pair), pair, "left_anti"), "deep")
        shown = self.top.join(candidates, pair, "left_semi")
        return shown if deep.isEmpty() else shown.unionByName(places(self.pool(), deep).select(*shown.columns))


def _totals(queries: DataFrame, index: SearchIndex, mode: str) -> DataFrame:
    """(query_id, total): chunks with a token of the query, or a vector if the query has one."""
    has = F.coalesce(F.size("vec") > 0, F.lit(False)) if "vec" in queries.columns and mode != "keyword" else F.lit(False)
    embedded = index.chunks.filter(F.size("vec") > 0).select("chunk_id") if "vec" in index.chunks.columns else None
    n = embedded.count() if embedded is not None and mode != "keyword" else 0
    out = queries.select("query_id", F.when(has, F.lit(n)).otherwise(0).cast("long").alias("vectors"), has.alias("has"))
    if mode == "semantic":
        return out.select("query_id", F.col("vectors").alias("total"))
    matched = all_scores(queries, index.keyword).select("query_id", "chunk_id")
    if n:
        matched = matched.join(embedded.withColumn("both", F.lit(1)), "chunk_id", "left")
    else:
        matched = matched.withColumn("both", F.lit(None).cast("int"))
    counted = matched.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("both").alias("both"))
    seen = F.coalesce("n", F.lit(0)) - F.when(F.col("has"), F.coalesce("both", F.lit(0))).otherwise(0)
    return out.join(counted, "query_id", "left").select("query_id", (F.col("vectors") + seen).alias("total"))


def hybrid_page(queries: DataFrame, index: SearchIndex, requests: DataFrame, mode: str = "hybrid", k: int = RRF_K) -> DataFrame:
    """The requested page of the fused ranking of all matches: (query_id, chunk_id, score, bm25, vector, start, end,
    rank, page, page_size, total, pages, score_norm).

    requests: (query_id, page, page_size). Pages and sizes are clamped; every embedded chunk matches a query
    that has a vector. A query without matches has no rows.
    """
    mode = mode if mode in ("keyword", "semantic") else "hybrid"
    totals = stored(_totals(queries, index, mode), "totals")
    asked = (
        requests.select("query_id", F.col("page").cast("int").alias("page"), clamp_page_size(F.col("page_size")).alias("page_size"))
        .join(totals, "query_id")
        .withColumn("pages", F.greatest(F.ceil(F.col("total") / F.col("page_size")), F.lit(1)).cast("int"))
        .withColumn("page", F.least(F.greatest(F.col("page"), F.lit(1)), F.col("pages")))
    )
    asked = stored(asked, "requests")
    end = asked.agg(F.max(F.least(F.col("page") * F.col("page_size"), F.col("total")))).first()[0] or 0
    arms: list[_Arm | None] = [None, None, None]
    if mode != "semantic":
        arms[0] = _Arm(lambda d: bm25_search(queries, index.keyword, d), lambda: all_scores(queries, index.keyword))
        arms[1] = _Arm(lambda d: passage_search(queries, index.passages, d), lambda: best_passages(queries, index.passages))
    if mode != "keyword" and "vec" in queries.columns and "vec" in index.chunks.columns:
        arms[2] = _Arm(lambda d: vector_search(queries, index.chunks, d), lambda: all_similarities(queries, index.chunks))
    live = [a for a in arms if a]
    reach = len(live) * (k + int(end))
    # far down, scores lie so close that they tie at nine places: read a little deeper
    depth = max(1, reach - k + math.ceil(4e-9 * reach * (k + int(end))))
    pair = ["query_id", "chunk_id"]
    if not live:
        empty = vector_search(queries.select("query_id", F.lit(None).cast("array<float>").alias("vec")), index.chunks.select("chunk_id", F.lit(None).cast("array<float>").alias("vec")), 1)
        arms[2], ranks = None, [None, None, empty]
    else:
        seen = [a.ranks(depth).select(*pair) for a in live]
        candidates = seen[0]
        for other in seen[1:]:
            candidates = candidates.union(other)
        candidates = stored(candidates.distinct(), "candidates")
        ranks = [a and a.of(candidates, depth) for a in arms]
    fused = rrf_fuse_arms(*ranks, k)
    # only rows up to the page are ranked, and they stand where they would in the whole ranking
    best = top_k(fused, ["query_id"], [F.round("score", 9).desc(), F.col("chunk_id").asc()], max(1, int(end)))
    best = stored(best, "page")
    top = best.filter("rank = 1").select("query_id", F.col("score").alias("top"))
    on_page = (F.col("rank") > (F.col("page") - 1) * F.col("page_size")) & (F.col("rank") <= F.col("page") * F.col("page_size"))
    return (
        best.join(asked, "query_id").filter(on_page).join(top, "query_id")
        .withColumn("score_norm", F.coalesce(F.try_divide(F.col("score"), F.col("top")), F.lit(0.0)))
        .drop("top")
    )
