"""Keyword index and BM25 ranking over whole tables of queries.

``LexicalIndex`` holds postings as rows, for changes and joins; ``blocks.BlockIndex`` holds them packed, for
searches. Every function that ranks or weighs takes either.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.text import chunk_passages, tokenize
from spanlake.operators.blocks import BlockIndex, block_search
from spanlake.operators.vectors import best_per_row
from spanlake.ordered import top_k, with_ordinal
from spanlake.runtime import has_at_most, salt_of

K1 = 1.2
B = 0.75
SMALL_TERMS = 200_000  # (query, term) rows that may be broadcast
SMALL_QUERIES = 2048  # queries whose weights may be shipped to every task
DOC_BLOCK = 1024
COUNTED_TOKENS = 1 << 19  # tokens that are counted at a time, or those of one text


@dataclass(frozen=True)
class LexicalIndex:
    """postings(term, *ids, tf, dl), doc_stats(*ids, dl), stats(n_docs, avg_dl: one row)."""

    postings: DataFrame
    doc_stats: DataFrame
    ids: tuple[str, ...]

    @property
    def stats(self) -> DataFrame:
        return self.doc_stats.agg(
            F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avg_dl")
        )

    def frequencies(self, asked: DataFrame) -> DataFrame:
        """(term, df) of the asked terms that occur."""
        return self.postings.join(asked, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def build_bm25(docs: DataFrame, ids: Sequence[str] = ("chunk_id",), text: str = "content") -> LexicalIndex:
    """Keyword index of ``docs``, whose ids are unique. The document length rides along in the postings, so
    ranking needs no join back to the documents.

    Terms are counted where a text is read: neither texts nor tokens are shuffled.
    """
    return _index(docs.select(*ids, text), ids, text)


def _index(docs: DataFrame, ids: Sequence[str], text: str) -> LexicalIndex:
    toks = docs.select(*ids, F.coalesce(tokenize(text), F.array().cast("array<string>")).alias("toks"))
    return LexicalIndex(count_terms(toks, ids), toks.select(*ids, F.size("toks").alias("dl")), tuple(ids))


def count_terms(toks: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(term, *ids, tf, dl) of rows (*ids, toks), counted row by row in the task that has them."""
    fields = [toks.schema[c] for c in ids]
    out = T.StructType([T.StructField("term", T.StringType()), *fields, T.StructField("tf", T.IntegerType()), T.StructField("dl", T.IntegerType())])
    return toks.mapInArrow(_counted(list(ids)), out)


def _counted(ids: list[str]):
    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        upto, lo = batch.column("toks").offsets.to_numpy(), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + COUNTED_TOKENS, side="right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole)):
            toks = batch.column("toks")
            dl = np.diff(toks.offsets.to_numpy())
            coded = toks.flatten().dictionary_encode()
            key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            wide = max(1, len(coded.dictionary))
            found, tf = np.unique(np.repeat(np.arange(batch.num_rows), dl) * wide + key, return_counts=True)
            row = found // wide
            yield pa.RecordBatch.from_arrays(
                [
                    coded.dictionary.take(pa.array(found % wide)), *(batch.column(c).take(pa.array(row)) for c in ids),
                    pa.array(tf, pa.int32()), pa.array(dl[row], pa.int32()),
                ],
                names=["term", *ids, "tf", "dl"],
            )

    return run


def build_passages(docs: DataFrame, ids: Sequence[str] = ("chunk_id",), outer: bool = False) -> DataFrame:
    """passages(*ids, start, end, text); with ``outer`` a chunk without passages has one row of nulls."""
    cut_up = docs.select(*ids, F.explode_outer(chunk_passages("content")).alias("p"))
    return (cut_up if outer else cut_up.filter(F.col("p").isNotNull())).select(*ids, "p.start", "p.end", "p.text")


def build_passage_index(docs: DataFrame) -> LexicalIndex:
    return _index(build_passages(docs), ("chunk_id", "start", "end"), "text")


def idf_expr(n, df):
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def weigh(terms: DataFrame, index: LexicalIndex | BlockIndex, small: bool = False) -> DataFrame:
    """(term, df, n_docs, avg_dl, idf) of each distinct term; an absent term has document frequency 0."""
    wanted = terms.select(F.lower("term").alias("term")).distinct()
    asked = F.broadcast(wanted) if small else wanted
    return (
        wanted.join(index.frequencies(asked), "term", "left")
        .withColumn("df", F.coalesce("df", F.lit(0)))
        .crossJoin(F.broadcast(index.stats))  # stats is an ungrouped aggregate: always one row
        .select("term", "df", "n_docs", "avg_dl", idf_expr(F.col("n_docs"), F.col("df")).alias("idf"))
    )


def idf(terms: DataFrame, index: LexicalIndex | BlockIndex) -> DataFrame:
    """(term, df, idf)."""
    return weigh(terms, index).select("term", "df", "idf")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf)."""
    return (
        queries.select("query_id", F.explode(tokenize("text")).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def score_bm25(queries: DataFrame, index: LexicalIndex, salts: int = 16) -> DataFrame:
    """(query_id, *ids, score) for every document sharing a token with the query.

    A query-term table of at most SMALL_TERMS rows is broadcast: postings are scored where they are,
    however frequent a term is. A larger one is joined by shuffle on (term, salt), the salt taken
    from the document id, so that a term holding a third of all postings is spread over ``salts`` tasks.
    """
    qterms = query_terms(queries)
    small = has_at_most(qterms, SMALL_TERMS)
    weighted = qterms.join(weigh(qterms, index, small), "term")
    terms = qterms.select("term").distinct()
    matched = index.postings.join(F.broadcast(terms) if small else terms, "term", "left_semi")
    if small:
        hits = matched.join(F.broadcast(weighted), "term")
    else:
        probe = weighted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hits = matched.withColumn("salt", salt_of(*index.ids, salts=salts)).join(probe, ["term", "salt"])
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    part = (
        F.col("qtf") * F.col("idf") * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / F.col("avg_dl")))
    )
    return hits.groupBy("query_id", *index.ids).agg(F.sum(part).alias("score"))


def _best_hits(queries: DataFrame, index: LexicalIndex, k: int, per_chunk: bool = False) -> DataFrame | None:
    """At most k scored hits per query and task, or None when the query table is not small.

    With ``per_chunk`` only the best hit of each first id counts, so a task gives k different ones; a
    chunk among the best k of all is among the best k of the task that has its best hit.

    The query weights (checked to be few) go to every task; a document's matching postings stand in one
    row, and a block of documents is scored against all queries at once, so that only the best hits
    become rows.
    """
    qterms = query_terms(queries)
    if not (has_at_most(qterms, SMALL_TERMS) and has_at_most(queries, SMALL_QUERIES)):
        return None
    spark = queries.sparkSession
    weights = qterms.join(weigh(qterms, index, True), "term").toArrow()  # at most SMALL_TERMS rows
    qtype = queries.schema["query_id"].dataType
    id_fields = [index.postings.schema[c] for c in index.ids]
    schema = T.StructType([T.StructField("query_id", qtype), *id_fields, T.StructField("score", T.DoubleType())])
    if weights.num_rows == 0:
        return spark.createDataFrame([], schema)
    qids, q_of = np.unique(weights["query_id"].to_pandas().to_numpy(), return_inverse=True)
    terms, t_of = np.unique(weights["term"].to_pandas().to_numpy().astype(str), return_inverse=True)
    avg = float(weights["avg_dl"][0].as_py())
    order = np.argsort(t_of, kind="stable")
    q_of = q_of[order].astype(np.int64)
    weight = (weights["qtf"].to_numpy() * weights["idf"].to_numpy())[order]
    ptr = np.searchsorted(t_of[order], np.arange(len(terms) + 1))
    numbered = spark.createDataFrame(
        pa.table({"term": pa.array(terms.tolist(), pa.string()), "t": pa.array(np.arange(len(terms)), pa.int32())})
    )
    rows = (
        index.postings.join(F.broadcast(numbered), "term")
        .groupBy(*index.ids, "dl")
        .agg(F.collect_list(F.struct("t", "tf")).alias("post"))  # at most one entry per query term
    )
    ids, q_type = list(index.ids), weights.schema.field("query_id").type

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in ids]
            for lo in range(0, batch.num_rows, DOC_BLOCK):
                part = batch.slice(lo, DOC_BLOCK)
                n = part.num_rows
                col = part.column("post")
                flat = col.flatten()
                t = flat.field("t").to_numpy(zero_copy_only=False)
                tf = flat.field("tf").to_numpy(zero_copy_only=False).astype(np.float64)
                doc = np.repeat(np.arange(n), np.diff(col.offsets.to_numpy()))
                dl = part.column("dl").to_numpy(zero_copy_only=False)[doc]
                val = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg))
                width = ptr[t + 1] - ptr[t]
                first = np.repeat(ptr[t] - np.r_[0, np.cumsum(width)[:-1]], width)
                at = first + np.arange(len(first))
                cell = q_of[at] * n + np.repeat(doc, width)
                scores = np.bincount(cell, np.repeat(val, width) * weight[at], len(qids) * n).reshape(len(qids), n)
                names = [part.column(c).to_pandas().to_numpy() for c in ids]
                place = np.empty(n, dtype=np.int64)
                place[np.lexsort([x.astype(str) if x.dtype == object else x for x in names[::-1]])] = np.arange(n)
                if per_chunk:
                    d = _best_of_each(scores, names[0], place)
                    picked = np.take_along_axis(scores, d, axis=1)
                    q, c = best_per_row(picked, np.arange(d.shape[1]), k, picked <= 0, None)
                    d = d[q, c]
                else:
                    q, d = best_per_row(scores, place, k, scores <= 0, None)
                new = [q, scores[q, d], *[x[d] for x in names]]
                both = new if kept is None else [np.concatenate([a, b]) for a, b in zip(kept, new)]
                keys = [x.astype(str) if x.dtype == object else x for x in both[2:]]
                by = np.lexsort([*keys[::-1], -np.round(both[1], 9), both[0]])
                both = [x[by] for x in both]
                if per_chunk:
                    # rows are in rank order: the first of a query and chunk stays
                    _, chunk = np.unique(both[2].astype(str), return_inverse=True)
                    _, head = np.unique(both[0] * len(chunk) + chunk, return_index=True)
                    both = [x[np.sort(head)] for x in both]
                start = np.searchsorted(both[0], both[0], side="left")
                mine = np.arange(len(both[0])) - start < k
                kept = [x[mine] for x in both]
        if kept is not None:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(qids[kept[0]], q_type),
                    *[pa.array(x, kind) for x, kind in zip(kept[2:], kinds)],
                    pa.array(kept[1], pa.float64()),
                ],
                names=["query_id", *ids, "score"],
            )

    return rows.mapInArrow(scan, schema)


def _best_of_each(scores: np.ndarray, chunk: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each query (row) and chunk the column of its best hit, equal ones by place; chunks in order of id."""
    order = np.argsort(place)
    ids = chunk[order].astype(str)
    head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    size = np.diff(np.concatenate([head, [len(ids)]]))
    rounded = np.round(scores[:, order], 9)
    best = np.repeat(np.maximum.reduceat(rounded, head, axis=1), size, axis=1)
    first = np.minimum.reduceat(np.where(rounded == best, np.arange(len(ids)), len(ids)), head, axis=1)
    return order[first]


def _block_hits(queries: DataFrame, index: BlockIndex, k: int, per_chunk: bool = False) -> DataFrame:
    qterms = query_terms(queries)
    weights = qterms.join(weigh(qterms, index), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"), "avg_dl")
    return block_search(queries, index, weights, k, per_chunk)


def bm25_search(queries: DataFrame, index: LexicalIndex | BlockIndex, k: int = 10, salts: int = 16) -> DataFrame:
    """(query_id, *ids, score, rank); ``k`` <= 0 ranks every match."""
    if isinstance(index, BlockIndex):
        return rank_hits(_block_hits(queries, index, k), k, index.ids)
    best = _best_hits(queries, index, k) if k > 0 else None
    return rank_hits(best if best is not None else score_bm25(queries, index, salts), k, index.ids)


def all_scores(queries: DataFrame, index: LexicalIndex | BlockIndex) -> DataFrame:
    """(query_id, *ids, score) of every match, in no order."""
    return _block_hits(queries, index, 0) if isinstance(index, BlockIndex) else score_bm25(queries, index)


def best_passages(queries: DataFrame, index: LexicalIndex | BlockIndex) -> DataFrame:
    """(query_id, chunk_id, score, start, end): the best passage of every chunk that has one, in no order."""
    hits = _block_hits(queries, index, 0, per_chunk=True) if isinstance(index, BlockIndex) else score_bm25(queries, index)
    return _best_of_chunk(hits)


def _best_of_chunk(hits: DataFrame) -> DataFrame:
    best = hits.groupBy("query_id", "chunk_id").agg(
        F.min(F.struct((-F.round("score", 9)).alias("neg"), "start", "end", "score")).alias("b")
    )
    return best.select("query_id", "chunk_id", "b.score", "b.start", "b.end")


def rank_hits(hits: DataFrame, k: int, ids: Sequence[str] = ("chunk_id",)) -> DataFrame:
    """Rank by score (to nine places, so equal texts tie) and then id."""
    order = [F.round("score", 9).desc(), *[F.col(c).asc() for c in ids]]
    if k > 0:
        return top_k(hits, ["query_id"], order, k)
    return with_ordinal(hits, ["query_id"], order, "rank", start=1).withColumn("rank", F.col("rank").cast("int"))


def passage_search(
    queries: DataFrame, index: LexicalIndex | BlockIndex, k: int = 10, salts: int = 16, scan_factor: int | None = None
) -> DataFrame:
    """Chunks ranked by their best passage: (query_id, chunk_id, score, start, end, rank).

    Every passage is looked at. ``scan_factor`` is a cut: only the best ``scan_factor * k`` passages of a
    query are, so that a chunk with many good ones can leave fewer than k chunks.
    """
    if k > 0 and scan_factor:
        hits = bm25_search(queries, index, scan_factor * k, salts).drop("rank")
    elif isinstance(index, BlockIndex):
        hits = _block_hits(queries, index, k, per_chunk=True)
    else:
        hits = _best_hits(queries, index, k, per_chunk=True) if k > 0 else None
        hits = hits if hits is not None else score_bm25(queries, index, salts)
    return rank_hits(_best_of_chunk(hits), k)


def upsert_bm25(index: LexicalIndex, changed: DataFrame, deleted: DataFrame | None = None) -> LexicalIndex:
    """Replace the postings of re-added documents and drop those of deleted ones."""
    ids = list(index.ids)
    fresh = build_bm25(changed, ids)
    gone = changed.select(*ids)
    if deleted is not None:
        gone = gone.unionByName(deleted.select(*ids))
    gone = gone.distinct()
    return LexicalIndex(
        index.postings.join(gone, ids, "left_anti").unionByName(fresh.postings),
        index.doc_stats.join(gone, ids, "left_anti").unionByName(fresh.doc_stats),
        index.ids,
    )
