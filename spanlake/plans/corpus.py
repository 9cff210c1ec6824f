"""Registered queries: lookups, paging, ordered windows and counts (A7, B, F, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import corpus as op
from spanlake.plans import fixtures as fx
from spanlake.plans.fixtures import oracle
from spanlake.sources.embeddings import records_to_chunks as to_chunks


def records_to_chunks(spark, sf):
    recs = fx.table(spark, sf, "documents").join(
        fx.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id"
    )
    recs = recs.select(
        F.col("source").alias("source_file"), F.col("doc_id").cast("int").alias("start_token"), "text", F.col("embedding").alias("vec")
    )
    return to_chunks(recs).select("chunk_id", "source_file", "start_offset", F.col("content"), F.size("vec").alias("dim"))


def _ids(spark, sf):
    return fx.table(spark, sf, "customer").select(fx.chunk_key(F.col("c_custkey")).alias("chunk_id"))


def live_chunks(spark, sf):
    return op.live_chunks(fx.chunks(spark, sf)).select("chunk_id", "source_file", "start_offset")


def chunks_by_ids(spark, sf):
    return op.chunks_by_ids(fx.chunks(spark, sf), _ids(spark, sf)).select("chunk_id", "content")


def chunks_of_source(spark, sf):
    return op.chunks_of_source(fx.chunks(spark, sf)).select("source_file", "pos", "chunk_id")


def page_with_total(spark, sf):
    return op.page_with_total(
        op.live_chunks(fx.chunks(spark, sf)).select("chunk_id", "source_file", "created_at"), ["created_at", "chunk_id"], 25, 50
    ).select("chunk_id", "source_file", "total")


def chunks_missing_vector(spark, sf):
    return op.chunks_missing_vector(fx.chunks(spark, sf)).select("chunk_id", "source_file")


def chunks_with_vector(spark, sf):
    return op.chunks_with_vector(fx.chunks(spark, sf)).select("chunk_id", F.size("vec").alias("dim"))


def vector_dim_profile(spark, sf):
    return op.vector_dim_profile(fx.chunks(spark, sf))


def resolve_chunks(spark, sf):
    return op.resolve_chunks(_ids(spark, sf), fx.chunks(spark, sf)).select(
        "chunk_id", "found", "deleted", F.md5("content").alias("content_md5")
    )


def _suppliers(spark, sf):
    return fx.table(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id"))


def edges_out(spark, sf):
    return op.edges_of_nodes(_suppliers(spark, sf), fx.edges(spark, sf), "out").select("edge_id", "type", "weight")


def edges_in(spark, sf):
    return op.edges_of_nodes(_suppliers(spark, sf), fx.edges(spark, sf), "in").select("edge_id", "type", "weight")


def segments_of_uploads(spark, sf):
    k = fx.table(spark, sf, "labels").filter("quality = 1").select(F.concat(F.lit("u"), "doc_id").alias("upload_id"))
    return op.segments_of_uploads(k, fx.segments(spark, sf)).select("upload_id", "ord", "text")


def pending_uploads(spark, sf):
    return op.pending_uploads(fx.uploads(spark, sf)).select("upload_id", "filename")


def source_summary(spark, sf):
    return op.source_summary(fx.live(spark, sf)).select("source_file", "n", F.unix_timestamp("first_seen").alias("first_seen"))


def upload_rollup(spark, sf):
    return op.upload_rollup(fx.uploads(spark, sf))


def newest_uploads(spark, sf):
    return op.newest_uploads(fx.uploads(spark, sf)).select("upload_id", "filename", "status")


def corpus_counts(spark, sf):
    return op.corpus_counts(fx.chunks(spark, sf).withColumnRenamed("speaker", "corpus"))


def window_around(spark, sf):
    return op.window_around(_ids(spark, sf), fx.chunks(spark, sf)).select(
        "focus_id", "source_file", "pos", "chunk_id", "is_focus", "has_prev", "has_next", "prev_chunk", "next_chunk"
    )


def window_text(spark, sf):
    w = op.window_around(_ids(spark, sf), fx.chunks(spark, sf))
    return op.window_text(w).select("focus_id", F.md5("text").alias("text_md5"))


def _points(spark, sf):
    """Offsets spread over and past each source: one per order."""
    d = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("o_custkey"), "source")
    return fx.table(spark, sf, "orders").join(d, "o_custkey").select(
        F.col("source").alias("source_file"), (F.col("o_orderkey") * 7001).alias("offset")
    )


def window_from(spark, sf):
    return op.window_from(_points(spark, sf), fx.chunks(spark, sf))


def reader_focus(spark, sf):
    w = op.window_around(_ids(spark, sf), fx.chunks(spark, sf))
    spans = fx.table(spark, sf, "documents").select(
        fx.chunk_key(F.col("doc_id")).alias("chunk_id"),
        (F.col("doc_id") % 300 - 20).cast("int").alias("start"),
        (F.col("doc_id") % 300 + 100).cast("int").alias("end"),
    )
    return op.reader_focus(w, spans)


def sequence_edges(spark, sf):
    return op.sequence_edges(fx.chunks(spark, sf))


QUERIES = {
    "records_to_chunks": records_to_chunks,
    "live_chunks": live_chunks,
    "chunks_by_ids": chunks_by_ids,
    "chunks_of_source": chunks_of_source,
    "page_with_total": page_with_total,
    "chunks_missing_vector": chunks_missing_vector,
    "chunks_with_vector": chunks_with_vector,
    "vector_dim_profile": vector_dim_profile,
    "resolve_chunks": resolve_chunks,
    "edges_of_nodes": edges_out,
    "edges_of_nodes_in": edges_in,
    "segments_of_uploads": segments_of_uploads,
    "pending_uploads": pending_uploads,
    "source_summary": source_summary,
    "upload_rollup": upload_rollup,
    "newest_uploads": newest_uploads,
    "corpus_counts": corpus_counts,
    "window_around": window_around,
    "window_text": window_text,
    "window_from": window_from,
    "reader_focus": reader_focus,
    "sequence_edges": sequence_edges,
}

_EX = {
    "ids": ((), "SELECT 'd' || lpad(c_custkey::VARCHAR, 8, '0') AS chunk_id FROM customer"),
    "pos": (
        ("live",),
        "SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY start_offset, created_at, chunk_id) - 1 AS pos, lead(chunk_id) OVER (PARTITION BY source_file ORDER BY start_offset, created_at, chunk_id) AS nxt FROM live",
    ),
    "win": (
        ("pos", "ids"),
        "SELECT f.chunk_id AS focus_id, f.source_file, f.pos AS mid, w.pos, w.chunk_id, w.content FROM pos f JOIN ids USING (chunk_id) JOIN pos w ON w.source_file = f.source_file AND w.pos BETWEEN f.pos - 3 AND f.pos + 3",
    ),
}


def _q(body, *names):
    return oracle(body, *names, extra=_EX)


_SUP = "(SELECT 's' || s_suppkey FROM supplier)"

ORACLES = {
    "records_to_chunks": """SELECT sha256(source || chr(0) || doc_id || chr(0) || text) AS chunk_id, source AS source_file, doc_id AS start_offset, text AS content, len(embedding) AS dim
      FROM documents JOIN embeddings ON vec_id = doc_id""",
    "live_chunks": _q("SELECT chunk_id, source_file, start_offset FROM live", "live"),
    "chunks_by_ids": _q("SELECT chunk_id, content FROM live WHERE chunk_id IN (SELECT chunk_id FROM ids)", "live", "ids"),
    "chunks_of_source": _q("SELECT source_file, pos, chunk_id FROM pos", "pos"),
    "page_with_total": _q(
        "SELECT chunk_id, source_file, total FROM (SELECT chunk_id, source_file, created_at, count(*) OVER () AS total FROM live) ORDER BY created_at, chunk_id LIMIT 25 OFFSET 50",
        "live",
    ),
    "chunks_missing_vector": _q("SELECT chunk_id, source_file FROM live WHERE vec IS NULL OR len(vec) = 0", "live"),
    "chunks_with_vector": _q("SELECT chunk_id, len(vec) AS dim FROM live WHERE len(vec) > 0", "live"),
    "vector_dim_profile": _q("SELECT len(vec) AS dim, count(*) AS n FROM chunks WHERE len(vec) > 0 GROUP BY 1", "chunks"),
    "resolve_chunks": _q(
        "SELECT chunk_id, c.content IS NOT NULL AS found, c.deleted_at IS NOT NULL AS deleted, md5(c.content) AS content_md5 FROM ids LEFT JOIN chunks c USING (chunk_id)",
        "ids",
        "chunks",
    ),
    "edges_of_nodes": _q(f"SELECT edge_id, type, weight FROM edges WHERE from_node IN {_SUP}", "edges"),
    "edges_of_nodes_in": _q(f"SELECT edge_id, type, weight FROM edges WHERE to_node IN {_SUP}", "edges"),
    "segments_of_uploads": _q(
        "SELECT upload_id, ord, text FROM segments WHERE upload_id IN (SELECT 'u' || doc_id FROM labels WHERE quality = 1)", "segments"
    ),
    "pending_uploads": _q("SELECT upload_id, filename FROM uploads WHERE status IN ('pending', 'transcribing')", "uploads"),
    "source_summary": _q("SELECT source_file, count(*) AS n, min(created_at) AS first_seen FROM live GROUP BY source_file", "live"),
    "upload_rollup": _q(
        """SELECT count(*) AS total, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed,
        count(*) FILTER (status IN ('pending', 'transcribing')) AS pending, count(*) FILTER (status IN ('pending', 'transcribing')) > 0 AS active FROM uploads""",
        "uploads",
    ),
    "newest_uploads": _q("SELECT upload_id, filename, status FROM uploads ORDER BY created_at DESC, upload_id LIMIT 500", "uploads"),
    "corpus_counts": _q("SELECT speaker AS corpus, count(*) AS n FROM chunks GROUP BY speaker", "chunks"),
    "window_around": _q(
        """SELECT w.focus_id, source_file, pos, chunk_id, chunk_id = w.focus_id AS is_focus, p.c IS NOT NULL AS has_prev, n.c IS NOT NULL AS has_next, p.c AS prev_chunk, n.c AS next_chunk
        FROM win w LEFT JOIN (SELECT focus_id, chunk_id AS c FROM win WHERE pos = mid - 3) p USING (focus_id) LEFT JOIN (SELECT focus_id, chunk_id AS c FROM win WHERE pos = mid + 3) n USING (focus_id)
        WHERE abs(pos - mid) <= 2""",
        "win",
    ),
    "window_text": _q(
        "SELECT focus_id, md5(string_agg(content, ' ' ORDER BY pos)) AS text_md5 FROM win WHERE abs(pos - mid) <= 2 GROUP BY focus_id", "win"
    ),
    "window_from": _q(
        """SELECT source_file, "offset", coalesce(arg_min(chunk_id, pos) FILTER (start_offset > "offset" OR (start_offset <= "offset" AND "offset" < end_offset)), arg_max(chunk_id, pos)) AS chunk_id
        FROM (SELECT DISTINCT d.source AS source_file, o_orderkey * 7001 AS "offset" FROM orders JOIN documents d ON d.doc_id = o_custkey) JOIN pos USING (source_file) GROUP BY ALL""",
        "pos",
    ),
    "reader_focus": _q(
        """SELECT chunk_id AS focus_id, substring(content, 1, s) AS pre, substring(content, s + 1, e - s) AS mid, substring(content, e + 1) AS post FROM (
        SELECT chunk_id, content, least(greatest(k % 300 - 20, 0), length(content)) AS s, least(greatest(k % 300 + 100, least(greatest(k % 300 - 20, 0), length(content))), length(content)) AS e
        FROM (SELECT chunk_id, content, substring(chunk_id, 2)::BIGINT AS k FROM live JOIN ids USING (chunk_id)))""",
        "live",
        "ids",
    ),
    "sequence_edges": _q("SELECT source_file, chunk_id AS a, nxt AS b FROM pos WHERE nxt IS NOT NULL", "pos"),
}
