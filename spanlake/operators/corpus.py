"""Chunk table lookups, paging, ordered windows and counts (B, F, G)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.ordered import shifted, with_ordinal
from spanlake.runtime import cut

ORDER = ["start_offset", "created_at", "chunk_id"]


def live_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.col("deleted_at").isNull())


def chunks_by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return live_chunks(chunks).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def chunks_of_source(chunks: DataFrame, source: str | None = None) -> DataFrame:
    """Live rows of one source (or of all) with their position by (start_offset, created_at)."""
    rows = live_chunks(chunks)
    if source is not None:
        rows = rows.filter(F.col("source_file") == source)
    return with_ordinal(rows, ["source_file"], ORDER, "pos", id=["chunk_id"])


def page_with_total(df: DataFrame, order: list[str | Column], limit: int, offset: int) -> DataFrame:
    """One page of ``df`` in order plus the total row count; limit <= 0 is unlimited."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset(max(offset, 0))
    if limit > 0:
        rows = rows.limit(limit)
    return rows.crossJoin(F.broadcast(total))  # total is one row


def _no_vec() -> Column:
    return F.col("vec").isNull() | (F.size("vec") <= 0)


def chunks_missing_vector(chunks: DataFrame, limit: int = 0) -> DataFrame:
    rows = live_chunks(chunks).filter(_no_vec())
    return rows.orderBy("created_at", "chunk_id").limit(limit) if limit > 0 else rows


def chunks_with_vector(chunks: DataFrame) -> DataFrame:
    return live_chunks(chunks).filter(~_no_vec())


def vector_dim_profile(chunks: DataFrame) -> DataFrame:
    return (
        chunks.filter(~_no_vec()).groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    )


def resolve_chunks(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, found, deleted, content) whatever the state of the row."""
    rows = chunks.select("chunk_id", "content", F.col("deleted_at").isNotNull().alias("deleted"), F.lit(True).alias("found"))
    return ids.join(rows, "chunk_id", "left").select(
        "chunk_id",
        F.coalesce("found", F.lit(False)).alias("found"),
        F.coalesce("deleted", F.lit(False)).alias("deleted"),
        "content",
    )


def edges_of_nodes(keys: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """Outgoing or incoming edges of the given nodes; order by (weight, created_at, edge_id) for display."""
    side = "from_node" if direction == "out" else "to_node"
    return edges.join(keys.select(F.col("node_id").alias(side)).distinct(), side, "left_semi")


def segments_of_uploads(keys: DataFrame, segments: DataFrame) -> DataFrame:
    return segments.join(keys.select("upload_id").distinct(), "upload_id", "left_semi")


def pending_uploads(uploads: DataFrame) -> DataFrame:
    return uploads.filter(F.col("status").isin("pending", "transcribing"))


# ---- counts --------------------------------------------------------------------------------------


def source_summary(chunks: DataFrame) -> DataFrame:
    """(source_file, n, first_seen); order by first_seen for first-seen order."""
    return chunks.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_seen"))


def upload_rollup(uploads: DataFrame) -> DataFrame:
    def of(*states: str) -> Column:
        return F.coalesce(F.sum(F.col("status").isin(*states).cast("long")), F.lit(0))

    return uploads.agg(
        F.count(F.lit(1)).alias("total"),
        of("done").alias("done"),
        of("failed").alias("failed"),
        of("pending", "transcribing").alias("pending"),
    ).withColumn("active", F.col("pending") > 0)


def newest_uploads(uploads: DataFrame, limit: int = 500) -> DataFrame:
    return uploads.orderBy(F.col("created_at").desc(), F.col("upload_id").asc()).limit(limit)


def corpus_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"))


# ---- ordered windows -----------------------------------------------------------------------------


def window_around(focus: DataFrame, chunks: DataFrame, radius: int = 2) -> DataFrame:
    """(focus_id, pos, chunk_id, text, is_focus, has_prev, has_next, prev_chunk, next_chunk).

    Only sources that hold a focus are ordered, by narrow rows; every focus then asks for 2r+1 ordinals by equi-join
    on (source, ordinal), a unique key, so a source of any size stays spread out. Texts are joined to the windows.
    """
    radius = radius if radius > 0 else 2
    live = live_chunks(chunks)
    sources = live.join(focus.select("chunk_id").distinct(), "chunk_id", "left_semi").select("source_file").distinct()
    narrow = live.select("source_file", *ORDER).join(sources, "source_file", "left_semi")
    pos = with_ordinal(narrow, ["source_file"], ORDER, "pos").select("source_file", "pos", "chunk_id")
    centre = focus.select(F.col("chunk_id").alias("focus_id")).distinct().join(
        pos.select(F.col("chunk_id").alias("focus_id"), "source_file", F.col("pos").alias("at")), "focus_id"
    )
    wanted = centre.withColumn("pos", F.explode(F.sequence(F.col("at") - radius - 1, F.col("at") + radius + 1)))
    got = cut(wanted.join(pos, ["source_file", "pos"]))
    edge = got.groupBy("focus_id").agg(
        F.max(F.when(F.col("pos") == F.col("at") - radius - 1, F.col("chunk_id"))).alias("prev_chunk"),
        F.max(F.when(F.col("pos") == F.col("at") + radius + 1, F.col("chunk_id"))).alias("next_chunk"),
    )
    inside = got.filter(F.abs(F.col("pos") - F.col("at")) <= radius)
    return inside.join(edge, "focus_id").join(live.select("chunk_id", "content"), "chunk_id").select(
        "focus_id",
        "source_file",
        "pos",
        "chunk_id",
        F.col("content").alias("text"),
        (F.col("chunk_id") == F.col("focus_id")).alias("is_focus"),
        F.col("prev_chunk").isNotNull().alias("has_prev"),
        F.col("next_chunk").isNotNull().alias("has_next"),
        "prev_chunk",
        "next_chunk",
    )


def window_text(window: DataFrame) -> DataFrame:
    """(focus_id, text): the window's chunks joined in order (at most 2r+1 pieces)."""
    piece = F.struct("pos", "text")
    return window.groupBy("focus_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), " ").alias("text")
    )


def window_from(points: DataFrame, chunks: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """(source_file, offset, chunk_id): the chunk holding the offset, else the next one, else the last.

    A containing chunk is found by an equi-join on offset buckets. The rest need "first start after
    the offset": starts are bucketed too, and a point looks in its own bucket first, then at the
    first start of the next non-empty bucket, taken from a table with one row per bucket.
    """
    pts = points.select("source_file", "offset").distinct()
    rows = live_chunks(chunks).select("source_file", "chunk_id", "start_offset", "end_offset", "created_at")
    order = F.struct("start_offset", "created_at", "chunk_id")

    def of(c):
        return F.floor(F.col(c) / bucket)

    covers = rows.withColumn("b", F.explode(F.sequence(of("start_offset"), F.floor(F.greatest(F.col("end_offset") - 1, F.col("start_offset")) / bucket))))
    inside = (
        pts.withColumn("b", of("offset"))
        .join(covers, ["source_file", "b"])
        .filter((F.col("start_offset") <= F.col("offset")) & (F.col("offset") < F.col("end_offset")))
        .groupBy("source_file", "offset")
        .agg(F.min(order).alias("hit"))
    )
    starts = rows.withColumn("b", of("start_offset"))
    per_bucket = starts.groupBy("source_file", "b").agg(F.min(order).alias("first"))
    ranked = with_ordinal(per_bucket, ["source_file"], ["b"], "k")
    # the next non-empty bucket of a point: bucket list and points merged in order, then the bucket
    # ordinal at or after the point is its count of buckets before it
    probe = pts.select("source_file", of("offset").alias("b")).distinct()
    merged = ranked.select("source_file", "b", F.lit(1).alias("one")).unionByName(
        probe.select("source_file", "b", F.lit(0).alias("one"))
    )
    from spanlake.ordered import with_running

    counted = with_running(
        merged.groupBy("source_file", "b").agg(F.max("one").alias("one")), ["source_file"], ["b"], sums={"k": F.col("one")}
    ).select("source_file", "b", (F.col("k") + F.col("one")).alias("k"))  # ordinal of the first bucket after b
    later = (
        pts.withColumn("b", of("offset"))
        .join(counted, ["source_file", "b"])
        .join(ranked.select("source_file", "k", F.col("first").alias("after_first")), ["source_file", "k"], "left")
    )
    own = (
        pts.withColumn("b", of("offset"))
        .join(starts, ["source_file", "b"])
        .filter(F.col("start_offset") > F.col("offset"))
        .groupBy("source_file", "offset")
        .agg(F.min(order).alias("own"))
    )
    last = rows.groupBy("source_file").agg(F.max(order).alias("last"))
    return (
        later.select("source_file", "offset", "after_first")
        .join(own, ["source_file", "offset"], "left")
        .join(inside, ["source_file", "offset"], "left")
        .join(last, "source_file")
        .withColumn("next", F.coalesce("own", "after_first"))
        # chunks are met in start order, so a containing chunk counts only if it starts first
        .select("source_file", "offset", F.coalesce(F.least("hit", "next"), "last")["chunk_id"].alias("chunk_id"))
    )


def reader_focus(windows: DataFrame, spans: DataFrame) -> DataFrame:
    """(focus_id, pre, mid, post): the focus chunk cut around a located span, clamped to the text."""
    rows = windows.filter("is_focus").join(spans.select(F.col("chunk_id").alias("focus_id"), "start", "end"), "focus_id")
    n = F.char_length("text")
    s = F.least(F.greatest(F.col("start"), F.lit(0)), n)
    e = F.least(F.greatest(F.col("end"), s), n)
    return rows.select(
        "focus_id",
        F.substring("text", F.lit(1), s).alias("pre"),
        F.substring("text", s + 1, e - s).alias("mid"),
        F.substring("text", e + 1, n - e).alias("post"),
    )


def sequence_edges(chunks: DataFrame) -> DataFrame:
    """(source_file, a, b) for consecutive chunks of a source."""
    pos = with_ordinal(live_chunks(chunks).select("source_file", *ORDER), ["source_file"], ORDER, "pos")
    pos = pos.select("source_file", "pos", F.col("chunk_id").alias("a"))
    return shifted(pos, ["source_file"], "pos", 1, "a", "b").filter(F.col("b").isNotNull()).select("source_file", "a", "b")
