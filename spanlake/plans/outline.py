"""Registered queries: trees, walks, threads, reports and changes (A10-A12, F3-F4, G3, H, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.operators import changes as ch
from spanlake.operators import outline as ol
from spanlake.plans import fixtures as fx
from spanlake.plans.fixtures import oracle
from spanlake.plans.scalars import _chunk_sql, _flat, _trim, _words


def _tree(spark, sf):
    return ol.build_tree(fx.nodes(spark, sf), fx.edges(spark, sf))


def build_tree(spark, sf):
    return _tree(spark, sf).select("node_id", "parent_id", "depth")


def flatten_preorder(spark, sf):
    return ol.flatten_preorder(_tree(spark, sf)).select("node_id", "depth", "pos")


def _nations(spark, sf):
    return fx.table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"))


def subtree(spark, sf):
    return ol.subtree(_tree(spark, sf), _nations(spark, sf))


def neighbours(spark, sf):
    return ol.neighbours(ol.flatten_preorder(_tree(spark, sf)))


def outline_stats(spark, sf):
    return ol.outline_stats(fx.nodes(spark, sf), fx.edges(spark, sf))


def find_roots(spark, sf):
    return ol.find_roots(fx.nodes(spark, sf), fx.edges(spark, sf)).select("node_id", "type")


def would_create_cycle(spark, sf):
    """Each customer against the suppliers of its orders."""
    cand = (
        fx.table(spark, sf, "orders")
        .join(fx.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
        .select(F.concat(F.lit("c"), "o_custkey").alias("from_node"), F.concat(F.lit("s"), "l_suppkey").alias("to_node"))
        .distinct()
    )
    return ol.would_create_cycle(cand, fx.edges(spark, sf), direction="down")


def topological_sort(spark, sf):
    return ol.topological_sort(fx.nodes(spark, sf), fx.edges(spark, sf))


def _broken(spark, sf):
    """The outline with self-links, edges to nowhere and thread rows of unknown nodes."""
    e = fx.edges(spark, sf).select("edge_id", "from_node", "to_node", "created_at")
    t = F.timestamp_seconds(F.lit(1700000000))
    s = fx.table(spark, sf, "supplier").filter("s_acctbal < 0").select(
        F.concat(F.lit("loop"), "s_suppkey").alias("edge_id"), F.concat(F.lit("s"), "s_suppkey").alias("from_node"),
        F.concat(F.lit("s"), "s_suppkey").alias("to_node"), t.alias("created_at"),
    )
    c = fx.table(spark, sf, "customer").filter("c_acctbal < 0").select(
        F.concat(F.lit("lost"), "c_custkey").alias("edge_id"), F.concat(F.lit("c"), "c_custkey").alias("from_node"),
        F.concat(F.lit("x"), "c_custkey").alias("to_node"), t.alias("created_at"),
    )
    tn = fx.thread_nodes(spark, sf).unionByName(
        fx.table(spark, sf, "nation").select(
            F.concat(F.lit("t"), "n_nationkey").alias("thread_id"), F.concat(F.lit("z"), "n_nationkey").alias("node_id"), F.lit(-1).alias("position")
        )
    )
    return e.union(s).union(c), tn


def validate_graph(spark, sf):
    edges, tn = _broken(spark, sf)
    return ol.validate_graph(fx.nodes(spark, sf), edges, tn)


def _contexts(spark, sf):
    k = F.col("n_nationkey")
    return fx.table(spark, sf, "nation").select(
        k.alias("context_id"),
        F.when(k % 3 == 0, "Expert").when(k % 3 == 1, "novice").otherwise("").alias("audience"),
        F.create_map(F.lit("level"), (k % 2 + 1).cast("string")).alias("labels"),
        F.array(F.concat(F.lit("r"), k % 5)).alias("read_nodes"),
        F.array(F.concat(F.lit("p"), k), F.concat(F.lit("p"), k + 100)).alias("starts"),
    )


def reachable_static(spark, sf):
    return ol.reachable_static(_contexts(spark, sf), fx.edges(spark, sf))


def conditional_walk(spark, sf):
    """Orders open only to readers that have read the nation they started under."""
    e = fx.edges(spark, sf).withColumn(
        "condition",
        F.when((F.col("type") == "linear") & F.col("to_node").startswith("o"), F.concat(F.lit("!has_read("), F.col("to_node"), F.lit(")")))
        .when(F.col("type") == "jump", F.concat(F.lit("has_read("), F.col("from_node"), F.lit(")")))
        .otherwise(F.col("condition")),
    )
    return ol.conditional_walk(_contexts(spark, sf), e)


def linearize_thread(spark, sf):
    return ol.linearize_thread(fx.threads(spark, sf), fx.thread_nodes(spark, sf), fx.nodes(spark, sf)).select(
        "thread_id", "pos", "node_id", "title", "missing"
    )


def _ordered(spark, sf):
    return ol.linearize_thread(fx.threads(spark, sf), fx.thread_nodes(spark, sf), fx.nodes(spark, sf)).withColumnRenamed(
        "thread_id", "doc_id"
    )


def _half_evidence(spark, sf):
    """Citations of urgent and high orders only, so many customers fall back to their body."""
    return fx.evidence(spark, sf).filter("edited or position = 3")


def collect_spans(spark, sf):
    return ol.collect_spans(_ordered(spark, sf), _half_evidence(spark, sf))


def stitch_spans(spark, sf):
    return ol.stitch_spans(collect_spans(spark, sf)).select("doc_id", "ord", "type", "chunk_id", "text", "char_start")


def stitch_stats(spark, sf):
    return ol.stitch_stats(ol.stitch_spans(collect_spans(spark, sf))).withColumn("glue_ratio", F.round("glue_ratio", 6))


def exits(spark, sf):
    return ol.exits(fx.nodes(spark, sf), fx.edges(spark, sf)).select("from_node", "to_node", "title", "type", "condition")


def diff_states(spark, sf):
    base, edges = fx.nodes(spark, sf), fx.edges(spark, sf)
    gone_n = fx.table(spark, sf, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"))
    gone_c = fx.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"))
    rich = fx.table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.lit(True).alias("rich"))
    new = fx.table(spark, sf, "supplier").select(
        F.concat(F.lit("new"), "s_suppkey").alias("node_id"), F.lit("outline").alias("type"), F.col("s_name").alias("title"), F.lit("").alias("body"),
        F.lit(False).alias("locked"), F.timestamp_seconds(F.lit(1700000000)).alias("created_at"),
    )
    cur = (
        base.join(gone_n.unionByName(gone_c), "node_id", "left_anti")
        .join(rich, "node_id", "left")
        .withColumn("title", F.when(F.col("rich"), F.upper("title")).otherwise(F.col("title")))
        .drop("rich")
        .unionByName(new)
    )
    return ol.diff_states(cur, base, edges)


def _report_nodes(spark, sf):
    return fx.nodes(spark, sf).withColumn(
        "source_file", F.when((F.col("type") == "chunk_ref") & (F.col("title") == "1-URGENT"), F.concat(F.lit("src"), F.substring("node_id", 2, 1)))
    )


def outline_report(spark, sf):
    branches = fx.table(spark, sf, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") == 2).alias("active"))
    return ol.outline_report(
        "world", _report_nodes(spark, sf), fx.edges(spark, sf), fx.threads(spark, sf), fx.thread_nodes(spark, sf), branches, "now"
    )


def manuscript_report(spark, sf):
    titles = fx.threads(spark, sf).select(F.col("thread_id").alias("doc_id"), F.col("name").alias("title"))
    ways = fx.edges(spark, sf).withColumn("type", F.when(F.col("type") == "linear", "jump").otherwise("branch"))
    ways = ways.withColumn("condition", F.when(F.col("weight") == 1, "audience==x"))
    return ol.manuscript_report(titles, _ordered(spark, sf), ol.stitch_spans(collect_spans(spark, sf)), ways)


def stitched_manuscript(spark, sf):
    """Another stitcher: pieces without glue between them, each in brackets."""

    def bracketed(spans, level):
        return spans.select(
            "doc_id", (F.col("idx") * 2).alias("ord"), F.lit("chunk").alias("type"), "idx", "chunk_id", F.concat(F.lit("["), "text", F.lit("]")).alias("text"), F.lit(level).cast("long").alias("char_start")
        )

    ev = fx.evidence(spark, sf)
    titles = fx.threads(spark, sf).select(F.col("thread_id").alias("doc_id"), F.col("name").alias("title"))
    out = ol.stitched_manuscript(titles, _ordered(spark, sf), ev, fx.edges(spark, sf), bracketed)
    return out.groupBy("doc_id").agg(F.count_if(F.col("text").startswith("[") & F.col("text").endswith("]")).alias("pieces"))


# ---- state and changes ---------------------------------------------------------------------------


def _state(spark, sf):
    return {
        "nodes": fx.nodes(spark, sf).drop("created_at"),
        "edges": fx.edges(spark, sf).select("edge_id", "from_node", "to_node", "type", "condition", "weight"),
        "threads": fx.threads(spark, sf),
        "thread_nodes": fx.thread_nodes(spark, sf),
        "evidence": fx.evidence(spark, sf).drop("created_at"),
    }


def export_state(spark, sf):
    lines = ch.export_state(_state(spark, sf))
    return lines.filter("kind in ('threads', 'thread_nodes', 'edges')")


def import_state(spark, sf):
    """Exported evidence read back, next to old-style references taken from the labels."""
    state = _state(spark, sf)
    lines = ch.export_state(state)
    old = fx.table(spark, sf, "labels").select(
        F.lit("node_chunks").alias("kind"),
        F.to_json(F.struct(F.concat(F.lit("c"), "doc_id").alias("node_id"), fx.chunk_key(F.col("doc_id")).alias("chunk_id"))).alias("json"),
    )
    back = ch.import_state(lines.unionByName(old), {k: df.schema for k, df in state.items()})
    return back["evidence"].select("evidence_id", "node_id", "chunk_id", "text", "char_start", "edited")


def snapshot(spark, sf):
    lines = ch.export_state(_state(spark, sf))
    at = F.timestamp_seconds(F.lit(1700000000))
    versions = ch.snapshot(lines, "v1", "first", at).unionByName(
        ch.snapshot(lines.filter("kind <> 'evidence'"), "v2", "second", F.timestamp_seconds(F.lit(1700000100)))
    )
    back = ch.restore(versions, "v2", {"nodes": _state(spark, sf)["nodes"].schema})["nodes"]
    per = back.groupBy("type").agg(F.count(F.lit(1)).alias("rows")).select(F.col("type").alias("version_id"), F.lit("restored").alias("label"), "rows")
    return ch.snapshot_summaries(versions).select("version_id", "label", "rows").unionByName(per)


def export_state_all(spark, sf):
    """All five tables as JSON lines."""
    return ch.export_state(_state(spark, sf))


def _old_references(spark, sf):
    return fx.table(spark, sf, "labels").select(
        F.lit("node_chunks").alias("kind"),
        F.to_json(F.struct(F.concat(F.lit("c"), "doc_id").alias("node_id"), fx.chunk_key(F.col("doc_id")).alias("chunk_id"))).alias("json"),
    )


def import_state_all(spark, sf):
    """All five tables exported, imported next to old-style references, and exported again."""
    state = _state(spark, sf)
    lines = ch.export_state(state).unionByName(_old_references(spark, sf))
    return ch.export_state(ch.import_state(lines, {k: df.schema for k, df in state.items()}))


def restore_all(spark, sf):
    """All tables of two versions as they are restored: the first whole, the second without its evidence."""
    state = _state(spark, sf)
    lines = ch.export_state(state)
    versions = ch.snapshot(lines, "v1", "first", F.timestamp_seconds(F.lit(1700000000))).unionByName(
        ch.snapshot(lines.filter("kind <> 'evidence'"), "v2", "second", F.timestamp_seconds(F.lit(1700000100)))
    )
    schemas = {k: df.schema for k, df in state.items()}
    back = [ch.export_state(ch.restore(versions, v, schemas)).withColumn("version_id", F.lit(v)) for v in ("v1", "v2")]
    return back[0].unionByName(back[1])


def _old_chunks(spark, sf):
    return fx.chunks(spark, sf).select("chunk_id", "source_file", "content", "created_at", "deleted_at")


def _incoming(spark, sf):
    """Sources of documents judged good come in again under new ids."""
    src = fx.table(spark, sf, "labels").filter("quality = 0").join(fx.table(spark, sf, "documents"), "doc_id")
    at = F.timestamp_seconds(F.lit(1800000000))
    return src.select(
        F.concat(F.lit("n"), "doc_id").alias("chunk_id"), F.col("source").alias("source_file"), F.col("text").alias("content"),
        at.alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at"),
    )


def supersede_source(spark, sf):
    out, _ = ch.supersede_source(_old_chunks(spark, sf), _incoming(spark, sf), F.timestamp_seconds(F.lit(1800000000)))
    return out.select("chunk_id", "source_file", F.unix_timestamp("deleted_at").alias("deleted_at"))


def supersede_counts(spark, sf):
    return ch.supersede_source(_old_chunks(spark, sf), _incoming(spark, sf))[1]


def rechunk(spark, sf):
    seg = fx.segments(spark, sf)
    up = seg.select("upload_id").distinct().withColumn("filename", F.concat(F.col("upload_id"), F.lit(".txt")))
    old = _old_chunks(spark, sf).withColumn("source_file", F.concat(F.lit("u"), F.substring("chunk_id", 2, 99).cast("int").cast("string"), F.lit(".txt")))
    out, _ = ch.rechunk(up, seg, old, F.timestamp_seconds(F.lit(1800000000)))
    return out.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("deleted_at").isNull()).alias("live"))


def versioned_upsert(spark, sf):
    """Events as node edits: chains of versions per user, some against an old version, some on unknown nodes."""
    nodes = fx.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("node_id"), F.col("c_name").alias("title"), F.lit("").alias("body"), F.lit(False).alias("locked"),
        F.size(F.array(F.lit(0))).alias("version"),
    )
    e = fx.table(spark, sf, "events")
    edits = e.select(
        F.col("user_id").alias("node_id"),
        (F.col("event_id") % 4 + 1).cast("int").alias("version"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") != "error", F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"))).alias("title"),
        F.col("event_type").alias("body"),
        F.lit(None).cast("boolean").alias("locked"),
    )
    out, bad = ch.versioned_upsert(nodes, edits)
    return out.select("node_id", "title", "body", "version", F.lit("kept").alias("what")).unionByName(
        bad.groupBy("node_id", "reason").agg(F.count(F.lit(1)).cast("int").alias("version")).select(
            "node_id", F.lit("").alias("title"), F.lit("").alias("body"), "version", F.col("reason").alias("what")
        )
    )


def cascade_delete(spark, sf):
    ids = fx.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("c"), "c_custkey").alias("node_id")).unionByName(
        fx.table(spark, sf, "nation").select(F.concat(F.lit("zz"), "n_nationkey").alias("node_id"))
    )
    out, missing = ch.cascade_delete(_state(spark, sf), ids)
    parts = [df.select(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, df, c in (
        ("nodes", out["nodes"], "node_id"), ("edges", out["edges"], "edge_id"), ("thread_nodes", out["thread_nodes"], "node_id"),
        ("evidence", out["evidence"], "evidence_id"), ("missing", missing, "node_id"))]
    r = parts[0]
    for p in parts[1:]:
        r = r.unionByName(p)
    return r


def apply_changes(spark, sf):
    """Events as changes to suppliers: purchases insert, errors delete, the rest rename or move."""
    sup = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    e = fx.table(spark, sf, "events").select(
        F.when(F.col("event_type") == "purchase", "insert").when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"),
        F.col("event_id").alias("seq"), (F.col("user_id") * 2).alias("k"),
        F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("ev"), F.col("event_id").cast("string"))).alias("name"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 25).cast("int").alias("nation"),
    )
    out, lost = ch.apply_changes(sup, e, "k")
    report = lost.groupBy("k", "op").agg(F.count(F.lit(1)).cast("int").alias("nation"))
    return out.unionByName(report.select("k", F.concat(F.lit("not found: "), "op").alias("name"), "nation"))


def replace_thread_nodes(spark, sf):
    """Threads of region 0 take their nation's suppliers instead."""
    lists = (
        fx.table(spark, sf, "nation").filter("n_regionkey = 0")
        .join(fx.table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.concat(F.lit("t"), "n_nationkey").alias("thread_id"))
        .agg(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda s: F.concat(F.lit("s"), s.cast("string"))).alias("nodes"))
    )
    return ch.replace_thread_nodes(fx.thread_nodes(spark, sf), lists)


def align_quotes(spark, sf):
    ev = fx.evidence(spark, sf)
    q = ev.select(
        F.col("evidence_id").alias("quote_id"), "node_id", "chunk_id", F.lit(0).alias("char_start"), F.col("position").alias("char_end"),
        F.when(F.col("position") == 1, F.regexp_replace("text", " ", "  ")).when(F.col("position") == 2, "").otherwise(F.col("text")).alias("text"),
    )
    return ch.align_quotes(q, fx.chunks(spark, sf)).select("quote_id", "char_start", "char_end", F.md5("text").alias("text_md5"), "title")


def audit_evidence(spark, sf):
    return ch.audit_evidence(fx.evidence(spark, sf), fx.chunks(spark, sf)).select("evidence_id", "verdict")


def detach_unresolved(spark, sf):
    state = {**_state(spark, sf)}
    out = ch.detach_unresolved(state, ch.audit_evidence(state["evidence"], fx.chunks(spark, sf)))
    return out["nodes"].select(F.lit("nodes").alias("kind"), F.col("node_id").alias("id")).unionByName(
        out["evidence"].select(F.lit("evidence").alias("kind"), F.col("evidence_id").alias("id"))
    )


def constraint_checks(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    edges = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("edge_id"), F.col("l_partkey").alias("from_node"), F.col("l_suppkey").alias("to_node"),
        F.when(F.col("l_returnflag") == "R", "odd").otherwise("linear").alias("type"),
    )
    tn = fx.table(spark, sf, "customer").select(F.col("c_nationkey").alias("thread_id"), F.col("c_mktsegment").alias("position"))
    m = fx.table(spark, sf, "embeddings").select((F.col("label") % 2).alias("build_id"), F.col("label").alias("chunk_id"))
    br = fx.table(spark, sf, "region").select((F.col("r_regionkey") > 2).alias("active"))
    ln = fx.table(spark, sf, "nation").select(F.col("n_nationkey").alias("region_a"), F.col("n_regionkey").alias("region_b"))
    return ch.constraint_checks({"edges": edges, "thread_nodes": tn, "region_members": m, "branches": br, "region_links": ln})


def _meta(spark, sf):
    return fx.table(spark, sf, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))


def invalidate_vectors(spark, sf):
    meta = _meta(spark, sf).unionByName(
        fx.table(spark, sf, "region").filter("r_regionkey = 0").select(F.lit("embed_model").alias("key"), F.lit("old").alias("value"))
    )
    out, new_meta, cleared = ch.invalidate_vectors(fx.chunks(spark, sf), meta, "new")
    left = out.agg(F.count_if(F.col("vec").isNotNull()).alias("left"), F.count(F.lit(1)).alias("rows"))
    return cleared.crossJoin(left).crossJoin(new_meta.filter("key = 'embed_model'").select("value"))


def meta_upsert(spark, sf):
    rows = fx.table(spark, sf, "region").select(
        F.concat(F.lit("NATION_"), F.col("r_regionkey").cast("string")).alias("key"), F.col("r_name").alias("value")
    ).unionByName(fx.table(spark, sf, "region").select(F.col("r_name").alias("key"), F.lit("x").alias("value")))
    return ch.meta_upsert(_meta(spark, sf), rows)


def index_gap(spark, sf):
    """The keyword index holds the labelled documents, the vector index the first labels' regions."""
    kw = fx.table(spark, sf, "labels").select(fx.chunk_key(F.col("doc_id")).alias("chunk_id"))
    vec = fx.vectors(spark, sf).filter("label < 5").select("chunk_id")
    return ch.index_gap(fx.chunks(spark, sf), kw, vec)


QUERIES = {
    f.__name__: f
    for f in (
        build_tree, flatten_preorder, subtree, neighbours, outline_stats, find_roots, would_create_cycle, topological_sort,
        validate_graph, reachable_static, conditional_walk, linearize_thread, collect_spans, stitch_spans, stitch_stats, exits,
        diff_states, outline_report, manuscript_report, stitched_manuscript, export_state, import_state, snapshot, export_state_all, import_state_all, restore_all, supersede_source, supersede_counts,
        rechunk, versioned_upsert, cascade_delete, apply_changes, replace_thread_nodes, align_quotes, audit_evidence,
        detach_unresolved, constraint_checks, invalidate_vectors, meta_upsert, index_gap,
    )
}

#: every table as JSON lines, with keys in order
_STATE = {
    "nodes": ("nodes", "{'body': body, 'locked': locked, 'node_id': node_id, 'title': title, 'type': type}"),
    "edges": ("edges", "{'condition': condition, 'edge_id': edge_id, 'from_node': from_node, 'to_node': to_node, 'type': type, 'weight': weight}"),
    "threads": ("threads", "{'name': name, 'thread_id': thread_id}"),
    "thread_nodes": ("thread_nodes", "{'node_id': node_id, 'position': position, 'thread_id': thread_id}"),
    "evidence": (
        "evidence",
        "{'char_end': char_end, 'char_start': char_start, 'chunk_id': chunk_id, 'edited': edited, 'evidence_id': evidence_id, 'node_id': node_id, 'position': position, 'source_file': source_file, 'text': text}",
    ),
}
_STATE_SQL = " UNION ALL ".join(f"SELECT '{kind}' AS kind, to_json({value})::VARCHAR AS json FROM {name}" for kind, (name, value) in _STATE.items())
_STEP = "lpad({w}::VARCHAR, 5, '0') || lpad({t}::VARCHAR, 12, '0') || {i}"
_EX = {
    "links": (
        ("nodes", "edges"),
        "SELECT from_node, to_node, " + _STEP.format(w="weight", t="n.created_at", i="to_node") + " AS step FROM edges e JOIN nodes n ON n.node_id = to_node WHERE e.type = 'linear'",
    ),
    "tree": (
        ("nodes", "links"),
        "SELECT node_id, '' AS parent_id, 0 AS depth, [" + _STEP.format(w="0", t="created_at", i="node_id") + """] AS path, [node_id] AS ids FROM nodes WHERE type = 'outline' AND node_id NOT IN (SELECT to_node FROM links)
        UNION ALL SELECT to_node, from_node, depth + 1, list_append(path, step), list_append(ids, to_node) FROM tree JOIN links ON from_node = node_id""",
    ),
    "pre": (("tree",), "SELECT *, row_number() OVER (ORDER BY path) - 1 AS pos FROM tree"),
    "ordn": (
        ("nodes", "thread_nodes"),
        "SELECT thread_id AS doc_id, row_number() OVER (PARTITION BY thread_id ORDER BY position, node_id) - 1 AS pos, node_id, title, body FROM thread_nodes JOIN nodes USING (node_id)",
    ),
    "halfev": (("evidence",), "SELECT * FROM evidence WHERE edited OR position = 3"),
    "spans": (
        ("ordn", "halfev"),
        """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos, position, created_at, evidence_id) - 1 AS idx, chunk_id, text FROM (
        SELECT * FROM (SELECT doc_id, pos, position, e.created_at, evidence_id, chunk_id, text, row_number() OVER (PARTITION BY doc_id, chunk_id, char_start, char_end ORDER BY pos, position, e.created_at, evidence_id) AS r FROM ordn JOIN halfev e USING (node_id)) WHERE r = 1
        UNION ALL SELECT doc_id, pos, 0, -1, '', node_id, body, 1 FROM ordn WHERE body <> '' AND node_id NOT IN (SELECT node_id FROM halfev))""",
    ),
    "pieces2": (
        ("spans",),
        """SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM (
        SELECT doc_id, idx * 2 AS ord, 'chunk' AS type, chunk_id, text FROM spans UNION ALL SELECT doc_id, idx * 2 - 1, 'glue', NULL, ' ... ' FROM spans WHERE idx > 0)""",
    ),
}


def _o(body, *names, **extra):
    return oracle(body, *names, extra={**_EX, **extra})


_EXITLAB = "e.type || ': ' || CASE WHEN trim(n.title) = '' THEN '_(untitled)_' ELSE n.title END || CASE WHEN coalesce(condition, '') <> '' THEN '  (if ' || condition || ')' ELSE '' END"

_REPORT = f"""
rn AS (SELECT *, CASE WHEN type = 'chunk_ref' AND title = '1-URGENT' THEN 'src' || node_id[2] ELSE '' END AS src FROM nodes),
rows_ AS (SELECT p.pos, p.depth, rn.* FROM pre p JOIN rn USING (node_id)),
lines_ AS (
SELECT 0 AS section, '' AS name, 0 AS pos, 0 AS part, 0 AS i, '' AS x, '# world' AS line
UNION ALL SELECT 0, '', 1, 0, 0, '', ''
UNION ALL SELECT 0, '', 2, 0, 0, '', '_updated now · ' || (SELECT count(*) FROM nodes WHERE type = 'outline') || ' bullet(s), ' || (SELECT count(DISTINCT from_node) FROM edges JOIN nodes n ON n.node_id = to_node AND n.type = 'chunk_ref' WHERE edges.type = 'linear') || ' with evidence_'
UNION ALL SELECT 0, '', 3, 0, 0, '', ''
UNION ALL SELECT 1, '', pos, 0, 0, '', repeat('  ', depth) || '- ' || CASE WHEN trim(title) = '' THEN '_(untitled)_' ELSE trim(title) END || CASE WHEN locked THEN '  `[locked]`' ELSE '' END FROM rows_ WHERE type = 'outline'
UNION ALL SELECT 1, '', pos, 0, 0, '', repeat('  ', depth) || '> ' || {_flat('body')} || CASE WHEN src <> '' THEN ' — _' || src || '_' ELSE '' END FROM rows_ WHERE type = 'chunk_ref'
UNION ALL SELECT 1, '', pos, 1, generate_subscripts(b, 1), '', repeat('  ', depth) || '  ' || unnest(b) FROM (SELECT pos, depth, string_split(body, chr(10)) AS b FROM rows_ WHERE type = 'outline' AND trim(body) <> '')
UNION ALL SELECT 1, '', r.pos, 2, e.created_at, e.edge_id, repeat('  ', depth) || '  → ' || {_EXITLAB} FROM rows_ r JOIN edges e ON e.from_node = r.node_id AND e.type <> 'linear' JOIN nodes n ON n.node_id = e.to_node WHERE r.type = 'outline'
UNION ALL SELECT 2, '', 0, 0, 0, '', '' UNION ALL SELECT 2, '', 1, 0, 0, '', '## Threads'
UNION ALL SELECT 3, name || chr(0) || thread_id, 0, 0, 0, '', '' FROM threads
UNION ALL SELECT 3, name || chr(0) || thread_id, 1, 0, 0, '', '### ' || name || '  (' || (SELECT count(*) FROM thread_nodes t2 WHERE t2.thread_id = threads.thread_id) || ' of ' || (SELECT count(*) FROM pre) || ' bullets)' FROM threads
UNION ALL SELECT 3, name || chr(0) || thread_id, 2, 0, pos + 1, '', (pos + 1) || '. ' || title FROM ordn JOIN threads ON thread_id = doc_id
UNION ALL SELECT 4, '', 0, 0, 0, '', '' UNION ALL SELECT 4, '', 1, 0, 0, '', '## Branches' UNION ALL SELECT 4, '', 2, 0, 0, '', ''
UNION ALL SELECT 5, r_name, 0, 0, 0, '', '- **' || r_name || '**' || CASE WHEN r_regionkey = 2 THEN ' _(active)_' ELSE '' END FROM region)
SELECT 'world' AS project, row_number() OVER (ORDER BY section, name, pos, part, i, x, line) - 1 AS line_no, line FROM lines_
"""

_SLUG = "regexp_replace(translate(lower({c}), ' _', '--'), '[^a-z0-9-]', '', 'g')"
_MANU = f"""
, ways AS (SELECT o.doc_id, o.pos, o.title, o.node_id, e.to_node, CASE WHEN e.type = 'linear' THEN 'jump' ELSE 'branch' END AS type, CASE WHEN e.weight = 1 THEN 'audience==x' END AS condition, e.created_at, e.edge_id, i.title AS t_title
  FROM ordn o JOIN edges e ON e.from_node = o.node_id LEFT JOIN ordn i ON i.doc_id = o.doc_id AND i.node_id = e.to_node),
parts AS (
SELECT thread_id AS doc_id, 0 AS section, 0 AS a, '' AS b, '# ' || name || chr(10) || chr(10) AS text FROM threads
UNION ALL SELECT doc_id, 1, pos, '', '<a id="' || {_SLUG.format(c='node_id')} || '"></a>' || chr(10) || chr(10) || '## ' || title || chr(10) || chr(10) FROM ordn
UNION ALL SELECT DISTINCT doc_id, 2, 0, '', '---' || chr(10) || chr(10) FROM pieces2
UNION ALL SELECT doc_id, 3, ord, '', CASE WHEN type = 'glue' THEN '*...* ' ELSE text END FROM pieces2
UNION ALL SELECT DISTINCT doc_id, 4, 0, '', chr(10) || chr(10) FROM pieces2
UNION ALL SELECT DISTINCT doc_id, 5, 0, '', '---' || chr(10) || chr(10) || '### Navigation' || chr(10) || chr(10) FROM ways
UNION ALL SELECT DISTINCT doc_id, 6, pos, '0', '**From ' || title || ':**' || chr(10) || chr(10) FROM ways
UNION ALL SELECT doc_id, 6, pos, '1' || lpad(((1700000000 + created_at) * 1000000)::VARCHAR, 20, '0') || edge_id, '- [' || CASE WHEN type = 'branch' THEN '→ ' ELSE '' END || coalesce(t_title, to_node) || CASE WHEN condition IS NOT NULL THEN ' *(if ' || condition || ')*' ELSE '' END || '](#' || {_SLUG.format(c='to_node')} || ')' || chr(10) FROM ways
UNION ALL SELECT DISTINCT doc_id, 6, pos, '2', chr(10) FROM ways)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section, a, b, text) - 1 AS piece_no, text FROM parts
"""

ORACLES = {
    "build_tree": _o("SELECT node_id, parent_id, depth FROM tree", "tree"),
    "flatten_preorder": _o("SELECT node_id, depth, pos FROM pre", "pre"),
    "subtree": _o("SELECT DISTINCT root_id, node_id FROM (SELECT unnest(ids) AS root_id, node_id FROM tree) WHERE root_id IN (SELECT 'n' || n_nationkey FROM nation)", "tree"),
    "neighbours": _o("SELECT pos, node_id, lag(node_id) OVER (ORDER BY pos) AS prev, lead(node_id) OVER (ORDER BY pos) AS next FROM pre", "pre"),
    "outline_stats": _o(
        "SELECT (SELECT count(*) FROM nodes WHERE type = 'outline') AS bullets, (SELECT count(DISTINCT from_node) FROM edges JOIN nodes n ON n.node_id = to_node WHERE edges.type = 'linear' AND n.type = 'chunk_ref') AS with_evidence", "nodes", "edges"
    ),
    "find_roots": _o("SELECT node_id, type FROM nodes WHERE node_id NOT IN (SELECT to_node FROM edges)", "nodes", "edges"),
    "would_create_cycle": _o(
        "SELECT from_node, to_node, EXISTS (SELECT 1 FROM down d WHERE d.start = c.to_node AND d.node = c.from_node) AS cycle FROM cand c", "down", "cand",
        cand=((), "SELECT DISTINCT 'c' || o_custkey AS from_node, 's' || l_suppkey AS to_node FROM orders JOIN lineitem ON o_orderkey = l_orderkey"),
        down=(("cand", "edges"), "SELECT DISTINCT to_node AS start, to_node AS node FROM cand UNION SELECT start, e.to_node FROM down JOIN edges e ON e.from_node = node"),
    ),
    "validate_graph": _o(
        """SELECT 'self_link' AS type, edge_id AS id, from_node AS detail FROM bad WHERE from_node = to_node
        UNION ALL SELECT 'dangling_edge', edge_id, 'to_node ' || to_node FROM bad WHERE to_node NOT IN (SELECT node_id FROM nodes)
        UNION ALL SELECT 'orphan_thread_ref', 't' || n_nationkey, 'z' || n_nationkey FROM nation
        UNION ALL SELECT 'cycle', '', count(*) || ' nodes unsorted' FROM stuck WHERE node IN (SELECT node_id FROM nodes) HAVING count(*) > 0""", "bad", "stuck", "nodes",
        bad=(("edges",), """SELECT edge_id, from_node, to_node FROM edges UNION ALL SELECT 'loop' || s_suppkey, 's' || s_suppkey, 's' || s_suppkey FROM supplier WHERE s_acctbal < 0
        UNION ALL SELECT 'lost' || c_custkey, 'c' || c_custkey, 'x' || c_custkey FROM customer WHERE c_acctbal < 0"""),
        stuck=(("bad",), "SELECT from_node AS node FROM bad WHERE from_node = to_node UNION SELECT to_node FROM stuck JOIN bad ON from_node = node"),
    ),
    "reachable_static": _o(
        "SELECT context_id, node AS node_id FROM reach", "reach",
        ctx=((), "SELECT n_nationkey AS context_id, CASE n_nationkey % 3 WHEN 0 THEN 'expert' WHEN 1 THEN 'novice' ELSE '' END AS audience, n_nationkey % 2 + 1 AS level FROM nation"),
        reach=(("ctx", "edges"), """SELECT context_id, audience, level, unnest(['p' || context_id, 'p' || (context_id + 100)]) AS node FROM ctx
        UNION SELECT context_id, audience, level, to_node FROM reach JOIN edges ON from_node = node WHERE coalesce(condition, '') = '' OR (condition = 'audience==expert' AND audience = 'expert') OR (condition = 'label.level==2' AND level = 2) OR (condition = 'audience!=novice' AND audience <> 'novice')"""),
    ),
    "linearize_thread": _o("SELECT doc_id AS thread_id, pos, node_id, title, false AS missing FROM ordn", "ordn"),
    "collect_spans": _o("SELECT doc_id, idx, chunk_id, text FROM spans", "spans"),
    "stitch_spans": _o("SELECT doc_id, ord, type, chunk_id, text, char_start FROM pieces2", "pieces2"),
    "stitch_stats": _o(
        """SELECT doc_id, c AS chunk_chars, g AS glue_chars, c + g AS total_chars, round(g / (c + g), 6) AS glue_ratio FROM (SELECT doc_id, coalesce(sum(length(text)) FILTER (type = 'chunk'), 0) AS c,
        coalesce(sum(length(text)) FILTER (type = 'glue'), 0) AS g FROM pieces2 GROUP BY doc_id)""", "pieces2"
    ),
    "exits": _o("SELECT from_node, to_node, n.title, e.type, condition FROM edges e LEFT JOIN nodes n ON n.node_id = to_node WHERE e.type <> 'linear'", "edges", "nodes"),
    "diff_states": _o(
        """SELECT node_id, 'removed' AS status, CASE WHEN parent_alive THEN p ELSE g END AS anchor, weight FROM (
        SELECT 'c' || c_custkey AS node_id, 'n' || c_nationkey AS p, n_regionkey <> 1 AS parent_alive, 'r' || n_regionkey AS g, c_custkey % 7 AS weight FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal < 0
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, true, '', n_nationkey % 3 FROM nation WHERE n_regionkey = 1)
        UNION ALL SELECT 'c' || c_custkey, 'changed', NULL, NULL FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT 'new' || s_suppkey, 'added', NULL, NULL FROM supplier"""
    ),
    "outline_report": _o("SELECT 1", "pre", "nodes", "edges", "threads", "thread_nodes", "ordn").rsplit("\n", 1)[0] + "," + _REPORT,
    "manuscript_report": _o("SELECT 1", "ordn", "pieces2", "edges", "threads").rsplit("\n", 1)[0] + _MANU,
    "stitched_manuscript": _o(
        "SELECT thread_id AS doc_id, count(chunk_id) AS pieces FROM threads LEFT JOIN spans ON doc_id = thread_id GROUP BY 1", "threads", "spans",
        halfev=(("evidence",), "SELECT * FROM evidence"),
    ),
    "export_state": _o(
        """SELECT 'threads' AS kind, '{"name":"' || name || '","thread_id":"' || thread_id || '"}' AS json FROM threads
        UNION ALL SELECT 'thread_nodes', '{"node_id":"' || node_id || '","position":' || position || ',"thread_id":"' || thread_id || '"}' FROM thread_nodes
        UNION ALL SELECT 'edges', '{"condition":' || coalesce('"' || condition || '"', 'null') || ',"edge_id":"' || edge_id || '","from_node":"' || from_node || '","to_node":"' || to_node || '","type":"' || type || '","weight":' || weight || '}' FROM edges""",
        "threads", "thread_nodes", "edges",
    ),
    "import_state": _o(
        """SELECT evidence_id, node_id, chunk_id, text, char_start, edited FROM evidence
        UNION ALL SELECT 'legacy:c' || doc_id || ':d' || lpad(doc_id::VARCHAR, 8, '0'), 'c' || doc_id, 'd' || lpad(doc_id::VARCHAR, 8, '0'), '', NULL, NULL FROM labels""", "evidence"
    ),
    "snapshot": _o(
        """SELECT 'v2' AS version_id, 'second' AS label, n AS rows FROM (SELECT (SELECT count(*) FROM nodes) + (SELECT count(*) FROM edges) + (SELECT count(*) FROM threads) + (SELECT count(*) FROM thread_nodes) AS n)
        UNION ALL SELECT 'v1', 'first', (SELECT count(*) FROM nodes) + (SELECT count(*) FROM edges) + (SELECT count(*) FROM threads) + (SELECT count(*) FROM thread_nodes) + (SELECT count(*) FROM evidence)
        UNION ALL SELECT type, 'restored', count(*) FROM nodes GROUP BY type""", "nodes", "edges", "threads", "thread_nodes", "evidence"
    ),
    "export_state_all": _o(_STATE_SQL, *_STATE),
    "import_state_all": _o(
        _STATE_SQL + """ UNION ALL SELECT 'evidence', '{"char_end":null,"char_start":null,"chunk_id":"d' || lpad(doc_id::VARCHAR, 8, '0') || '","edited":null,"evidence_id":"legacy:c' || doc_id || ':d' || lpad(doc_id::VARCHAR, 8, '0')
        || '","node_id":"c' || doc_id || '","position":null,"source_file":null,"text":""}' FROM labels""", *_STATE
    ),
    "restore_all": _o(
        f"SELECT kind, json, version_id FROM ({_STATE_SQL}), (SELECT unnest(['v1', 'v2']) AS version_id) WHERE kind <> 'evidence' OR version_id = 'v1'", *_STATE
    ),
    "supersede_source": _o(
        """SELECT chunk_id, source_file, CASE WHEN deleted_at IS NULL AND source_file IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0) THEN 1800000000 ELSE deleted_at END AS deleted_at FROM chunks
        UNION ALL SELECT 'n' || doc_id, source, NULL FROM documents JOIN labels USING (doc_id) WHERE quality = 0""", "chunks"
    ),
    "supersede_counts": _o(
        "SELECT source_file, count(*) AS superseded FROM live WHERE source_file IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE quality = 0) GROUP BY source_file", "live"
    ),
    "rechunk": _o(
        """SELECT source_file, sum(n) AS rows, sum(live) AS live FROM (SELECT source_file || '.txt' AS source_file, count(*) AS n, count(*) AS live FROM tchunk GROUP BY 1
        UNION ALL SELECT 'u' || substring(chunk_id, 2)::INT || '.txt', 1, CASE WHEN deleted_at IS NULL AND 'u' || substring(chunk_id, 2)::INT NOT IN (SELECT upload_id FROM segments) THEN 1 ELSE 0 END FROM chunks) GROUP BY source_file""",
        "tchunk", "chunks", "segments", segt=(("segments",), "SELECT upload_id AS source_file, ord, text FROM segments"), **_chunk_sql("segt"),
    ),
    "versioned_upsert": """WITH RECURSIVE e AS (SELECT user_id, event_id, event_id % 4 + 1 AS v, event_type FROM events),
        chain AS (SELECT c_custkey AS user_id, 1::BIGINT AS v, -1::BIGINT AS seq FROM customer
            UNION ALL SELECT chain.user_id, chain.v + 1, min(e.event_id) FROM chain JOIN e ON e.user_id = chain.user_id AND e.v = chain.v AND e.event_id > chain.seq GROUP BY chain.user_id, chain.v),
        ok AS (SELECT e.* FROM e JOIN chain ON chain.user_id = e.user_id AND chain.seq = e.event_id AND chain.v = e.v + 1)
        SELECT c_custkey AS node_id, coalesce(arg_max(event_type || ' ' || event_id, event_id) FILTER (event_type <> 'error'), any_value(c_name)) AS title,
        coalesce(arg_max(event_type, event_id), '') AS body, 1 + count(event_id) AS version, 'kept' AS what FROM customer LEFT JOIN ok ON user_id = c_custkey GROUP BY c_custkey
        UNION ALL SELECT user_id, '', '', count(*), CASE WHEN user_id IN (SELECT c_custkey FROM customer) THEN 'conflict' ELSE 'not_found' END FROM e WHERE (user_id, event_id) NOT IN (SELECT user_id, event_id FROM ok) GROUP BY ALL""",
    "cascade_delete": _o(
        """SELECT 'nodes' AS kind, node_id AS id FROM nodes WHERE node_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'edges', edge_id FROM edges WHERE from_node NOT IN (SELECT * FROM gone) AND to_node NOT IN (SELECT * FROM gone)
        UNION ALL SELECT 'thread_nodes', node_id FROM thread_nodes WHERE node_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'evidence', evidence_id FROM evidence WHERE node_id NOT IN (SELECT * FROM gone)
        UNION ALL SELECT 'missing', 'zz' || n_nationkey FROM nation""", "nodes", "edges", "thread_nodes", "evidence", "gone",
        gone=((), "SELECT 'c' || c_custkey AS node_id FROM customer WHERE c_acctbal < 0"),
    ),
    "apply_changes": """WITH RECURSIVE e AS (SELECT user_id * 2 AS k, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i,
            CASE WHEN event_id % 3 > 0 THEN 'ev' || event_id END AS name, CASE WHEN event_id % 3 = 0 THEN event_id % 25 END AS nation FROM events),
        run AS (SELECT k, 0::BIGINT AS i, s_suppkey IS NOT NULL AS lives, s_name AS name, s_nationkey::BIGINT AS nation, '' AS lost
            FROM (SELECT DISTINCT k FROM e) LEFT JOIN supplier ON s_suppkey = k
            UNION ALL SELECT run.k, e.i, CASE e.event_type WHEN 'purchase' THEN true WHEN 'error' THEN false ELSE lives END,
            CASE WHEN e.event_type = 'error' THEN NULL WHEN lives OR e.event_type = 'purchase' THEN coalesce(e.name, CASE WHEN lives THEN run.name END) END,
            CASE WHEN e.event_type = 'error' THEN NULL WHEN lives OR e.event_type = 'purchase' THEN coalesce(e.nation, CASE WHEN lives THEN run.nation END) END,
            CASE WHEN lives OR e.event_type = 'purchase' THEN '' WHEN e.event_type = 'error' THEN 'delete' ELSE 'update' END
            FROM run JOIN e ON e.k = run.k AND e.i = run.i + 1)
        SELECT s_suppkey AS k, s_name AS name, s_nationkey AS nation FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM e)
        UNION ALL SELECT k, arg_max(struct_pack(x := name), i).x, arg_max(struct_pack(x := nation), i).x FROM run GROUP BY k HAVING arg_max(lives, i)
        UNION ALL SELECT k, 'not found: ' || lost, count(*) FROM run WHERE lost <> '' GROUP BY ALL""",
    "replace_thread_nodes": _o(
        """SELECT thread_id, node_id, position FROM thread_nodes WHERE thread_id NOT IN (SELECT 't' || n_nationkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 0)
        UNION ALL SELECT 't' || n_nationkey, 's' || s_suppkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 0""", "thread_nodes"
    ),
    "align_quotes": _o(
        """SELECT quote_id, coalesce(hs, 0) AS char_start, CASE WHEN hs IS NOT NULL THEN hs + hl WHEN ok THEN char_end ELSE length(content) END AS char_end, md5(t) AS text_md5,
        CASE WHEN length(t) <= 80 THEN t ELSE substring(t, 1, 80) || '…' END AS title FROM (
        SELECT *, CASE WHEN hs IS NOT NULL THEN substring(content, hs + 1, hl) WHEN ok THEN text ELSE content END AS t FROM (
        SELECT *, content IS NULL OR (text <> '' AND char_end > 0 AND char_end <= length(content)) AS ok,
        CASE WHEN sel = '' THEN NULL WHEN instr(content, sel) > 0 THEN instr(content, sel) - 1 WHEN hit <> '' THEN instr(content, hit) - 1 END AS hs,
        CASE WHEN instr(content, sel) > 0 THEN length(sel) ELSE length(hit) END AS hl FROM (
        SELECT *, regexp_extract(content, array_to_string(list_transform(%s, lambda x: regexp_escape(x)), '%s+')) AS hit FROM (
        SELECT evidence_id AS quote_id, position AS char_end, content, qt AS text, %s AS sel FROM (
        SELECT *, CASE position WHEN 1 THEN replace(text, ' ', '  ') WHEN 2 THEN '' ELSE text END AS qt FROM evidence) LEFT JOIN chunks USING (chunk_id)))))"""
        % (_words("sel"), fx.WS_SQL, _trim("qt")),
        "evidence", "chunks",
    ),
    "audit_evidence": _o(
        """SELECT evidence_id, CASE WHEN c.chunk_id IS NULL THEN 'unresolved' WHEN c.deleted_at IS NOT NULL THEN 'superseded' WHEN d AND edited THEN 'edited' WHEN d THEN 'drift' ELSE 'ok' END AS verdict FROM (
        SELECT e.*, c AS c, CASE WHEN char_end > length(c.content) THEN text <> c.content ELSE substring(c.content, char_start + 1, char_end - char_start) <> text END AS d FROM evidence e LEFT JOIN chunks c USING (chunk_id))""", "evidence", "chunks"
    ),
    "detach_unresolved": _o(
        """SELECT 'nodes' AS kind, node_id AS id FROM nodes WHERE node_id NOT IN (SELECT node_id FROM evidence WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks))
        UNION ALL SELECT 'evidence', evidence_id FROM evidence WHERE node_id NOT IN (SELECT node_id FROM evidence WHERE chunk_id NOT IN (SELECT chunk_id FROM chunks))""", "nodes", "evidence", "chunks"
    ),
    "constraint_checks": """SELECT 'edges.type' AS rule, l_orderkey || '-' || l_linenumber AS key, 1 AS n FROM lineitem WHERE l_returnflag = 'R'
        UNION ALL SELECT 'edges.unique', l_partkey || '|' || l_suppkey, count(*) FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1
        UNION ALL SELECT 'thread_nodes.unique', c_nationkey || '|' || c_mktsegment, count(*) FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1
        UNION ALL SELECT 'region_members.unique', (label % 2) || '|' || label, count(*) FROM embeddings GROUP BY label HAVING count(*) > 1
        UNION ALL SELECT 'branches.active', '', count(*) FROM region WHERE r_regionkey > 2 HAVING count(*) > 1
        UNION ALL SELECT 'region_links.order', n_nationkey || '|' || n_regionkey, 1 FROM nation WHERE n_nationkey >= n_regionkey""",
    "invalidate_vectors": _o("SELECT count(*) FILTER (len(vec) > 0) AS cleared, 0 AS \"left\", count(*) AS rows, 'new' AS value FROM chunks", "chunks"),
    "meta_upsert": """SELECT n_name AS key, n_regionkey::VARCHAR AS value FROM nation WHERE n_name NOT IN (SELECT 'NATION_' || r_regionkey FROM region) UNION ALL SELECT 'NATION_' || r_regionkey, r_name FROM region UNION ALL SELECT r_name, 'x' FROM region""",
    "index_gap": _o(
        """SELECT chunk_id, 'keyword' AS missing FROM live WHERE chunk_id NOT IN (SELECT 'd' || lpad(doc_id::VARCHAR, 8, '0') FROM labels)
        UNION ALL SELECT chunk_id, 'vector' FROM live WHERE len(vec) > 0 AND chunk_id NOT IN (SELECT chunk_id FROM vecs WHERE label < 5)""", "live", "vecs"
    ),
}
