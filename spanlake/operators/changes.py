"""Change data, versions, citations and integrity checks; whole-state export and import."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.conditions import excerpt_diverges
from spanlake.functions.text import locate_selection, preview_text
from spanlake.ordered import latest, with_last
from spanlake.runtime import cut

State = dict[str, DataFrame]

# ---- corpus changes ------------------------------------------------------------------------------


def supersede_source(chunks: DataFrame, new: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """chunks with the live rows of re-ingested sources closed and ``new`` added, and (source_file, superseded)."""
    now = F.current_timestamp() if now is None else now
    incoming = new.select("source_file").distinct().withColumn("_in", F.lit(True))
    marked = chunks.join(incoming, "source_file", "left")
    hit = F.coalesce("_in", F.lit(False)) & F.col("deleted_at").isNull()
    closed = marked.withColumn("deleted_at", F.when(hit, now).otherwise(F.col("deleted_at"))).drop("_in")
    counts = marked.filter(hit).groupBy("source_file").agg(F.count(F.lit(1)).alias("superseded"))
    return closed.select(*chunks.columns).unionByName(new, allowMissingColumns=True), counts


def rechunk(uploads: DataFrame, segments: DataFrame, chunks: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks rebuilt from the stored segments of uploads (upload_id, filename), superseding the old ones."""
    from spanlake.operators.transcripts import chunk_transcript

    sents = segments.join(uploads.select("upload_id", F.col("filename").alias("source_file")), "upload_id")
    made = chunk_transcript(sents.select("source_file", "ord", "text"))
    now = F.current_timestamp() if now is None else now
    made = made.withColumns({"created_at": now, "deleted_at": F.lit(None).cast("timestamp")})
    return supersede_source(chunks, made, now)


def invalidate_vectors(chunks: DataFrame, meta: DataFrame, model: str, dim: int | None = None, key: str = "embed_model") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop all vectors when they come from another model; returns chunks, meta and (cleared).

    Without a marker, vectors count as foreign when one has another length than ``dim``.
    """
    marker = meta.filter(F.col("key") == key).agg(F.max("value").alias("marker"))
    has = F.col("vec").isNotNull() & (F.size("vec") > 0)
    foreign = chunks.filter(has).agg(F.coalesce(F.max((F.size("vec") != F.lit(dim)) if dim else F.lit(False)), F.lit(False)).alias("foreign"))
    drop = marker.crossJoin(foreign).select(  # one row each
        F.when(F.coalesce("marker", F.lit("")) != "", F.col("marker") != model).otherwise(F.col("foreign")).alias("drop")
    )
    judged = chunks.crossJoin(F.broadcast(drop))
    out = judged.withColumn("vec", F.when(~F.col("drop"), F.col("vec"))).select(*chunks.columns)
    cleared = judged.agg(F.count_if(F.col("drop") & has).alias("cleared"))
    row = meta.sparkSession.createDataFrame([(key, model)], "key string, value string")
    return out, meta_upsert(meta, row), cleared


def meta_upsert(meta: DataFrame, rows: DataFrame) -> DataFrame:
    """meta with ``rows`` (key, value, optionally seq) in place of those of equal key; the latest row of a key counts."""
    fresh = latest(rows.select("key", "value", *[c for c in ("seq",) if c in rows.columns]), ["key"], "seq")
    return meta.select("key", "value").join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def meta_get(meta: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) with "" for an absent key."""
    return keys.select("key").join(meta, "key", "left").select("key", F.coalesce("value", F.lit("")).alias("value"))


def index_gap(chunks: DataFrame, keyword_ids: DataFrame, vector_ids: DataFrame) -> DataFrame:
    """(chunk_id, missing): stored but not in the keyword index, embedded but not in the vector index."""
    has = F.col("vec").isNotNull() & (F.size("vec") > 0)
    live = chunks.filter(F.col("deleted_at").isNull())
    a = live.join(keyword_ids.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", F.lit("keyword").alias("missing"))
    b = live.filter(has).join(vector_ids.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", F.lit("vector").alias("missing"))
    return a.unionByName(b)


# ---- document changes ----------------------------------------------------------------------------


def versioned_upsert(nodes: DataFrame, edits: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes after the edits whose version matches, and the refused edits with a reason.

    edits: (node_id, version, seq, title, body, locked), applied per node by ``seq``: an edit counts if
    it was made against the version that the node has by then, and raises it by one. Null leaves a
    column as it is. All nodes take their next edit in one step, so there are as many steps as the
    longest chain of accepted edits.
    """
    now = F.current_timestamp() if now is None else now
    known = edits.join(nodes.select("node_id"), "node_id", "left_semi")
    state = cut(nodes.select("node_id", F.col("version").alias("_v"), F.lit(None).cast("long").alias("_at")))
    taken: list[DataFrame] = []
    while True:
        fits = (F.col("version") == F.col("_v")) & (F.col("_at").isNull() | (F.col("seq") > F.col("_at")))
        step = cut(known.select("node_id", "version", "seq").join(state, "node_id").filter(fits).groupBy("node_id", "_v").agg(F.min("seq").cast("long").alias("seq")))
        if step.isEmpty():
            break
        taken.append(step.select("node_id", "seq", F.col("_v").alias("version")))
        state = step.select("node_id", (F.col("_v") + 1).alias("_v"), F.col("seq").alias("_at"))
    ids = reduce(DataFrame.unionByName, taken) if taken else known.select("node_id", "seq", "version").limit(0)
    ok = edits.join(ids, ["node_id", "seq", "version"], "left_semi")
    bad = edits.join(ids, ["node_id", "seq", "version"], "left_anti").join(nodes.select("node_id", F.lit(True).alias("_in")), "node_id", "left")
    bad = bad.select("node_id", "seq", F.when(F.col("_in"), "conflict").otherwise("not_found").alias("reason"))
    cols = ("title", "body", "locked")
    # the latest value that is not null
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c))).alias("_" + c) for c in cols]
    out = nodes.join(ok.groupBy("node_id").agg(F.count(F.lit(1)).alias("_n"), *last), "node_id", "left")
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col("_" + c)[c], F.col(c)))
    out = out.withColumn("version", (F.col("version") + F.coalesce("_n", F.lit(0))).cast(nodes.schema["version"].dataType))
    if "updated_at" in nodes.columns:
        out = out.withColumn("updated_at", F.when(F.col("_n") > 0, now).otherwise(F.col("updated_at")))
    return out.select(*nodes.columns), bad


def cascade_delete(state: State, ids: DataFrame) -> tuple[State, DataFrame]:
    """State without the nodes and everything hanging on them, and the ids that were not there."""
    gone = ids.select("node_id").distinct()
    out = dict(state)
    for name, cols in (("nodes", ["node_id"]), ("edges", ["from_node", "to_node"]), ("thread_nodes", ["node_id"]), ("evidence", ["node_id"])):
        if name in out:
            for c in cols:
                out[name] = out[name].join(gone.select(F.col("node_id").alias(c)), c, "left_anti")
    return out, gone.join(state["nodes"].select("node_id"), "node_id", "left_anti")


def apply_changes(table: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """table after a batch of insert / update / delete rows, and the changes to unknown keys.

    changes: (op, seq, key, columns of the table), applied per key by ``seq``, each judged on what
    exists before it: an update or delete of a missing key is reported (key, op) and does nothing; an
    insert of an existing key updates it; null leaves a column as it is; an insert after a delete
    starts from nothing. Values come from combinable maxima, existence from a running one that splits
    a hot key over tasks.
    """
    cols = [c for c in table.columns if c != key]
    there = table.select(key, F.struct(*cols).alias("t"))
    marker = F.when(F.col("op") != "update", F.struct("seq", (F.col("op") == "insert").alias("lives")))
    judged = with_last(changes.select(key, "op", "seq", *cols), [key], ["seq"], marker, "_before").join(there.select(key, F.lit(True).alias("_in")), key, "left")
    exists = F.coalesce(F.col("_before.lives"), F.col("_in"), F.lit(False))
    judged = judged.withColumn("_ok", exists | (F.col("op") == "insert"))
    lost = judged.filter(~F.col("_ok")).select(key, "op")
    writes = F.col("op") != "delete"
    done = judged.filter("_ok").groupBy(key).agg(
        F.max(F.when(~writes, F.col("seq"))).alias("_floor"),
        F.max(marker).alias("_last"),
        *[F.max(F.when(writes & F.col(c).isNotNull(), F.struct("seq", F.col(c).alias("v")))).alias("_" + c) for c in cols],
    )
    both = there.join(done, key, "full_outer")
    alive = both.filter(F.coalesce(F.col("_last.lives"), F.col("t").isNotNull()))

    def value(c: str) -> Column:
        fresh = F.col("_" + c).isNotNull() & (F.col("_floor").isNull() | (F.col("_" + c)["seq"] > F.col("_floor")))
        return F.when(fresh, F.col("_" + c)["v"]).when(F.col("_floor").isNull(), F.col("t")[c]).alias(c)

    return alive.select(key, *[value(c) for c in cols]).select(*table.columns), lost


def replace_thread_nodes(thread_nodes: DataFrame, lists: DataFrame) -> DataFrame:
    """The whole node list of each given thread replaced; lists: (thread_id, nodes array in order)."""
    fresh = lists.select("thread_id", F.posexplode("nodes").alias("position", "node_id"))
    return (
        thread_nodes.join(lists.select("thread_id").distinct(), "thread_id", "left_anti")
        .select("thread_id", "node_id", "position")
        .unionByName(fresh.select("thread_id", "node_id", "position"))
    )


# ---- citations -----------------------------------------------------------------------------------


def align_quotes(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence rows for quoted text: (quote_id, node_id, chunk_id, source_file, char_start, char_end, text, title).

    The text is looked up in its chunk and taken from there; a blank or lost quote without a usable range
    cites the whole chunk. A quote of an unknown chunk stays as it is, with null source_file.
    quotes: (quote_id, node_id, chunk_id, char_start, char_end, text).
    """
    rows = quotes.join(chunks.select("chunk_id", "source_file", "content"), "chunk_id", "left").withColumn(
        "hit", locate_selection("content", "text")
    )
    n = F.char_length("content")
    ok = (F.coalesce("text", F.lit("")) != "") & (F.col("char_end") > F.col("char_start")) & (F.col("char_start") >= 0) & (F.col("char_end") <= n)
    ok = ok | F.col("content").isNull()
    found = F.col("hit").isNotNull()
    start = F.when(found, F.col("hit.start")).when(ok, F.col("char_start")).otherwise(F.lit(0))
    end = F.when(found, F.col("hit.end")).when(ok, F.col("char_end")).otherwise(n)
    text = (
        F.when(found, F.substring("content", F.col("hit.start") + 1, F.col("hit.end") - F.col("hit.start")))
        .when(ok, F.col("text"))
        .otherwise(F.col("content"))
    )
    return rows.select(
        "quote_id", "node_id", "chunk_id", "source_file", start.alias("char_start"), end.alias("char_end"), text.alias("text")
    ).withColumn("title", preview_text("text", 80))


def audit_evidence(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """evidence rows with their ``verdict``: unresolved, superseded, edited, drift or ok."""
    c = chunks.select("chunk_id", "content", F.col("deleted_at").isNotNull().alias("_gone"))
    differs = excerpt_diverges(F.col("text"), F.col("char_start"), F.col("char_end"), F.col("content"))
    return (
        evidence.join(c, "chunk_id", "left")
        .withColumn(
            "verdict",
            F.when(F.col("_gone").isNull(), "unresolved")
            .when(F.col("_gone"), "superseded")
            .when(differs & F.col("edited"), "edited")
            .when(differs, "drift")
            .otherwise("ok"),
        )
        .drop("content", "_gone")
    )


def detach_unresolved(state: State, audited: DataFrame) -> State:
    """State without unresolved evidence rows and the bullets that carried them."""
    bad = audited.filter("verdict = 'unresolved'")
    out, _ = cascade_delete(state, bad.select("node_id"))
    out["evidence"] = out["evidence"].join(bad.select("evidence_id"), "evidence_id", "left_anti")
    return out


# ---- integrity -----------------------------------------------------------------------------------


def constraint_checks(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(rule, key, n) of every violated rule among the given tables."""
    found: list[DataFrame] = []

    def bad_enum(name: str, col: str, key: str, allowed: Sequence[str]) -> None:
        if name in tables:
            rows = tables[name].filter(~F.coalesce(F.col(col), F.lit("")).isin(list(allowed)))
            found.append(rows.select(F.lit(f"{name}.{col}").alias("rule"), F.col(key).cast("string").alias("key"), F.lit(1).cast("long").alias("n")))

    def repeated(name: str, cols: Sequence[str], rule: str, where: str | None = None, most: int = 1) -> None:
        if name in tables:
            df = tables[name] if where is None else tables[name].filter(where)
            rows = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
            found.append(rows.select(F.lit(rule).alias("rule"), F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("key"), "n"))

    bad_enum("nodes", "type", "node_id", ["outline", "chunk_ref", "synth"])
    bad_enum("edges", "type", "edge_id", ["linear", "branch", "jump"])
    bad_enum("uploads", "status", "upload_id", ["pending", "transcribing", "done", "failed"])
    repeated("edges", ["from_node", "to_node"], "edges.unique")
    repeated("thread_nodes", ["thread_id", "position"], "thread_nodes.unique")
    repeated("region_members", ["build_id", "chunk_id"], "region_members.unique")
    if "branches" in tables:
        n = tables["branches"].agg(F.count_if(F.col("active")).alias("n")).filter("n > 1")
        found.append(n.select(F.lit("branches.active").alias("rule"), F.lit("").alias("key"), "n"))
    if "region_links" in tables:
        rows = tables["region_links"].filter("region_a >= region_b")
        found.append(rows.select(F.lit("region_links.order").alias("rule"), F.concat_ws("|", "region_a", "region_b").alias("key"), F.lit(1).cast("long").alias("n")))
    return reduce(DataFrame.unionByName, found)


# ---- whole state ---------------------------------------------------------------------------------


def export_state(state: State) -> DataFrame:
    """(kind, json): the whole state as JSON lines, one per row of every table."""
    parts = [
        df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json"))
        for kind, df in state.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def import_state(lines: DataFrame, schemas: Mapping[str, T.StructType]) -> State:
    """Tables from exported lines. Old ``node_chunks`` lines {node_id, chunk_id} become evidence
    without text."""
    out = {}
    for kind, schema in schemas.items():
        rows = lines.filter(F.col("kind") == kind).select(F.from_json("json", schema).alias("r")).select("r.*")
        if kind == "evidence":
            old = lines.filter(F.col("kind") == "node_chunks").select(F.from_json("json", "node_id string, chunk_id string").alias("r"))
            old = old.select(
                F.concat_ws(":", F.lit("legacy"), "r.node_id", "r.chunk_id").alias("evidence_id"), "r.node_id", "r.chunk_id", F.lit("").alias("text")
            )
            keep = [c for c in old.columns if c in schema.fieldNames()]
            rows = rows.unionByName(old.select(*keep), allowMissingColumns=True)
        out[kind] = rows
    return out


def snapshot(lines: DataFrame, version_id: str, label: str, created_at: Column) -> DataFrame:
    """(version_id, label, created_at, kind, json): an exported state kept as a named version."""
    return lines.select(F.lit(version_id).alias("version_id"), F.lit(label).alias("label"), created_at.alias("created_at"), "kind", "json")


def snapshot_summaries(versions: DataFrame) -> DataFrame:
    """(version_id, label, created_at, rows); read newest first by created_at."""
    return versions.groupBy("version_id", "label", "created_at").agg(F.count(F.lit(1)).alias("rows"))


def restore(versions: DataFrame, version_id: str, schemas: Mapping[str, T.StructType]) -> State:
    return import_state(versions.filter(F.col("version_id") == version_id), schemas)
