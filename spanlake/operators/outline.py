"""Outline trees, graph walks, threads and stitched manuscripts as join loops."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions.conditions import eval_condition
from spanlake.functions.text import collapse_ws, slugify, trim_ws
from spanlake.ordered import with_ordinal, with_running
from spanlake.runtime import cut, has_at_most, stored

# ---- tree ----------------------------------------------------------------------------------------


def build_tree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, parent_id, depth, path): the outline forest.

    ``path`` holds the (weight, created_at, id) of every step from the root, so sorting by it is the
    depth-first order and no sibling list is ever ranked in one place. A node with two parents
    appears twice. One join per level; a node already on its own path is not entered again.
    """
    known = nodes.filter(F.col("type").isin("outline", "chunk_ref")).select("node_id", "type", "created_at")
    links = (
        edges.filter("type = 'linear'")
        .select("from_node", "to_node", "weight")
        .join(known.select(F.col("node_id").alias("from_node")), "from_node", "left_semi")
        .join(known.select(F.col("node_id").alias("to_node"), F.col("created_at").alias("to_created")), "to_node")
    )
    links = cut(links)
    step = F.struct(F.lit(0).alias("w"), F.col("created_at").alias("t"), F.col("node_id").alias("id"))
    wave = cut(
        known.filter("type = 'outline'")
        .join(links.select(F.col("to_node").alias("node_id")).distinct(), "node_id", "left_anti")
        .select("node_id", F.lit("").alias("parent_id"), F.lit(0).alias("depth"), F.array(step).alias("path"))
    )
    out = wave
    while True:
        child = F.struct(F.col("weight").alias("w"), F.col("to_created").alias("t"), F.col("to_node").alias("id"))
        wave = cut(
            wave.join(links, wave["node_id"] == links["from_node"])
            .filter(~F.exists("path", lambda s: s["id"] == F.col("to_node")))
            .select(
                F.col("to_node").alias("node_id"),
                F.col("from_node").alias("parent_id"),
                (F.col("depth") + 1).alias("depth"),
                F.concat("path", F.array(child)).alias("path"),
            )
        )
        if wave.isEmpty():
            return out
        out = out.unionByName(wave)


def flatten_preorder(tree: DataFrame) -> DataFrame:
    """tree plus ``pos``, its place in depth-first order."""
    return with_ordinal(tree, [], ["path"], "pos")


def subtree(tree: DataFrame, ids: DataFrame) -> DataFrame:
    """(root_id, node_id): every wanted node with itself and all its descendants."""
    return (
        tree.select("node_id", F.explode(F.transform("path", lambda s: s["id"])).alias("root_id"))
        .join(ids.select(F.col("node_id").alias("root_id")).distinct(), "root_id", "left_semi")
        .select("root_id", "node_id")
        .distinct()
    )


def neighbours(preorder: DataFrame) -> DataFrame:
    """(pos, node_id, prev, next) in depth-first order."""
    base = preorder.select("pos", "node_id")
    before = base.select((F.col("pos") + 1).alias("pos"), F.col("node_id").alias("prev"))
    after = base.select((F.col("pos") - 1).alias("pos"), F.col("node_id").alias("next"))
    return base.join(before, "pos", "left").join(after, "pos", "left")


def outline_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(bullets, with_evidence), one row."""
    bullets = nodes.agg(F.count_if(F.col("type") == "outline").alias("bullets"))
    cited = edges.filter("type = 'linear'").join(
        nodes.filter("type = 'chunk_ref'").select(F.col("node_id").alias("to_node")), "to_node", "left_semi"
    )
    return bullets.crossJoin(cited.agg(F.count_distinct("from_node").alias("with_evidence")))


# ---- graph ---------------------------------------------------------------------------------------


def find_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("to_node").alias("node_id")).distinct(), "node_id", "left_anti")


MAX_LEVELS = 32  # a longer chain counts as one without an end


def _spread(nodes: DataFrame, hop: DataFrame, out: str, into: str) -> DataFrame:
    """(node): all that ``nodes`` lead to along ``hop``, themselves included."""
    waves = [cut(nodes.select(F.col(nodes.columns[0]).alias("node")).distinct())]
    while not waves[-1].isEmpty():
        wave = waves[-1].join(hop, F.col("node") == F.col(out)).select(F.col(into).alias("node")).distinct()
        for seen in waves:
            wave = wave.join(seen, "node", "left_anti")
        waves.append(cut(wave))
    return reduce(DataFrame.unionByName, waves[:-1], waves[-1])


def _levels(nodes: DataFrame, hop: DataFrame) -> int | None:
    """Number of steps of the longest chain that begins at ``nodes``; None for cycles and very long ones."""
    wave = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    for n in range(MAX_LEVELS):
        wave = cut(wave.join(hop, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct())
        if wave.isEmpty():
            return n
    return None


def would_create_cycle(candidates: DataFrame, edges: DataFrame, direction: str = "up") -> DataFrame:
    """candidates (from_node, to_node) plus ``cycle``: is from reachable from to.

    Only edges on a way from some candidate's to to some candidate's from count. Both ends are followed towards each
    other, the side that grows less next, until a side has ended or both have gone as far as the longest chain is;
    a candidate closes a cycle when its ends have met. ``direction`` names the side that sets the first bound: up from
    the from nodes or down from the to nodes.
    """
    candidates = cut(candidates)
    hop = cut(edges.select(F.col("from_node").alias("a"), F.col("to_node").alias("b")).distinct())
    tops, ends = candidates.select("to_node").distinct(), candidates.select("from_node").distinct()
    sides = [(tops, "a", "b"), (ends, "b", "a")]
    for nodes, out, into in sides if direction == "down" else sides[::-1]:
        hop = cut(hop.join(_spread(nodes, hop, out, into), F.col(out) == F.col("node"), "left_semi"))
    levels = _levels(tops, hop)
    # what each end has met, and what of it is new
    met = {into: cut(nodes.select(F.col(nodes.columns[0]).alias("end"), F.col(nodes.columns[0]).alias("node"))) for nodes, _, into in sides}
    new = dict(met)
    turns = 0
    while levels is None or turns < levels:
        grown = {}
        for _, out, into in sides:
            many = hop.groupBy(F.col(out).alias("node")).agg(F.count(F.lit(1)).alias("n"))
            grown[into] = new[into].join(many, "node").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        into = min(grown, key=grown.get)
        if not grown[into]:
            break
        out = "a" if into == "b" else "b"
        step = new[into].join(hop, F.col("node") == F.col(out)).select("end", F.col(into).alias("node")).distinct()
        new[into] = cut(step.join(met[into], ["end", "node"], "left_anti"))
        met[into] = met[into].unionByName(new[into])
        turns += 1
    down = met["b"].withColumnRenamed("end", "to_node")
    up = met["a"].withColumnRenamed("end", "from_node")
    hit = (
        candidates.select("from_node", "to_node").distinct().join(down, "to_node").join(up, ["from_node", "node"], "left_semi")
        .select("from_node", "to_node", F.lit(True).alias("cycle")).distinct()
    )
    return candidates.join(hit, ["from_node", "to_node"], "left").withColumn("cycle", F.coalesce("cycle", F.lit(False)))


def topological_waves(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sorted (node_id, pos) in first-in first-out order, and the nodes left over by cycles.

    A node becomes ready when its last parent is taken, so its place inside a wave is (place of that
    parent, order of that parent's edge): one join and one ranking per wave.
    """
    deg = edges.groupBy(F.col("to_node").alias("node_id")).agg(F.count(F.lit(1)).alias("deg"))
    left = cut(
        nodes.select("node_id", "created_at")
        .join(deg, "node_id", "left")
        .select(
            "node_id",
            "created_at",
            F.coalesce("deg", F.lit(0)).cast("long").alias("deg"),
            F.lit(None).cast("struct<pos:bigint,at:timestamp,edge:string>").alias("last"),
        )
    )
    step = edges.select("from_node", "to_node", F.col("created_at").alias("at"), F.col("edge_id").alias("edge"))
    wave = cut(with_ordinal(left.filter("deg = 0"), [], ["created_at", "node_id"], "pos").select("node_id", "pos"))
    left = left.filter("deg > 0")
    taken = wave.count()
    out = wave
    while True:
        push = (
            wave.join(step, wave["node_id"] == step["from_node"])
            .groupBy(F.col("to_node").alias("node_id"))
            .agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("pos", "at", "edge")).alias("got"))
        )
        left = cut(
            left.join(push, "node_id", "left").select(
                "node_id",
                "created_at",
                (F.col("deg") - F.coalesce("n", F.lit(0))).alias("deg"),
                F.greatest("last", "got").alias("last"),
            )
        )
        ready = left.filter("deg = 0")
        n = ready.count()
        if n == 0:
            return out, left.select("node_id")
        wave = cut(with_ordinal(ready, [], ["last", "node_id"], "pos", start=taken).select("node_id", "pos"))
        left = left.filter("deg > 0")
        taken += n
        out = out.unionByName(wave)


def topological_sort(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, pos); raises when the graph has a cycle."""
    done, stuck = topological_waves(nodes, edges)
    n = stuck.count()
    if n:
        total = nodes.count()
        raise ValueError(f"cycle detected: sorted {total - n} of {total} nodes")
    return done


def validate_graph(nodes: DataFrame, edges: DataFrame, thread_nodes: DataFrame) -> DataFrame:
    """(type, id, detail) of every problem; a valid graph gives no rows."""
    known = nodes.select(F.col("node_id").alias("n"))

    def issue(df: DataFrame, kind: str, key: str, detail) -> DataFrame:
        return df.select(F.lit(kind).alias("type"), F.col(key).alias("id"), detail.alias("detail"))

    def lost(side: str) -> DataFrame:
        gone = edges.join(known, edges[side] == known["n"], "left_anti")
        return issue(gone, "dangling_edge", "edge_id", F.concat(F.lit(side + " "), F.col(side)))

    orphans = thread_nodes.join(known, thread_nodes["node_id"] == known["n"], "left_anti")
    _, stuck = topological_waves(nodes, edges)
    loop = stuck.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        F.lit("cycle").alias("type"), F.lit("").alias("id"), F.concat(F.col("n").cast("string"), F.lit(" nodes unsorted")).alias("detail")
    )
    return (
        issue(edges.filter("from_node = to_node"), "self_link", "edge_id", F.col("from_node"))
        .unionByName(lost("from_node"))
        .unionByName(lost("to_node"))
        .unionByName(issue(orphans, "orphan_thread_ref", "thread_id", F.col("node_id")))
        .unionByName(loop)
    )


# ---- reader walks --------------------------------------------------------------------------------

_HAS_READ = r"(?s)^(!?)has_read\((.*)\)$"


def reachable_static(contexts: DataFrame, edges: DataFrame) -> DataFrame:
    """(context_id, node_id) reachable over edges whose condition holds; a condition on the reading
    history counts as open.

    contexts: (context_id, audience, labels, starts array<string>).
    """
    ctx = contexts.select("context_id", "audience", "labels")
    wave = cut(contexts.select("context_id", F.explode("starts").alias("node_id")).distinct())
    seen = wave
    none = F.array().cast("array<string>")
    cond = trim_ws(F.coalesce("condition", F.lit("")))
    closed = (cond != "") & ~cond.rlike(_HAS_READ)  # only these depend on the reader
    hop = cut(edges.select("from_node", "to_node", F.when(closed, F.col("condition")).alias("condition")))
    while True:
        held = F.col("condition").isNull() | eval_condition(F.col("condition"), F.col("audience"), none, F.col("labels"))
        wave = cut(
            wave.join(hop, wave["node_id"] == hop["from_node"])
            .join(ctx, "context_id")
            .filter(held)
            .select("context_id", F.col("to_node").alias("node_id"))
            .distinct()
            .join(seen, ["context_id", "node_id"], "left_anti")
        )
        if wave.isEmpty():
            return seen
        seen = seen.unionByName(wave)


_ORDER = ["weight", "created_at", "edge_id"]
_TREE_LEVELS = 32  # higher trees are walked node by node from there on
_SENT = 100_000  # rows that are sent to all tasks
_PIECE = 1 << 16  # places of a run that are joined at a time


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if has_at_most(df, _SENT) else df


def _marked(edges: DataFrame) -> DataFrame:
    """edges plus ``opens``, is it open whenever it comes up, and ``told``, the node whose reading decides, if any.

    A node's own edges come up after it was read, and a node that was read is not entered again. Plain conditions are
    recognised as they are; the patterns are for the others.
    """
    c, ends = F.col("condition"), (F.col("from_node"), F.col("to_node"))
    cond = trim_ws(F.coalesce(c, F.lit("")))
    need, not_read = trim_ws(F.regexp_extract(cond, _HAS_READ, 2)), F.regexp_extract(cond, _HAS_READ, 1) == "!"
    plain = [(c == F.concat(F.lit(said), end, F.lit(")"))) & end.rlike("^[!-~]*$") for said, end in zip(("has_read(", "!has_read("), ends)]
    own = cond.rlike(_HAS_READ) & F.when(not_read, need == ends[1]).otherwise(need == ends[0])
    marked = edges.withColumn(
        "opens",
        F.when(c.isNull(), True)
        .when(c.contains("has_read("), F.coalesce(plain[0] | plain[1], F.lit(False)) | F.coalesce(own, F.lit(False)))
        .when(c.rlike("[!-~]"), False)
        .otherwise(cond == ""),
    )
    return marked.withColumn("told", F.when(c.contains("has_read(") & ~F.col("opens") & cond.rlike(_HAS_READ), need))


def _private_trees(contexts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Nodes that everyone who enters their parent meets in turn, with all that lies below them: (node, parent, *_ORDER,
    size) of those with a parent of another kind, the same of those below, and the number of levels.

    Such a node has one edge into it, one that opens whenever it comes up, edges to such nodes alone, and is no start,
    nor read before, nor named by a condition that has to be looked up. edges: as made by ``_marked``.
    """
    apart = edges.select(F.col("told").alias("node")).union(contexts.select(F.explode("starts"))).union(contexts.select(F.explode("read_nodes")))
    apart = apart.filter("node is not null").distinct()
    single = edges.groupBy(F.col("to_node").alias("node")).agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("node")
    outs = edges.groupBy(F.col("from_node").alias("node")).agg(F.count(F.lit(1)).alias("left"))
    rows = (
        edges.filter("opens")
        .select(F.col("to_node").alias("node"), F.col("from_node").alias("parent"), *_ORDER)
        .join(single, "node", "left_semi")
        .join(_sent(cut(apart)), "node", "left_anti")
        .join(outs, "node", "left")
        .withColumn("left", F.coalesce("left", F.lit(0)))
    )
    rows = stored(rows, "walk-single")
    leaves = rows.filter("left = 0").withColumn("size", F.lit(1).cast("long"))
    open_, done = cut(rows.filter("left > 0").select("node", "parent", "left", F.lit(1).cast("long").alias("size"))), [leaves.select("node", "parent", "size")]
    while len(done) < _TREE_LEVELS:
        push = done[-1].groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("got"))
        open_ = cut(
            open_.join(push, "node", "left").select(
                "node", "parent", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"), (F.col("size") + F.coalesce("got", F.lit(0))).alias("size")
            )
        )
        ready = open_.filter("left = 0").select("node", "parent", "size")
        if ready.isEmpty():
            break
        done.append(ready)
        open_ = open_.filter("left > 0")
    cols = ["node", "parent", *_ORDER, "size"]
    sized = leaves.select(cols)
    if len(done) == 1:
        return sized, sized.limit(0), 1
    inner = stored(reduce(DataFrame.unionByName, done[1:]).select("node", "size"), "walk-sizes")
    sized = sized.unionByName(rows.filter("left > 0").drop("left").join(inner, "node").select(cols))
    below = inner.select(F.col("node").alias("parent"))
    return sized.join(below, "parent", "left_anti").select(cols), sized.join(below, "parent", "left_semi").select(cols), len(done)


def _core_edges(contexts: DataFrame, edges: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that lie between other nodes than those of ``tops`` and come up for some reader if all were open, and the
    nodes (node) that they come from or lead to."""
    near = cut(contexts.select(F.explode("starts").alias("node")).filter("node is not null").distinct())
    seen, found = [near], []
    while True:
        out = edges.join(_sent(near), edges["from_node"] == near["node"], "left_semi")
        found.append(cut(out.join(tops.select(F.col("node").alias("to_node")), "to_node", "left_anti").select(edges.columns)))
        near = found[-1].select(F.col("to_node").alias("node")).filter("node is not null").distinct()
        near = cut(reduce(lambda new, old: new.join(old, "node", "left_anti"), seen, near))
        if near.isEmpty():
            return reduce(DataFrame.unionByName, found), reduce(DataFrame.unionByName, seen)
        seen.append(near)


def conditional_walk(contexts: DataFrame, edges: DataFrame) -> DataFrame:
    """(context_id, pos, node_id): depth-first reading order of each reader.

    A step may depend on everything read before, so a reader is followed by one task. It gets the edges of the part of
    the graph that reader can reach, with all other conditions decided beforehand, without trees that everyone reads in
    one order (see ``_private_trees``): a run of them between two other edges of a node is one step, and their nodes
    are placed by sums of sizes and joined to the readers at the end.
    contexts: (context_id, audience, labels, read_nodes, starts).
    """
    edges = edges.filter("from_node is not null").select("from_node", "to_node", *_ORDER, "condition")
    edges = stored(_marked(edges), "walk-edges")
    tops, inner, levels = _private_trees(contexts, edges)
    core, nodes = _core_edges(contexts, edges.drop("opens", "told"), tops)
    tops = stored(tops.join(_sent(nodes), tops["parent"] == nodes["node"], "left_semi"), "walk-tops")
    # places among the edges of a node: trees before, and how many other edges
    mixed = core.join(tops.select(F.col("parent").alias("from_node")).distinct(), "from_node", "left_semi")
    none, no = F.lit(None).cast("string"), F.lit(0).cast("long")
    kids = (
        tops.withColumn("kind", F.lit(0)).unionByName(inner.withColumn("kind", F.lit(1))).withColumn("condition", none)
        .unionByName(mixed.select(F.col("to_node").alias("node"), F.col("from_node").alias("parent"), *_ORDER, no.alias("size"), F.lit(2).alias("kind"), "condition"))
    )
    order = [F.col(c).asc_nulls_last() for c in (*_ORDER, "node")]
    kids = with_running(kids, ["parent"], order, sums={"off": F.col("size"), "run": (F.col("kind") == 2).cast("long")})
    kids = stored(kids, "walk-places")
    place = kids.filter("kind = 0").select("parent", "run", F.col("off").alias("place"), "node", "size")
    runs = place.groupBy("parent", "run").agg(F.min("place").alias("first"), F.sum("size").alias("size"))
    level = place.select(F.col("parent").alias("top"), "run", "place", "node")
    placed = [level]
    below = kids.filter("kind = 1").select("parent", "off", F.col("node").alias("child"))
    for n in range(1, levels):
        level = level.join(below, level["node"] == below["parent"]).select("top", "run", (F.col("place") + 1 + F.col("off")).alias("place"), F.col("child").alias("node"))
        level = stored(level, "walk-level") if n + 1 < levels else level
        placed.append(level)

    reach = reachable_static(contexts, core)
    cond = trim_ws(F.coalesce("condition", F.lit("")))
    alone = core.join(kids.filter("kind = 2").select(F.col("parent").alias("from_node")).distinct(), "from_node", "left_anti")
    steps = alone.withColumn("run", no).unionByName(
        kids.filter("kind = 2").select(F.col("parent").alias("from_node"), F.col("node").alias("to_node"), *_ORDER, "condition", "run")
    )
    read = F.array().cast("array<string>")
    usable = (
        reach.join(steps, reach["node_id"] == steps["from_node"])
        .join(contexts.select("context_id", "audience", "labels"), "context_id")
        .select(
            F.col("context_id").alias("context_id"),  # a column of its own, apart from the contexts cogrouped below
            "from_node",
            "to_node",
            "run",
            *_ORDER,
            cond.rlike(_HAS_READ).alias("dyn"),
            (F.regexp_extract(cond, _HAS_READ, 1) == "!").alias("neg"),
            trim_ws(F.regexp_extract(cond, _HAS_READ, 2)).alias("need"),
            eval_condition(F.col("condition"), F.col("audience"), read, F.col("labels")).alias("held"),
        )
        .filter(F.col("dyn") | F.col("held"))
        .drop("held")
        .withColumns({"first": no, "size": no})
    )
    usable = usable.unionByName(
        reach.join(runs, reach["node_id"] == runs["parent"]).select(
            F.col("context_id").alias("context_id"), F.col("parent").alias("from_node"), "run", "first", "size"
        ),
        allowMissingColumns=True,
    )

    def walk(key: tuple[Any, ...], ctx: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        if ctx.empty:
            return pd.DataFrame({c: [] for c in ("context_id", "pos", "node_id", "run", "first", "size")})
        # the run of trees that has a number comes before the other edge that has it
        es = es.assign(one=es["size"] == 0).sort_values(["from_node", "run", "one", *_ORDER])
        out_edges = {k: list(g[["to_node", "dyn", "neg", "need", "run", "first", "size"]].itertuples(index=False)) for k, g in es.groupby("from_node")}
        read = set(ctx["read_nodes"].iloc[0] if ctx["read_nodes"].iloc[0] is not None else [])
        seen, met, pos = set(), [], 0
        for start in ctx["starts"].iloc[0]:
            # (node to enter) or (iterator to go on with); conditions are tested when their edge comes up
            stack: list = [(None, iter([(start, False, False, "", 0, 0, 0)]))]
            while stack:
                at, left = stack[-1]
                e = next(left, None)
                if e is None:
                    stack.pop()
                    continue
                to, dyn, neg, need, run, first, size = e
                if size:
                    met.append((pos, at, run, first, size))
                    pos += size
                    continue
                if to in seen or (dyn and ((need in read) == neg)):
                    continue
                seen.add(to)
                read.add(to)
                met.append((pos, to, 0, 0, 0))
                pos += 1
                stack.append((to, iter(out_edges.get(to, []))))
        out = pd.DataFrame(met, columns=["pos", "node_id", "run", "first", "size"])
        out.insert(0, "context_id", key[0])
        return out

    kind = contexts.schema["context_id"].dataType.simpleString()
    walked = cut(
        contexts.select("context_id", "read_nodes", "starts")
        .groupBy("context_id")
        .cogroup(usable.groupBy("context_id"))
        .applyInPandas(walk, f"context_id {kind}, pos long, node_id string, run long, first long, size long")
    )
    pieces = cut(
        walked.filter("size > 0").select(
            "context_id", F.col("node_id").alias("top"), "run", (F.col("pos") - F.col("first")).alias("shift"),
            F.explode(F.expr(f"sequence(first div {_PIECE}, (first + size - 1) div {_PIECE})")).alias("piece"),
        )
    )
    placed = reduce(DataFrame.unionByName, placed).withColumn("piece", F.expr(f"place div {_PIECE}"))
    hung = placed.join(_sent(pieces), ["top", "run", "piece"]).select("context_id", (F.col("shift") + F.col("place")).alias("pos"), F.col("node").alias("node_id"))
    return walked.filter("size = 0").select("context_id", "pos", "node_id").unionByName(hung)


# ---- threads and manuscripts ---------------------------------------------------------------------


def linearize_thread(threads: DataFrame, thread_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(thread_id, pos, node_id, title, body) by position; ``missing`` marks references to no node."""
    mine = thread_nodes.select("thread_id", "node_id", "position").join(threads.select("thread_id"), "thread_id", "left_semi")
    placed = with_ordinal(mine, ["thread_id"], ["position", "node_id"], "pos")
    return placed.join(
        nodes.select("node_id", "title", "body", F.lit(False).alias("here")), "node_id", "left"
    ).select("thread_id", "pos", "node_id", "title", "body", F.coalesce("here", F.lit(True)).alias("missing"))


def collect_spans(ordered: DataFrame, evidence: DataFrame) -> DataFrame:
    """(doc_id, idx, chunk_id, text): the excerpts along an ordered node list.

    ordered: (doc_id, pos, node_id, body). A node's excerpts come by (position, created_at); the same
    chunk span counts once, at its first place; a node without excerpts gives its body once.
    """
    cited = ordered.join(
        evidence.select("node_id", "evidence_id", "chunk_id", "char_start", "char_end", "text", "position", "created_at"), "node_id"
    )
    place = F.struct("pos", "position", "created_at", "evidence_id", "text")
    spans = cited.groupBy("doc_id", "chunk_id", "char_start", "char_end").agg(F.min(place).alias("p"))
    bodies = (
        ordered.filter(F.coalesce("body", F.lit("")) != "")
        .join(evidence.select("node_id").distinct(), "node_id", "left_anti")
        .groupBy("doc_id", "node_id")
        .agg(F.min(F.struct("pos", "body")).alias("p"))
    )
    rows = spans.select(
        "doc_id", "chunk_id", F.col("p.pos").alias("pos"), F.col("p.position").alias("position"),
        F.col("p.created_at").alias("created_at"), F.col("p.evidence_id").alias("evidence_id"), F.col("p.text").alias("text"),
    ).unionByName(
        bodies.select(
            "doc_id", F.col("node_id").alias("chunk_id"), F.col("p.pos").alias("pos"), F.lit(0).alias("position"),
            F.lit(None).cast("timestamp").alias("created_at"), F.lit("").alias("evidence_id"), F.col("p.body").alias("text"),
        )
    )
    out = with_ordinal(rows, ["doc_id"], ["pos", "position", "created_at", "evidence_id"], "idx")
    return out.select("doc_id", "idx", "chunk_id", "text")


GLUE = " ... "


def stitch_spans(spans: DataFrame, glue: str = GLUE) -> DataFrame:
    """(doc_id, ord, type, idx, chunk_id, text, char_start): spans with glue between neighbours.

    Reading ``text`` by ``ord`` gives the document; ``char_start`` is where a piece begins in it.
    """
    pieces = spans.select(
        "doc_id", (F.col("idx") * 2).alias("ord"), F.lit("chunk").alias("type"), "idx", "chunk_id", "text"
    ).unionByName(
        spans.filter("idx > 0").select(
            "doc_id", (F.col("idx") * 2 - 1).alias("ord"), F.lit("glue").alias("type"), F.lit(None).cast("long").alias("idx"),
            F.lit(None).cast("string").alias("chunk_id"), F.lit(glue).alias("text"),
        )
    )
    return with_running(pieces, ["doc_id"], ["ord"], sums={"char_start": F.char_length("text").cast("long")})


def stitch_stats(pieces: DataFrame) -> DataFrame:
    """(doc_id, chunk_chars, glue_chars, total_chars, glue_ratio)."""
    n = F.char_length("text").cast("long")
    return (
        pieces.groupBy("doc_id")
        .agg(
            F.sum(F.when(F.col("type") == "chunk", n).otherwise(0)).alias("chunk_chars"),
            F.sum(F.when(F.col("type") == "glue", n).otherwise(0)).alias("glue_chars"),
        )
        .withColumn("total_chars", F.col("chunk_chars") + F.col("glue_chars"))
        .withColumn("glue_ratio", F.coalesce(F.try_divide("glue_chars", "total_chars"), F.lit(0.0)))
    )


def exits(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_node, to_node, title, type, condition, created_at, edge_id) of the non-linear edges."""
    return edges.filter("type <> 'linear'").join(
        nodes.select(F.col("node_id").alias("to_node"), "title"), "to_node", "left"
    ).select("from_node", "to_node", "title", "type", "condition", "created_at", "edge_id")


def diff_states(current: DataFrame, baseline: DataFrame, base_edges: DataFrame) -> DataFrame:
    """(node_id, status, anchor, weight) of added, changed and removed outline nodes.

    A removed node is anchored at its nearest baseline ancestor that is still there ("" = root), with
    its old sibling weight. All removed nodes climb one ancestor per wave.
    """
    cols = ["node_id", "title", "body", "locked"]
    cur = current.filter("type = 'outline'").select(*cols)
    base = baseline.filter("type = 'outline'").select(*cols)
    c, b = cur.alias("c"), base.alias("b")
    joined = c.join(b, "node_id", "full_outer").select(
        "node_id",
        F.when(F.col("b.locked").isNull(), "added")
        .when(F.col("c.locked").isNull(), "removed")
        .when(
            (F.col("c.title") != F.col("b.title")) | (F.col("c.body") != F.col("b.body")) | (F.col("c.locked") != F.col("b.locked")),
            "changed",
        )
        .alias("status"),
    )
    joined = cut(joined.filter(F.col("status").isNotNull()))
    ids = base.select("node_id")
    parent = (
        base_edges.filter("type = 'linear'")
        .join(ids.withColumnRenamed("node_id", "from_node"), "from_node", "left_semi")
        .join(ids.withColumnRenamed("node_id", "to_node"), "to_node", "left_semi")
        .groupBy(F.col("to_node").alias("node_id"))
        .agg(F.max(F.struct("created_at", "edge_id", "from_node", "weight")).alias("e"))
        .select("node_id", F.col("e.from_node").alias("parent"), F.col("e.weight").alias("weight"))
    )
    alive = cur.select(F.col("node_id").alias("at"), F.lit(True).alias("alive"))
    up = parent.select(F.col("node_id").alias("at"), F.col("parent").alias("above"))
    climb = cut(
        joined.filter("status = 'removed'").join(parent, "node_id", "left").select("node_id", F.col("parent").alias("at"), F.coalesce("weight", F.lit(0)).alias("weight"))
    )
    found = None
    # no path is longer than the outline has parents; a longer climb goes in a circle
    for _ in range(parent.count() + 1):
        here = cut(climb.join(alive, "at", "left").join(up, "at", "left"))
        stop = here.filter("alive or at is null").select("node_id", F.coalesce("at", F.lit("")).alias("anchor"), "weight")
        found = stop if found is None else found.unionByName(stop)
        climb = here.filter("alive is null and at is not null").select("node_id", F.col("above").alias("at"), "weight")
        if climb.isEmpty():
            break
    else:
        raise ValueError("the baseline outline has a cycle")
    none = F.lit(None)
    return (
        joined.filter("status <> 'removed'")
        .select("node_id", "status", none.cast("string").alias("anchor"), none.cast("int").alias("weight"))
        .unionByName(found.select("node_id", F.lit("removed").alias("status"), "anchor", "weight"))
    )


# ---- reports -------------------------------------------------------------------------------------


def _or_untitled(c):
    return F.when(trim_ws(F.coalesce(c, F.lit(""))) == "", F.lit("_(untitled)_")).otherwise(c)


def outline_report(
    project: str, nodes: DataFrame, edges: DataFrame, threads: DataFrame, thread_nodes: DataFrame, branches: DataFrame, updated: str
) -> DataFrame:
    """(project, line_no, line): the outline as Markdown.

    nodes: (node_id, type, title, body, locked, source_file, created_at); branches: (name, active).
    Every line carries its sort key (section, tree path or thread, line inside); numbering is the last step.
    """
    tree = flatten_preorder(build_tree(nodes, edges)).select("node_id", "depth", "pos")
    rows = tree.join(nodes.drop("created_at"), "node_id")
    pad = F.expr("repeat('  ', depth)")
    src = F.coalesce("source_file", F.lit(""))
    quote = F.when(collapse_ws("body") != "", collapse_ws("body")).otherwise(collapse_ws("title"))

    def lines(df: DataFrame, section: int, major, minor, line) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"), major.cast("string").alias("name"), minor.alias("a"), line.alias("line")
        )

    # within a node: title 0, body lines 1, exits 2
    zero = F.lit(0).cast("long")
    blank = F.lit("")

    def sub(part: int, i, extra="") :
        return F.struct(F.col("pos").cast("long").alias("pos"), F.lit(part).alias("part"), i.cast("long").alias("i"), F.lit(extra).alias("x") if isinstance(extra, str) else extra.alias("x"))

    def at(pos: int):
        return F.struct(F.lit(pos).cast("long").alias("pos"), F.lit(0).alias("part"), zero.alias("i"), blank.alias("x"))

    bullet = rows.filter("type = 'outline'")
    quoted = rows.filter("type = 'chunk_ref'")
    body = trim_ws(F.col("body"))
    exit_rows = exits(nodes, edges).join(
        bullet.select(F.col("node_id").alias("from_node"), "depth", "pos"), "from_node"
    )
    label = F.concat(
        F.col("type"), F.lit(": "), _or_untitled(F.col("title")),
        F.when(F.coalesce("condition", F.lit("")) != "", F.concat(F.lit("  (if "), F.col("condition"), F.lit(")"))).otherwise(""),
    )
    one = nodes.sparkSession.range(1)
    stats = outline_stats(nodes, edges)
    out = [
        lines(one, 0, blank, at(0), F.lit(f"# {project or 'outline'}")),
        lines(one, 0, blank, at(1), blank),
        lines(
            stats, 0, blank, at(2),
            F.concat(F.lit(f"_updated {updated} · "), F.col("bullets").cast("string"), F.lit(" bullet(s), "), F.col("with_evidence").cast("string"), F.lit(" with evidence_")),
        ),
        lines(one, 0, blank, at(3), blank),
        lines(tree.agg(F.count(F.lit(1)).alias("n")).filter("n = 0"), 0, blank, at(4), F.lit("_(empty outline)_")),
        lines(
            bullet, 1, blank, sub(0, zero),
            F.concat(
                pad, F.lit("- "), F.when(trim_ws("title") == "", "_(untitled)_").otherwise(trim_ws("title")),
                F.when(F.col("locked"), "  `[locked]`").otherwise(""),
            ),
        ),
        lines(
            quoted, 1, blank, sub(0, zero),
            F.concat(pad, F.lit("> "), quote, F.when(src != "", F.concat(F.lit(" — _"), src, F.lit("_"))).otherwise("")),
        ),
        lines(
            bullet.filter(body != "").select("pos", "depth", F.posexplode(F.split(body, "\n")).alias("i", "l")), 1, blank,
            sub(1, F.col("i")), F.concat(pad, F.lit("  "), F.col("l")),
        ),
        lines(
            exit_rows, 1, blank, sub(2, F.unix_micros("created_at"), F.col("edge_id")), F.concat(pad, F.lit("  → "), label)
        ),
    ]
    t = threads.withColumn("nm", F.when(trim_ws("name") == "", "(unnamed thread)").otherwise(F.col("name")))
    key = F.concat_ws("\x00", "name", "thread_id")
    total = tree.agg(F.count(F.lit(1)).alias("total"))
    per = thread_nodes.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"))
    placed = with_ordinal(thread_nodes, ["thread_id"], ["position", "node_id"], "i", start=1)
    some_t = t.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    some_b = branches.agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    out += [
        lines(some_t, 2, blank, at(0), blank),
        lines(some_t, 2, blank, at(1), F.lit("## Threads")),
        lines(t, 3, key, at(0), blank),
        lines(
            t.join(per, "thread_id", "left").crossJoin(total), 3, key, at(1),
            F.concat(F.lit("### "), F.col("nm"), F.lit("  ("), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" bullets)")),
        ),
        lines(
            placed.join(t, "thread_id").join(nodes.select("node_id", "title"), "node_id", "left").withColumn("pos", F.lit(2)), 3, key,
            sub(0, F.col("i")), F.concat(F.col("i").cast("string"), F.lit(". "), _or_untitled(F.col("title"))),
        ),
        lines(some_b, 4, blank, at(0), blank),
        lines(some_b, 4, blank, at(1), F.lit("## Branches")),
        lines(some_b, 4, blank, at(2), blank),
        lines(branches, 5, F.col("name"), at(0), F.concat(F.lit("- **"), F.col("name"), F.lit("**"), F.when(F.col("active"), " _(active)_").otherwise(""))),
    ]
    rows_ = out[0]
    for o in out[1:]:
        rows_ = rows_.unionByName(o)
    numbered = with_ordinal(rows_, [], ["section", "name", "a", "line"], "line_no")
    return numbered.select(F.lit(project).alias("project"), "line_no", "line")


def stitched_manuscript(
    titles: DataFrame, ordered: DataFrame, evidence: DataFrame, ways: DataFrame, stitch: Callable[[DataFrame, int], DataFrame] | None = None, glue_level: int = 0
) -> DataFrame:
    """``manuscript_report`` of the spans along an ordered node list, put together by any ``stitch``.

    The stitcher gets the spans (doc_id, idx, chunk_id, text) and a glue level of 0 to 100 and gives pieces as
    ``stitch_spans`` does, which is the default.
    """
    spans = collect_spans(ordered, evidence)
    pieces = stitch(spans, glue_level) if stitch else stitch_spans(spans)
    return manuscript_report(titles, ordered, pieces, ways)


def manuscript_report(titles: DataFrame, ordered: DataFrame, pieces: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, piece_no, text): pieces whose concatenation in order is the Markdown document.

    titles: (doc_id, title); ordered: (doc_id, pos, node_id, title); pieces: from ``stitch_spans``.
    """

    def part(df: DataFrame, section: int, a, b, text) -> DataFrame:
        return df.select("doc_id", F.lit(section).alias("section"), a.cast("long").alias("a"), b.cast("string").alias("b"), text.alias("text"))

    zero, blank = F.lit(0), F.lit("")
    out = part(
        titles.filter(F.coalesce("title", F.lit("")) != ""), 0, zero, blank, F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"))
    )
    heading = F.when(F.coalesce("title", F.lit("")) == "", F.concat(F.lit("Section "), (F.col("pos") + 1).cast("string"))).otherwise(F.col("title"))
    out = out.unionByName(
        part(ordered, 1, F.col("pos"), blank, F.concat(F.lit('<a id="'), slugify("node_id"), F.lit('"></a>\n\n## '), heading, F.lit("\n\n")))
    )
    has = pieces.select("doc_id").distinct()
    text = F.when(F.col("type") == "glue", F.concat(F.lit("*"), trim_ws("text"), F.lit("* "))).otherwise(F.col("text"))
    out = out.unionByName(part(has, 2, zero, blank, F.lit("---\n\n"))).unionByName(part(pieces, 3, F.col("ord"), blank, text))
    out = out.unionByName(part(has, 4, zero, blank, F.lit("\n\n")))
    inside = ordered.select("doc_id", F.col("node_id").alias("to_node"), F.col("title").alias("t_title")).dropDuplicates(["doc_id", "to_node"])
    ways = (
        ordered.join(edges.filter(F.col("type").isin("branch", "jump")).drop("weight"), F.col("node_id") == F.col("from_node"))
        .join(inside, ["doc_id", "to_node"], "left")
    )
    label = F.concat(
        F.when(F.col("type") == "branch", "→ ").otherwise(""),
        F.when(F.coalesce("t_title", F.lit("")) == "", F.col("to_node")).otherwise(F.col("t_title")),
        F.when(F.coalesce("condition", F.lit("")) != "", F.concat(F.lit(" *(if "), F.col("condition"), F.lit(")*"))).otherwise(""),
    )
    order = F.concat(F.lit("1"), F.lpad(F.unix_micros("created_at").cast("string"), 20, "0"), F.col("edge_id"))
    heads = ways.select("doc_id", "pos", "title").distinct()
    out = (
        out.unionByName(part(ways.select("doc_id").distinct(), 5, zero, blank, F.lit("---\n\n### Navigation\n\n")))
        .unionByName(part(heads, 6, F.col("pos"), F.lit("0"), F.concat(F.lit("**From "), F.col("title"), F.lit(":**\n\n"))))
        .unionByName(part(ways, 6, F.col("pos"), order, F.concat(F.lit("- ["), label, F.lit("](#"), slugify("to_node"), F.lit(")\n"))))
        .unionByName(part(heads, 6, F.col("pos"), F.lit("2"), F.lit("\n")))
    )
    return with_ordinal(out, ["doc_id"], ["section", "a", "b", "text"], "piece_no").select("doc_id", "piece_no", "text")
