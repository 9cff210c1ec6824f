import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from spanlake.operators import changes as ch, outline as ol

NODE = "node_id string, type string, title string, body string, locked boolean, t long"
EDGE = "edge_id string, from_node string, to_node string, type string, condition string, weight int, t long"


def nodes(spark, rows):
    return spark.createDataFrame(rows, NODE).withColumn("created_at", F.timestamp_seconds("t")).drop("t")


def edges(spark, rows):
    return spark.createDataFrame(rows, EDGE).withColumn("created_at", F.timestamp_seconds("t")).drop("t")


def n(i, typ="outline", t=0, title="", body=""):
    return (i, typ, title, body, False, t)


def e(a, b, typ="linear", cond=None, w=0, t=0):
    return (f"{a}>{b}", a, b, typ, cond, w, t)


def kahn(ns, es):
    deg = {x[0]: 0 for x in ns}
    adj = {}
    for x in sorted(es, key=lambda x: (x[6], x[0])):
        deg[x[2]] += 1
        adj.setdefault(x[1], []).append(x[2])
    q = deque(x[0] for x in sorted(ns, key=lambda x: (x[5], x[0])) if deg[x[0]] == 0)
    out = []
    while q:
        x = q.popleft()
        out.append(x)
        for c in adj.get(x, []):
            deg[c] -= 1
            if deg[c] == 0:
                q.append(c)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_topological_order_equals_queue(spark, seed):
    rnd = random.Random(seed)
    ns = [n(f"n{i:02d}", t=rnd.randint(0, 5)) for i in range(25)]
    es = [e(f"n{a:02d}", f"n{b:02d}", t=rnd.randint(0, 3)) for a in range(25) for b in range(a + 1, 25) if rnd.random() < 0.1]
    got = [r.node_id for r in ol.topological_sort(nodes(spark, ns), edges(spark, es)).orderBy("pos").collect()]
    assert got == kahn(ns, es)
    with pytest.raises(ValueError, match="cycle"):
        ol.topological_sort(nodes(spark, ns), edges(spark, es + [e("n24", "n24")]))


def test_tree_order_and_roots(spark):
    ns = [n("a", t=2), n("b", t=1), n("c", t=5), n("d", t=4), n("q", "chunk_ref"), n("s", "synth"), n("o", "chunk_ref")]
    es = [e("a", "c", w=1), e("a", "d", w=1), e("a", "q", w=0), e("a", "s"), e("b", "c", "branch"), e("b", "d")]
    flat = ol.flatten_preorder(ol.build_tree(nodes(spark, ns), edges(spark, es))).orderBy("pos").collect()
    assert [(r.node_id, r.depth) for r in flat] == [("b", 0), ("d", 1), ("a", 0), ("q", 1), ("d", 1), ("c", 1)]


@pytest.mark.parametrize("direction", ["up", "down"])
def test_would_create_cycle(spark, direction):
    es = edges(spark, [e("a", "b"), e("b", "c", "jump")])
    cand = spark.createDataFrame([("c", "a"), ("a", "c"), ("x", "x"), ("b", "a")], "from_node string, to_node string")
    got = {(r.from_node, r.to_node): r.cycle for r in ol.would_create_cycle(cand, es, direction).collect()}
    assert got == {("c", "a"): True, ("a", "c"): False, ("x", "x"): True, ("b", "a"): True}


def test_cycle_search_grows_with_edges_not_with_pairs(spark, monkeypatch):
    """Many tops and many ends around one hub, with more nodes above and below that no candidate asks for."""
    tops, ends = [f"s{i}" for i in range(60)], [f"c{i}" for i in range(60)]
    es = [e(t, "n") for t in tops] + [e("n", c) for c in ends] + [e(c, "o" + c) for c in ends] + [e("p" + t, t) for t in tops]
    cand = [(c, t) for c, t in zip(ends, tops)] + [("c0", "m"), ("n", "c1"), (None, "s1")]
    rows = []
    monkeypatch.setattr(ol, "cut", lambda df, real=ol.cut: (rows.append(df.count()), real(df))[1])
    for direction in ("up", "down"):
        got = ol.would_create_cycle(spark.createDataFrame(cand, "from_node string, to_node string"), edges(spark, es), direction).collect()
        assert sorted(r.cycle for r in got) == [False] * 3 + [True] * 60
    assert max(rows) <= len(es) + 10  # not 60 * 60 pairs
    ring = edges(spark, [e("a", "b"), e("b", "c"), e("c", "a"), e("c", "d")])
    pairs = spark.createDataFrame([("d", "a"), ("a", "d"), ("b", "a"), ("a", "b")], "from_node string, to_node string")
    assert {(r.from_node, r.to_node): r.cycle for r in ol.would_create_cycle(pairs, ring).collect()} == {
        ("d", "a"): True, ("a", "d"): False, ("b", "a"): True, ("a", "b"): True
    }


def test_reach_makes_edges_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(condition):
        made.add(1)
        return condition

    chain = [e("a", "b", cond=" audience==expert "), e("b", "c", cond="!has_read(a)"), e("c", "d", cond="  "), e("d", "e", cond="audience!=expert")]
    es = edges(spark, chain).withColumn("condition", counted("condition"))
    ctx = spark.createDataFrame(
        [("x", "Expert", {}, ["a"]), ("y", "novice", {}, ["a", "c"]), ("z", None, None, None)],
        "context_id string, audience string, labels map<string,string>, starts array<string>",
    )
    got = {c: sorted(r.node_id for r in ol.reachable_static(ctx, es).collect() if r.context_id == c) for c in "xyz"}
    assert got == {"x": list("abcd"), "y": list("acde"), "z": []}
    assert made.value <= 2 * 2 * len(chain)  # one pass a job that calls it, twice written; not one for every wave


def test_conditional_walk(spark):
    es = edges(
        spark,
        [e("a", "b", cond="audience==expert", w=0), e("a", "c", w=1), e("c", "d", cond="has_read(b)"), e("a", "d", cond="!has_read(c)", w=2), e("c", "a"), e("d", "e")],
    )
    ctx = spark.createDataFrame(
        [("x", "Expert", {}, [], ["a"]), ("y", "novice", {}, [], ["a", "e"]), ("z", "", {}, ["b"], ["c"])],
        "context_id string, audience string, labels map<string,string>, read_nodes array<string>, starts array<string>",
    )
    rows = ol.conditional_walk(ctx, es).collect()
    got = {c: [r.node_id for r in sorted((r for r in rows if r.context_id == c), key=lambda r: r.pos)] for c in "xyz"}
    assert got == {"x": list("abcde"), "y": list("ace"), "z": list("cade")}


def _walked(ctx, es):
    """The walk of every reader by plain recursion."""
    out = {}
    for key, audience, read, starts in ctx:
        read, seen, order = set(read), set(), []

        def enter(x):
            seen.add(x)
            read.add(x)
            order.append(x)
            for _, _, to, _, cond, _, _ in sorted((y for y in es if y[1] == x), key=lambda y: (y[5] is None, y[5], y[6], y[0])):
                need = (cond or "").strip().removeprefix("!").removeprefix("has_read(").removesuffix(")").strip()
                if (cond or "").startswith("audience=="):
                    holds = cond.removeprefix("audience==") == audience
                else:
                    holds = not (cond or "").strip() or (need in read) != cond.strip().startswith("!")
                if holds and to not in seen:
                    enter(to)

        for x in starts:
            if x not in seen:
                enter(x)
        out[key] = order
    return out


def test_conditional_walk_puts_trees_in_place(spark, monkeypatch):
    """Trees hang between other edges of a node; readers share them, but those with a door of their own are walked."""
    rnd = random.Random(5)
    core = [f"k{i}" for i in range(4)]
    es = [e(a, b, w=rnd.randrange(9), cond=rnd.choice([None, "audience==x", "!has_read(k3)", "has_read(t5)", f"has_read({a})"])) for a in core for b in core if a != b and rnd.random() < 0.5]
    for i in range(36):  # the tree nodes: three levels and some that are no trees after all
        up = rnd.choice(core) if i < 20 else f"t{rnd.randrange(i)}"
        cond = rnd.choice([None, None, "  ", f"!has_read(t{i})", f"has_read( {up} )", f"has_read({up})"]) if i % 11 else rnd.choice(["has_read(k2)", "audience==y"])
        es.append(e(up, f"t{i}", w=rnd.choice([0, 1, 2, 3, None]), cond=cond, t=i % 2))
    es += [e("t7", "k1"), e("k1", "t30", w=4), e("t9", None), e(None, "t3"), es[0]]
    ctx = [("x", "x", ["t25"], ["k0", "t12", "k1"]), ("y", "y", [], ["k3"]), ("z", "", ["k3", "t1"], ["t2", "nowhere", "k2"])]
    rows = [(k, a, {}, r, s) for k, a, r, s in ctx]
    frame = spark.createDataFrame(rows, "context_id string, audience string, labels map<string,string>, read_nodes array<string>, starts array<string>")
    walked, real = [], ol.reachable_static
    monkeypatch.setattr(ol, "reachable_static", lambda c, x: walked.append(x.count()) or real(c, x))
    monkeypatch.setattr(ol, "_PIECE", 3)
    got = {c: [] for c, *_ in ctx}
    for r in sorted(ol.conditional_walk(frame, edges(spark, es)).collect(), key=lambda r: r.pos):
        assert r.pos == len(got[r.context_id])
        got[r.context_id].append(r.node_id)
    assert got == _walked(ctx, [x for x in es if x[1] is not None])
    assert walked[0] < len(es) - 12  # most trees don't go through one task


def test_spans_dedupe_and_body(spark):
    ordered = spark.createDataFrame([("t", 0, "a", "body a"), ("t", 1, "b", "body b"), ("t", 2, "c", ""), ("t", 3, "b", "body b")], "doc_id string, pos long, node_id string, body string")
    ev = spark.createDataFrame([("e1", "a", "k", 0, 3, "abc", 1), ("e2", "a", "k", 5, 6, "f", 0), ("e3", "c", "k", 0, 3, "abc", 0)], "evidence_id string, node_id string, chunk_id string, char_start int, char_end int, text string, position int").withColumn("created_at", F.current_timestamp())
    pieces = ol.stitch_spans(ol.collect_spans(ordered, ev)).orderBy("ord").collect()
    assert "".join(p.text for p in pieces) == "f ... abc ... body b"
    at = 0
    for p in pieces:
        assert p.char_start == at
        at += len(p.text)


def test_diff(spark):
    base = [n("r"), n("a"), n("b"), n("c", title="old")]
    cur = [n("r"), n("c", title="new"), n("new")]
    be = edges(spark, [e("r", "a", w=3), e("a", "b", w=7)])
    got = {r.node_id: (r.status, r.anchor, r.weight) for r in ol.diff_states(nodes(spark, cur), nodes(spark, base), be).collect()}
    assert got == {"a": ("removed", "r", 3), "b": ("removed", "r", 7), "c": ("changed", None, None), "new": ("added", None, None)}


def test_quotes_and_audit(spark):
    chunks = spark.createDataFrame([("k", "s", "alpha beta  gamma", None), ("old", "s", "x", 1)], "chunk_id string, source_file string, content string, d int").withColumn("deleted_at", F.timestamp_seconds("d"))
    q = spark.createDataFrame([("1", "n", "k", 0, 0, "beta gamma"), ("2", "n", "k", 0, 0, "lost"), ("3", "n", "k", 1, 4, "own words"), ("4", "n", "k", 0, 3, " ")], "quote_id string, node_id string, chunk_id string, char_start int, char_end int, text string")
    got = {r.quote_id: (r.char_start, r.char_end, r.text) for r in ch.align_quotes(q, chunks).collect()}
    assert got["1"] == (6, 17, "beta  gamma") and got["2"] == (0, 17, "alpha beta  gamma")
    assert got["3"] == (1, 4, "own words") and got["4"] == (0, 3, " ")
    ev = spark.createDataFrame(
        [("ok", "k", 0, 5, "alpha", False), ("drift", "k", 0, 5, "Alpha", False), ("edited", "k", 0, 5, "Alpha", True),
         ("ok2", "k", 0, 99, "alpha beta  gamma", False), ("drift2", "k", 0, 99, "alpha", False), ("superseded", "old", 0, 1, "x", False), ("unresolved", "zz", 0, 1, "x", False)],
        "evidence_id string, chunk_id string, char_start int, char_end int, text string, edited boolean",
    )
    verdicts = {r.evidence_id: r.verdict for r in ch.audit_evidence(ev, chunks).collect()}
    assert all(k.rstrip("2") == v for k, v in verdicts.items())


def test_state_round_trip(spark):
    state = {"nodes": nodes(spark, [n("a", title="ü\n\"q\""), n("b")]), "edges": edges(spark, [e("a", "b", cond="x")])}
    lines = ch.export_state(state)
    back = ch.import_state(lines, {k: v.schema for k, v in state.items()})
    for k in state:
        assert sorted(map(str, back[k].collect())) == sorted(map(str, state[k].collect()))
