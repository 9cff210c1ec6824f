"""Several changes of one key, version chains and repeated upserts."""

import random

from spanlake.operators import changes as ch
from spanlake.operators import digest as dg

TABLE = "k int, title string, body string"
CHANGES = "op string, seq int, k int, title string, body string"


def in_order(table, changes):
    """The changes one after another."""
    state, lost = {k: [t, b] for k, t, b in table}, []
    for op, _, k, t, b in sorted(changes, key=lambda c: c[1]):
        if op != "insert" and k not in state:
            lost.append((k, op))
        elif op == "delete":
            del state[k]
        else:
            old = state.get(k, [None, None])
            state[k] = [t if t is not None else old[0], b if b is not None else old[1]]
    return sorted((k, *v) for k, v in state.items()), sorted(lost)


def applied(spark, table, changes):
    out, lost = ch.apply_changes(spark.createDataFrame(table, TABLE), spark.createDataFrame(changes, CHANGES), "k")
    return sorted((tuple(r) for r in out.collect()), key=lambda r: r[0]), sorted((r.k, r.op) for r in lost.collect())


def test_changes_of_one_key_in_order(spark):
    table = [(1, "t1", "b1"), (2, "t2", "b2"), (3, "t3", "b3")]
    changes = [
        ("update", 1, 1, "new", None), ("update", 2, 1, None, "body"),
        ("insert", 3, 9, "nine", None), ("update", 4, 9, None, "more"),
        ("delete", 5, 2, None, None), ("update", 6, 2, "lost", None), ("insert", 7, 2, "back", None),
        ("delete", 8, 3, None, None), ("delete", 9, 3, None, None), ("update", 10, 8, "x", "y"),
    ]
    got = applied(spark, table, changes)
    assert got == ([(1, "new", "body"), (2, "back", None), (9, "nine", "more")], [(2, "update"), (3, "delete"), (8, "update")])
    assert got == in_order(table, changes)


def test_random_changes(spark):
    rng = random.Random(3)
    table = [(k, f"t{k}", f"b{k}") for k in range(8)]
    changes = [
        (rng.choice(["insert", "update", "update", "delete"]), i, 0 if rng.random() < 0.4 else rng.randrange(12), rng.choice([None, f"t{i}"]), rng.choice([None, f"b{i}"]))
        for i in range(200)
    ]
    assert applied(spark, table, changes) == in_order(table, changes)


def test_version_chain_in_one_batch(spark):
    nodes = spark.createDataFrame([("n", "t", "b", False, 1), ("m", "t", "b", False, 4)], "node_id string, title string, body string, locked boolean, version int")
    edits = [
        ("n", 1, 1, "one", None, None), ("n", 2, 2, None, "two", None), ("n", 1, 3, "late", None, None), ("n", 3, 4, "three", None, True),
        ("m", 3, 5, "old", None, None), ("m", 5, 6, "early", None, None), ("m", 4, 7, "ok", None, None), ("x", 1, 8, "?", None, None),
    ]
    df = spark.createDataFrame(edits, "node_id string, version int, seq int, title string, body string, locked boolean")
    out, bad = ch.versioned_upsert(nodes, df)
    assert {r.node_id: tuple(r)[1:] for r in out.collect()} == {"n": ("three", "two", True, 4), "m": ("ok", "b", False, 5)}
    assert sorted((r.seq, r.reason) for r in bad.collect()) == [(3, "conflict"), (5, "conflict"), (6, "conflict"), (8, "not_found")]


def test_latest_row_wins(spark):
    meta = spark.createDataFrame([("a", "0"), ("b", "0")], "key string, value string")
    rows = spark.createDataFrame([("a", "9", 1), ("a", "1", 2), ("c", "x", 1)], "key string, value string, seq int")
    assert sorted(tuple(r) for r in ch.meta_upsert(meta, rows).collect()) == [("a", "1"), ("b", "0"), ("c", "x")]
    labels = spark.createDataFrame([("1", "old", "head")], "chunk_id string, label string, source string")
    new = spark.createDataFrame([("1", "z", "head", 1), ("1", "a", "llm:m", 2), ("", "e", "head", 3)], "chunk_id string, label string, source string, seq int")
    assert [tuple(r) for r in dg.upsert_labels(labels, new).collect()] == [("1", "a", "llm:m")]
