"""Hard negatives, n-gram joins and whitening against brute force, with nulls, empties, ties and repeated rows."""

import itertools
import math
import random

import numpy as np
import pytest

from spanlake.llm import cover_tree, ngram_join, queries, whitening
from spanlake.llm.vectors import integer_rows, unpacked
from tests.llm.test_operators import clash, frame, words

VECS = "vec_id long, label int, embedding array<float>"
ODD = [(None, 1, [0.5, 0.5, 0.5, 0.5]), (9001, None, [1.0] * 4), (9002, 2, None), (9003, 2, [1.0, None, 1.0, 1.0]), (9004, 2, [1.0, float("nan"), 1.0, 1.0]), (9005, 2, [float("inf")] * 4), (9006, 2, []), (9007, 2, [1.0])]


def vectors(seed=0, n=400, dim=4, labels=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[n // 3 : 2 * n // 3] = x[0]  # a third of all rows are one vector
    return [(i, int(rng.integers(labels)), row.tolist()) for i, row in enumerate(x)]


# 11 hard negatives


def brute_negatives(rows):
    v = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, np.floor(256 * np.array(x, float)).astype(np.int64)) for i, lab, x in rows]
    out = set()
    for i, lab, x in v:
        if i % 100:
            continue
        scored = sorted(((-int(x @ y), j, m) for j, m, y in v if j != i))
        for s, j, _ in [t for t in scored if t[2] == lab][:5]:
            window = [t for t in scored if t[2] != lab and 80 * -s <= 100 * -t[0] <= 100 * -s][:5]
            out |= {(i, j, r, t[1], -s, -t[0]) for r, t in enumerate(window, 1)}
    return out


@pytest.mark.parametrize("seed, block", [(0, 64), (1, 1024)])
def test_negatives_are_those_of_brute_force(spark, seed, block):
    rows = vectors(seed)
    df = spark.createDataFrame([*rows, *ODD, rows[3], rows[200]], VECS).repartition(3)
    got = cover_tree.hard_negatives(clash(df.select("*")), block=block).collect()
    want = brute_negatives(rows)
    assert len(got) == len(want) > 5
    assert {tuple(r) for r in got} == want


def test_negatives_of_empty_and_one_label(spark):
    assert cover_tree.hard_negatives(spark.createDataFrame([], VECS)).count() == 0
    assert cover_tree.hard_negatives(spark.createDataFrame(ODD, VECS)).count() == 0
    one = [(i, 1, [float(i), 1.0]) for i in range(1, 60) if i % 7] + [(100, 1, [1.0, 1.0])]
    assert cover_tree.hard_negatives(spark.createDataFrame(one, VECS)).count() == 0


def test_tree_covers_and_bounds():
    rng = np.random.default_rng(5)
    for dim, copies in ((3, 0), (24, 0), (3, 300)):
        x = np.floor(256 * rng.standard_normal((700, dim))).astype(np.int64)
        x[: copies + 1] = x[0]
        square = float(np.ceil((x * x).sum(axis=1)).max())
        labels = rng.integers(0, 4, 700)
        tree = cover_tree.Tree.from_bytes(cover_tree.Tree(np.arange(700) * 3, labels, x, square).to_bytes())
        assert sorted(tree.ids.tolist()) == list(range(0, 2100, 3))
        leaf = tree.children[:, 1] == 0
        assert sorted(i for lo, hi in tree.rows[leaf] for i in range(lo, hi)) == list(range(700))
        points = cover_tree.augmented(tree.x, square)

        def below(node):
            first, end = tree.children[node]
            return [i for c in range(first, end) for i in below(c)] if end else list(range(*tree.rows[node]))

        for node in range(len(tree.radius)):
            inside = below(node)
            gap = np.sqrt(((points[inside] - points[tree.centre[node]]) ** 2).sum(axis=1))
            assert gap.max() <= tree.radius[node] + 1e-3
        q = np.floor(300 * rng.standard_normal((5, dim))).astype(np.int64)
        low, high = np.full(5, -(1 << 60)), np.array([1 << 60, 5000, 0, -5000, 1 << 60])
        who, ids, score = tree.best(np.full(5, -1), q, np.arange(5) % 4, low, high, 7, False)
        for i in range(5):
            s = x @ q[i]
            want = sorted((-int(s[j]), 3 * j) for j in range(700) if labels[j] != i % 4 and s[j] <= high[i])[:7]
            assert sorted(zip((-score[who == i]).tolist(), ids[who == i].tolist())) == want


def test_search_skips_what_windows_leave_out():
    """Clustered vectors: most leaves are never read."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (60, 16)) + 400 * np.eye(16)[i % 16] for i in range(16)]).astype(np.int64)
    tree = cover_tree.Tree(np.arange(len(x)), np.zeros(len(x), int), x, float((x * x).sum(axis=1).max()))
    q = x[:1]
    q_square = (q.astype(float) ** 2).sum(axis=1)
    who, leaf, _ = tree.leaves(q, q_square, np.ones(1), np.array([80_000]), np.array([1 << 60]), False)
    assert 0 < (tree.rows[leaf][:, 1] - tree.rows[leaf][:, 0]).sum() <= 120 < len(x)


def test_large_components_are_held(spark):
    rows = [(i, i % 2, [3e38, -3e38 if i % 3 else 1.0]) for i in range(0, 300, 10)]
    assert cover_tree.hard_negatives(spark.createDataFrame(rows, VECS)).count() > 0


# 12 n-gram join


def brute_components(rows):
    sets = {}
    for d, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()  # the texts below have no other blanks
        sets[d] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        u, v = sets[a], sets[b]
        if u and v and 100 * len(u & v) >= 85 * len(u | v):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def copies(seed):
    """Chains of edits, a large class, texts that share a passage only, and texts around the threshold."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    rows, base = [], words(rng, 90)
    for i in range(120):
        kind = i % 6
        if kind == 0:
            w = words(rng, rng.choice([1, 2, 3, 4, 40]))
        elif kind == 1:
            w = passage + words(rng, rng.randrange(12))
        elif kind == 2:  # a chain: each step is near the one before
            base = [*base]
            base[rng.randrange(len(base))] = f"edit{i}"
            w = base
        elif kind == 3:
            w = [*passage, *passage, *words(rng, rng.randrange(8))]
        elif kind == 4:
            w = (rows[rng.randrange(len(rows))][1] or "x").upper().split()
        else:
            w = words(rng, 50, 30)
        rows.append((i * 2 + 1, " ".join(w)))
    return [*rows, (500, None), (501, ""), (502, " \t\n"), (503, "É É É É É"), (504, "é é é é é")]


@pytest.mark.parametrize("seed", range(3))
def test_components_are_those_of_brute_force(spark, seed):
    rows = copies(seed)
    df = clash(frame(spark, [*rows, rows[7], rows[8]]).repartition(5))
    got = ngram_join.linked_documents(df).collect()
    assert len(got) == len(rows) + 2
    want = brute_components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < 0.8 * len(rows)


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_other_thresholds_and_small_tries(spark, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "TRIE", 2)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    rows = copies(9)[:70]
    got = {r.doc_id: r.component_id for r in ngram_join.linked_documents(frame(spark, rows), percent=percent).collect()}
    sets = {d: {tuple(t.lower().split()[i : i + 4]) for i in range(max(1, len(t.split()) - 3))} for d, t in rows}
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            assert got[a] == got[b]
    if percent == 100:
        assert all(sets[d] == sets[c] for d, c in got.items())


def test_odd_tables_of_the_join(spark):
    assert ngram_join.linked_documents(frame(spark, [])).count() == 0
    text, long = "a b c d e f g", " ".join(f"w{i % 40_000}" for i in range(200_000))
    rows = [(5, text), (5, long), (9, text.upper()), (2, long + " end"), (None, text), (None, None), (7, None)]
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in ngram_join.linked_documents(frame(spark, rows)).collect()))
    # id 5 has both texts and so ties 9 and 2 together
    assert got == [(0, 0, None), (0, 4, None), (2, 40_001, 2), (5, 4, 2), (5, 40_000, 2), (7, 0, 7), (9, 4, 2)]


def test_walk_of_a_trie():
    rng = random.Random(4)
    for _ in range(60):
        order = list(range(rng.randrange(20, 80)))
        own = sorted(rng.sample(order, rng.randrange(8, 20)))
        n = len(own) + rng.randrange(3)
        others = sorted(sorted(set(own) - set(rng.sample(own, rng.randrange(5))) | set(rng.sample(order, rng.randrange(4)))) for _ in range(30))
        walk = ngram_join.Walk(np.array(own), n, 85)
        for o in others:
            m = len(o) + rng.randrange(2)
            need = math.ceil(85 * (n + m) / 185 - 1e-9)
            assert walk.linked(np.array(o), m) == (len(set(own) & set(o)) >= need and 100 * min(n, m) >= 85 * max(n, m) or len(set(own) & set(o)) >= need)


# 13 whitening


@pytest.mark.parametrize("dim", [1, 2, 3, 20, 64])
def test_components_are_those_of_numpy(dim):
    rng = np.random.default_rng(dim)
    for a in (rng.standard_normal((dim, dim)), np.eye(dim), np.diag([1.0, *[5.0] * (dim - 1)]), np.zeros((dim, dim)), np.ones((dim, dim))):
        m = a @ a.T if a.any() else a
        values, rows = whitening.leading_components(m, min(dim, 16))
        want = np.linalg.eigvalsh(m)[::-1][: len(values)]
        scale = max(1.0, abs(want).max())
        assert np.allclose(values, want, atol=1e-12 * scale)
        assert np.allclose(rows @ rows.T, np.eye(len(rows)), atol=1e-10)
        assert np.allclose(m @ rows.T, rows.T * values, atol=1e-10 * scale)


def test_clusters_stay_orthogonal():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    values = np.array([9.0] * 5 + [9.0 - 1e-13, 9.0 - 1e-9, 3.0, 3.0, 2.9999] + [1.0] * 30)
    m = (q * values) @ q.T
    m = (m + m.T) / 2
    got, rows = whitening.leading_components(m, 16)
    assert np.allclose(got, values[:16], atol=1e-11)
    assert np.allclose(rows @ rows.T, np.eye(16), atol=1e-11)
    assert np.allclose(m @ rows.T, rows.T * got, atol=1e-11)


def brute_whitened(rows):
    x = {i: np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for i, _, v in rows}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    y = (n * fit - sums) / n
    cov = y.T @ y / n
    values, parts = np.linalg.eigh(cov)
    values, parts = values[::-1][:16], parts[:, ::-1][:, :16]
    dev = {i: sum(int(d) ** 2 for d in n * v.astype(object) - sums.astype(object)) for i, v in x.items()}
    return n, values / np.trace(cov), {i: (n * v - sums) / n @ parts / np.sqrt(values) for i, v in x.items()}, dev


def test_whitening_is_that_of_numpy(spark):
    rows = vectors(3, 300, 20)
    df = spark.createDataFrame([*rows, *ODD, (None, 1, rows[5][2]), (4, 1, rows[4][2])], VECS).repartition(4)
    got = whitening.whitened(clash(df)).collect()
    assert len(got) == 16 * 302
    n, shares, white, dev = brute_whitened(rows)
    white[None], dev[None] = white[5], dev[5]
    assert {r.n for r in got} == {n} == {200}
    sign = {}
    for r in got:
        want = white[r.vec_id][r.component - 1]
        assert abs(abs(r.whitened) - abs(want)) < 1e-8
        if abs(want) > 1e-3:
            assert sign.setdefault(r.component, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(r.explained - shares[r.component - 1]) < 1e-10
        assert r.deviation == dev[r.vec_id] and r.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whitening.whitened(spark.createDataFrame([], VECS)).count() == 0
    assert whitening.whitened(spark.createDataFrame(ODD[1:2] * 3, VECS)).count() == 0  # one vector: no variance
    flat = [(i, 0, [float(i), 2.0, -float(i)]) for i in range(8)]  # variance in one direction only
    got = whitening.whitened(spark.createDataFrame(flat, VECS)).collect()
    assert sorted(r.vec_id for r in got) == list(range(8))
    assert all(r.component == 1 and abs(r.explained - 1) < 1e-12 for r in got)
    big = [(i, 0, [3e7 * (i % 5), -3e38 if i % 2 else 3e38]) for i in range(40)]
    got = whitening.whitened(spark.createDataFrame(big, VECS)).collect()
    assert len(got) == 80 and all(r.deviation is not None for r in got)


def test_integer_rows_take_the_commonest_length(spark):
    rows, dim = integer_rows(spark.createDataFrame(vectors(1, 30, 4) + ODD, VECS), "embedding", {"vec_id": "long"}, 64, 7)
    x = unpacked(rows.toArrow().column("x"))
    assert dim == 4 and x.shape == (32, 4)  # two odd ones have whole vectors
    assert queries.QUERIES["op13_whitening"]
