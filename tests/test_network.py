import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanlake.operators import cluster as cl, digest as dg, keywords as kw, network as nw


def blobs(spark, groups, per, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim)) * 4
    rows = [(f"c{g * per + i:04d}", (centres[g] + rng.standard_normal(dim) * 0.3).astype(np.float32).tolist(), g) for g in range(groups) for i in range(per)]
    return rows, spark.createDataFrame(rows, "chunk_id string, vec array<float>, truth int").repartition(4)


def sequential(rows, p):
    """The rule itself: split the largest part first, then merge small ones."""
    ids = np.array([r[0] for r in rows])
    raw = np.array([r[1] for r in rows], dtype=float)
    order = np.argsort(ids)
    ids, raw = ids[order], raw[order]
    u = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    parts, stuck = [np.arange(len(ids))], set()
    while len(parts) < p.max_regions:
        over = [i for i, x in enumerate(parts) if len(x) > p.max_region_size and i not in stuck]
        if not over:
            break
        t = min(over, key=lambda i: (-len(parts[i]), min(ids[parts[i]].tolist())))
        right = cl.two_means(u[parts[t]], raw[parts[t]], p.max_iters)
        if right.all() or not right.any():
            stuck.add(t)
            continue
        parts.append(parts[t][right])
        parts[t] = parts[t][~right]
    while len(parts) > 1 and any(len(x) < p.min_region_size for x in parts):
        s = min((i for i, x in enumerate(parts) if len(x) < p.min_region_size), key=lambda i: (len(parts[i]), min(ids[parts[i]].tolist())))
        x = parts.pop(s)
        c = raw[x].sum(0) / np.linalg.norm(raw[x].sum(0))
        best = max(range(len(parts)), key=lambda i: c @ (raw[parts[i]].sum(0) / np.linalg.norm(raw[parts[i]].sum(0))))
        parts[best] = np.concatenate([parts[best], x])
    return sorted(sorted(ids[x].tolist()) for x in parts)


def as_parts(members):
    out = {}
    for r in members.collect():
        out.setdefault(r.region_id, []).append(r.chunk_id)
    return sorted(sorted(v) for v in out.values())


@pytest.mark.parametrize("cap,local", [(400, 4096), (400, 30), (5, 4096), (5, 30)])
def test_clusters_equal_sequential_rule(spark, cap, local):
    rows, df = blobs(spark, 6, 25)
    p = cl.ClusterParams(max_region_size=12, max_regions=cap, local_rows=local)
    _, members = cl.cluster_chunks(df, p)
    assert as_parts(members) == sequential(rows, p)


def test_blob_purity_and_centroids(spark):
    rows, df = blobs(spark, 5, 14)
    regions, members = cl.cluster_chunks(df)
    truth = {r[0]: r[2] for r in rows}
    parts = as_parts(members)
    assert sum(len(p) for p in parts) == len(rows) and max(map(len, parts)) <= 18
    same = sum(max(sum(truth[c] == g for c in p) for g in range(5)) for p in parts)
    assert same / len(rows) >= 0.8
    assert all(abs(np.linalg.norm(r.centroid) - 1) < 1e-9 for r in regions.collect())
    few = df.limit(3)
    assert cl.cluster_chunks(few)[0].count() == 1
    assert cl.cluster_chunks(df.limit(0))[0].count() == 0


def test_identical_vectors_stay_together(spark):
    df = spark.createDataFrame([(f"x{i:03d}", [1.0, 0.0]) for i in range(40)], "chunk_id string, vec array<float>")
    for local in (4096, 10):
        assert len(as_parts(cl.cluster_chunks(df, cl.ClusterParams(local_rows=local))[1])) == 1


def test_two_hop_seeds_split_too(spark):
    rows, df = blobs(spark, 4, 20)
    _, members = cl.cluster_chunks(df, cl.ClusterParams(max_region_size=25, local_rows=10, seeds="two_hop"))
    truth = {r[0]: r[2] for r in rows}
    assert all(len({truth[c] for c in p}) == 1 for p in as_parts(members))


def test_edges_sparse_and_top_fraction(spark):
    rng = np.random.default_rng(5)
    rows = [(f"n{i:02d}", (np.ones(4) + rng.standard_normal(4) * 0.01).tolist()) for i in range(30)] + [("none", None)]
    df = spark.createDataFrame(rows, "chunk_id string, vec array<float>")
    e = nw.chunk_edges(df, k=2).collect()
    assert 15 <= len(e) <= 60 and all(r.a < r.b for r in e) and not [r for r in e if "none" in (r.a, r.b)]
    top = nw.chunk_edges(df, k=2, keep_fraction=0.25).collect()
    assert len(top) == -(-len(e) // 4)
    assert min(r.weight for r in top) >= sorted((r.weight for r in e), reverse=True)[len(top) - 1] - 1e-9


def test_file_edges_max_not_sum(spark):
    edges = spark.createDataFrame([("a1", "b1", 0.5), ("a2", "b1", 0.7), ("a1", "a2", 0.9), ("b1", "c1", 0.4)], "a string, b string, weight double")
    chunks = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("b1", "B"), ("c1", "C")], "chunk_id string, source_file string")
    got = {(r.a, r.b): r.weight for r in nw.transcript_edges(edges, chunks, k=1).collect()}
    assert got == {("A", "B"): 0.7, ("B", "C"): 0.4}


def test_only_the_best_terms_of_a_chunk_are_sorted(spark):
    rng = np.random.default_rng(5)
    of = [None, None] + [f"c{i // 40}" for i in range(400)] + ["c0"] * 3
    rows = [(c, f"t{rng.integers(30):02d}", float(rng.integers(1, 6)) / 3) for c in of]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)] + [pa.array([round(r[2], 9) for r in rows])], names=["chunk_id", "term", "score", "rounded"])
    found = [tuple(r.values()) for part in kw._leading(4)(iter([batch.slice(0, 0), batch.slice(0, 100), batch.slice(100)])) for r in part.to_pylist()]
    assert len(found) <= 2 + 4 * (10 + 1 + 1) and found == [r for r in found if r in rows]
    for c in set(of):
        best = lambda some: sorted((-round(s, 9), t) for d, t, s in some if d == c)[:4]
        assert best(found) == best(rows)
    d = spark.createDataFrame([("a", "zebra zebra grass plain river"), ("a", "zebra lake"), ("b", None), (None, "grass")], "chunk_id string, content string")
    top = kw.top_keywords(d, kw.keyword_df(d), kw.corpus_size(d), ["chunk_id"], 2)
    assert {(r.chunk_id, r.rank, r.term) for r in top.collect()} == {("a", 1, "zebra"), ("a", 2, "lake"), (None, 1, "grass")}
    plan = top._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2 and plan.index("Window") < plan.index("MapInArrow")


def test_keywords_and_digests(spark):
    texts = ["Zebra grass zebra. More zebra talk.", "zebra stripes and grass", "engine piston engine oil", "engine oil leaks the"]
    d = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "chunk_id string, content string")
    mem = spark.createDataFrame([("z", "d0", 0.1), ("z", "d1", 0.2), ("e", "d2", 0.2), ("e", "d3", 0.1)], "region_id string, chunk_id string, distance double")
    ex = kw.extractive_digest(mem.join(d, "chunk_id"), kw.keyword_df(d), kw.corpus_size(d), "region_id", ["distance", "chunk_id"])
    got = {r.region_id: r for r in ex.collect()}
    assert got["z"].keywords[0] == "zebra" and not {"engine", "the", "and"} & set(got["z"].keywords)
    assert got["z"].abstract == "Zebra grass zebra. More zebra talk." and got["z"].title.startswith("Zebra · ")
    calls = spark.sparkContext.accumulator(0)

    def model(system, prompt):
        calls.add(1)
        return "TITLE: T\nABSTRACT: A\nKEYWORDS: k"

    empty = spark.createDataFrame([], nw.CACHE_SCHEMA)
    first, cache = dg.digest_regions(mem, d, empty)
    assert {r.source for r in first.collect()} == {"extractive"}
    cache = spark.createDataFrame(cache.collect(), cache.schema)
    up, cache2 = dg.digest_regions(mem, d, cache, complete=model, model="m")
    up, cache2 = up.collect(), spark.createDataFrame(cache2.collect(), cache.schema)
    assert {r.source for r in up} == {"llm:m"} and all(len(r.vec) == 64 for r in up)
    before = calls.value
    again, _ = dg.digest_regions(mem, d, cache2, complete=model, model="m")
    assert {r.title for r in again.collect()} == {"T"} and calls.value == before

    def down(system, prompt):
        raise RuntimeError("loading")

    off, _ = dg.digest_regions(mem, d, empty, complete=down)
    assert {r.source for r in off.collect()} == {"extractive"}


def test_labels(spark):
    d = spark.createDataFrame([(f"d{i:02d}", f"one two three four five six seven {i}") for i in range(30)], "chunk_id string, content string").coalesce(1)
    got = dg.label_chunks(d, lambda s, p: "1. \"First label.\"\n2) second\n99. no", "m").collect()
    assert len(got) == 30
    assert sum(r.source == "llm:m" for r in got) == 6 and {r.label for r in got if r.source == "head"} == {"one two three four five six"}

    def flaky(system, prompt):
        if prompt.startswith("1. one two three four five six seven 0"):
            raise RuntimeError("down")
        return ""

    assert dg.label_chunks(d, flaky, "m").count() == 18


def test_hash_ignores_order(spark):
    rows = [("g", f"c{i}") for i in range(20)]
    a = dg.digest_hash(spark.createDataFrame(rows, "g string, chunk_id string"), ["g"], "region").first().input_hash
    b = dg.digest_hash(spark.createDataFrame(rows[::-1], "g string, chunk_id string").repartition(3), ["g"], "region").first().input_hash
    e = dg.digest_hash(spark.createDataFrame(rows[1:], "g string, chunk_id string"), ["g"], "region").first().input_hash
    assert a == b and a != e


def test_build_and_prune(spark, tmp_path):
    rows, df = blobs(spark, 3, 10)
    chunks = df.drop("truth").withColumns(
        {"source_file": F.concat(F.lit("f"), F.substring("chunk_id", 4, 1)), "content": F.concat(F.lit("text about "), "chunk_id"),
         "start_offset": F.lit(0), "deleted_at": F.lit(None).cast("timestamp"), "created_at": F.current_timestamp()}
    )
    store = nw.BuildStore(spark, str(tmp_path))
    with pytest.raises(ValueError):
        nw.build_atlas(store, "b0", chunks.limit(3))
    nw.build_atlas(store, "b1", chunks)
    p = nw.BuildParams(link_min_weight=-1.0)
    nw.build_atlas(store, "b2", chunks, p, complete=lambda s, q: "TITLE: x", model="m")
    assert [r.build_id for r in nw.current_build_id(store.builds()).collect()] == ["b2"]
    links = store.read("region_links", "b2").collect()
    assert links and all(r.region_a < r.region_b for r in links)
    assert store.read("region_members", "b2").count() == 30
    assert nw.prune_builds(store) == ["b1"]
    assert {r.build_id for r in store.read("regions").select("build_id").distinct().collect()} == {"b2"}


def test_bisect_splits_a_cluster_over_many_tasks(spark):
    rng = np.random.default_rng(3)
    rows = [("a" if i % 3 else None, f"c{i:03d}", rng.standard_normal(5).tolist()) for i in range(120)] + [("b", "c900", [1.0] * 5)]
    want = {}
    for key in ("a", None):
        mine = sorted(r[1:] for r in rows if r[0] == key)
        raw = np.array([v for _, v in mine])
        side = cl.two_means(raw / np.linalg.norm(raw, axis=1, keepdims=True), raw, 25)
        want |= {(key, c): int(x) for (c, _), x in zip(mine, side)}
    df = spark.createDataFrame(rows, "region string, chunk_id string, vec array<double>")
    split = cl.bisect(df, "region", block_rows=16)
    assert "FlatMapGroupsInPandas" not in split._jdf.queryExecution().toString()
    assert {(r.region, r.chunk_id): r.side for r in split.collect()} == want | {("b", "c900"): 0}


def test_lowest_pair_of_blocks_is_the_farthest_pair_and_blocks_stay_few():
    import numpy as np

    from spanlake.operators.cluster import _unit, farthest_pair
    from spanlake.operators.vectors import TRAVEL_ROWS, lowest_pair, travelling_blocks

    rng = np.random.default_rng(3)
    u = _unit(rng.standard_normal((1500, 8)).round(1))
    u[[4, 900]], u[[7, 600, 1400]] = u[0], -u[0]
    u[5] = 0
    side = rng.random(len(u)) < 0.4
    a, b = np.flatnonzero(side), np.flatnonzero(~side)
    met = [lowest_pair(u[x], u[y], x, y, x is y) for x, y in ((a, a), (b, b), (a, b))]
    assert min(met)[1:] == lowest_pair(u, u, np.arange(1500), np.arange(1500), True)[1:] == farthest_pair(u)
    for rows in (100_000, 600_000):  # a row travels once for each block
        assert travelling_blocks(rows, 128, 12) <= 7 + rows // TRAVEL_ROWS


def test_nearest_of_wide_blocks_equal_plain_products_and_travel_in_few_blocks(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from spanlake.operators import vectors as vs

    rng = np.random.default_rng(5)
    u = rng.standard_normal((400, 6)).round(1).astype(np.float32)
    u[::7], u[3], u[11, 2] = u[0], 0, np.nan  # copies, a zero, a row that isn't numbers
    ids = np.array([f"c{i:04d}" for i in rng.permutation(400)], dtype=object)
    col = pa.array(list(u), pa.list_(pa.float32()))
    sims = vs.similarity(col, col)
    sims[~np.isfinite(sims)] = -np.inf
    monkeypatch.setattr(vs, "TILE", 64)
    for floor in (None, 0.35):
        r, c = vs.best_per_row(sims, ids, 5, ids[:, None] == ids[None, :], floor)
        want = {(i, j) for i, j in zip(r.tolist(), c.tolist()) if np.isfinite(sims[i, j])}
        a, b, _ = vs._nearest(col, col, ids, ids, 5, floor, True, 100)
        assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)
