"""Block index: equal to plain scoring whatever the ranges, read without texts, pruned, saved and opened again."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanlake.operators import blocks, fusion
from spanlake.operators import lexical as lx
from spanlake.sources import tables


def corpus(seed=0, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=rng.choice([0, 1, 5, 60, 200]))) for _ in range(n)]
    texts[7] = texts[3] = "w1 w2 Rare"
    return [(f"c{i:04d}", t) for i, t in enumerate(texts)] + [("c9000", None), ("c9001", "!!"), ("c9002", "Émile ÉMILE w1")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, content string").repartition(3)


QUERIES = [(1, "w1 w2 rare"), (2, "w1 w1 w59 w3"), (3, "émile"), (4, "absent"), (5, ""), (6, "w0 w1 w2 w3 w4 w5 w6")]


def brute(rows, text):
    docs = {c: (t or "").lower().replace("!", " ").split() for c, t in rows}
    avg = sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    out = {}
    for c, d in docs.items():
        tf = Counter(d)
        s = sum(math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(d) / avg)) for w in text.lower().split() if tf[w])
        if s:
            out[c] = s
    return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))


@pytest.mark.parametrize("size, k", [(1, 5), (7, 0), (20, 400)])
def test_search_is_that_of_brute_force(spark, size, k):
    rows = corpus()
    index = blocks.build_blocks(frame(spark, rows), size=size)
    q = spark.createDataFrame(QUERIES, "query_id int, text string")
    got = lx.bm25_search(q, index, k).collect()
    for i, text in QUERIES:
        want = brute(rows, text)[: k or None]
        mine = sorted((r.rank, r.chunk_id, round(r.score, 8)) for r in got if r.query_id == i)
        assert mine == [(n, c, round(s, 8)) for n, (c, s) in enumerate(want, 1)]


def test_stats_frequencies_and_postings(spark):
    rows = corpus(3)
    index, plain = blocks.build_blocks(frame(spark, rows), size=11), lx.build_bm25(frame(spark, rows))
    assert index.stats.collect() == plain.stats.collect()
    assert {tuple(r) for r in index.terms.collect()} == {tuple(r) for r in plain.postings.groupBy("term").count().collect()}
    assert Counter(map(tuple, blocks.postings(index).select("term", "chunk_id", "tf", "dl").collect())) == Counter(map(tuple, plain.postings.select("term", "chunk_id", "tf", "dl").collect()))
    asked = spark.createDataFrame([("w1",), ("ABSENT",)], "term string")
    assert {tuple(r) for r in lx.idf(asked, index).collect()} == {tuple(r) for r in lx.idf(asked, plain).collect()}


@pytest.mark.parametrize("k", [0, 2])
def test_best_passage_of_each_chunk(spark, k):
    rng = random.Random(1)
    rows = [(f"c{i}", " ".join(rng.choices([f"w{j}" for j in range(40)], k=rng.choice([3, 50, 400])))) for i in range(40)] + [("c40", "w1 " * 3000), ("c41", None)]
    d = frame(spark, rows)
    q = spark.createDataFrame([(1, "w1 w2"), (2, "w39 w38 w37 w5")], "query_id int, text string")
    plain = lx.passage_search(q, lx.build_passage_index(d), k).collect()
    for size in (1, 100_000):
        got = lx.passage_search(q, blocks.build_passage_blocks(d, size=size), k).collect()
        key = lambda rows: sorted((r.query_id, r.rank, r.chunk_id, r.start, r.end, round(r.score, 8)) for r in rows)
        assert key(got) == key(plain)


def test_ranges_that_cannot_reach_the_first_k_are_not_read(spark, monkeypatch):
    rows = [(f"c{i:05d}", "common " * 3 + f"word{i} " * 30) for i in range(400)] + [(f"c9{i}", "common " * 40) for i in range(10)]
    index = blocks.build_blocks(frame(spark, rows).repartition(1).sortWithinPartitions("chunk_id"), size=10)
    seen = []
    inner = blocks._ranges_ranked

    def spied(index_, pairs, *args):
        seen.append(pairs.count())
        return inner(index_, pairs, *args)

    monkeypatch.setattr(blocks, "_ranges_ranked", spied)
    got = lx.bm25_search(spark.createDataFrame([(1, "common")], "query_id int, text string"), index, 5).collect()
    assert [r.chunk_id for r in sorted(got, key=lambda r: r.rank)] == [f"c9{i}" for i in range(5)]
    assert seen[0] == 2 and sum(seen) < 5


def test_many_queries_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(blocks, "SHARE", 2)
    monkeypatch.setattr(blocks, "SMALL_TERMS", 1)
    monkeypatch.setattr(blocks, "ROWS", 2)
    rows = corpus(5)
    q = spark.createDataFrame(QUERIES, "query_id int, text string")
    got = lx.bm25_search(q, blocks.build_blocks(frame(spark, rows), size=9), 4).collect()
    for i, text in QUERIES:
        assert [r.chunk_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == [c for c, _ in brute(rows, text)[:4]]


def test_empty_index(spark):
    q = spark.createDataFrame(QUERIES, "query_id int, text string")
    for rows in ([], [("a", None)]):
        index = blocks.build_blocks(frame(spark, rows))
        assert lx.bm25_search(q, index, 3).count() == 0 and lx.bm25_search(q, index, 0).count() == 0
        assert index.stats.first().n_docs == len(rows)
        assert lx.passage_search(q, blocks.build_passage_blocks(frame(spark, rows)), 3).count() == 0


def test_ranges_end_with_tokens_and_keep_chunks_whole(monkeypatch):
    monkeypatch.setattr(blocks, "TOKENS", 50)
    monkeypatch.setattr(blocks, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 3)}))}))
    rng = random.Random(0)
    rows = [(f"c{i // 4:02d}", i, ["t"] * rng.choice([0, 3, 90])) for i in range(60)]
    table = pa.table({"chunk_id": [r[0] for r in rows], "start": pa.array([r[1] for r in rows], pa.int32()), "toks": pa.array([r[2] for r in rows], pa.list_(pa.string()))})
    members = pa.list_(pa.struct([("chunk_id", pa.string()), ("start", pa.int32())]))
    numbers = pa.list_(pa.int32())
    schema = pa.schema([("range", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("tf", pa.binary()), ("pos", pa.binary()), ("top_tf", numbers), ("top_dl", numbers), ("ids", members)])
    for size, step in ((1, 7), (10, 7), (1000, 7), (10, 60)):
        out = list(blocks._blocks(("chunk_id", "start"), size, schema)(iter(table.to_batches(max_chunksize=step))))
        held = [[m["start"] for m in b.column("ids")[0].as_py()] for b in out]
        assert sorted(i for h in held for i in h) == list(range(60))
        assert all(h[0] % 4 == 0 for h in held)  # no chunk is divided
        assert len({b.column("range")[0].as_py() for b in out}) == len(out) and out[0].column("range")[0].as_py() == 3 << 32


def test_long_documents_need_wide_numbers(spark):
    rows = [("long", "a " * 70_000 + "b"), ("short", "b c")]
    index = blocks.build_blocks(frame(spark, rows))
    assert {(r.term, r.chunk_id): r.tf for r in blocks.postings(index).collect()} == {("a", "long"): 70_000, ("b", "long"): 1, ("b", "short"): 1, ("c", "short"): 1}


def test_whole_search_index_is_saved_and_opened(spark, tmp_path):
    rows = [(c, t, [float(i % 7), 1.0] if i % 3 else None) for i, (c, t) in enumerate(corpus(2))]
    d = spark.createDataFrame(rows, "chunk_id string, content string, vec array<float>")
    q = spark.createDataFrame([(i, t, [1.0, 0.5]) for i, t in QUERIES], "query_id int, text string, vec array<float>")
    at = str(tmp_path / "index")
    assert tables.load_search_index(spark, at) is None
    index = fusion.SearchIndex(d)
    before = Counter(map(str, fusion.hybrid_search(q, index, limit=7).collect()))
    first = tables.save_search_index(index, at)  # copied
    loaded = tables.load_search_index(spark, at)
    found = fusion.hybrid_search(q, loaded, limit=7)
    assert Counter(map(str, found.collect())) == before
    second = tables.save_search_index(fusion.SearchIndex(d.filter("chunk_id < 'c0100'")), at, keep=0)  # built in place
    assert first != second and [v for _, v in tables.versions(spark, at)] == [second]
    hits = fusion.hybrid_search(q, tables.load_search_index(spark, at), limit=7).collect()
    assert hits and all(r.chunk_id < "c0100" for r in hits)
    # no text is read once the index is there
    read = [f for f in loaded.keyword.blocks.inputFiles() + loaded.passages.blocks.inputFiles() + loaded.chunks.inputFiles()]
    assert all("/index/" in f for f in read) and "content" not in loaded.chunks.columns
    assert "content" not in found._jdf.queryExecution().toString()


def test_half_written_versions_are_not_seen(spark, tmp_path):
    d = frame(spark, corpus(1)).withColumn("vec", F.lit(None).cast("array<float>"))
    at = str(tmp_path / "index")
    blocks.build_blocks(d, path=f"{at}/broken/keyword")  # a writer that died before its manifest
    assert tables.load_search_index(spark, at) is None
    good = tables.save_search_index(fusion.SearchIndex(d), at, "good")
    assert tables.versions(spark, at)[0][1] == good == "good" and len(tables.versions(spark, at)) == 1


def test_a_range_is_numbered_in_few_bytes_a_token():
    n, per = 2000, 200
    code = np.random.default_rng(2).integers(0, 3000, n * per)
    toks = pa.ListArray.from_arrays(pa.array(np.arange(0, n * per + 1, per), pa.int32()), pa.array([f"w{i}" for i in range(3000)]).take(pa.array(code)))
    rows = pa.table({"chunk_id": [f"d{i:05d}" for i in range(n)], "toks": toks})
    members = pa.list_(pa.struct([("chunk_id", pa.string())]))
    numbers = pa.list_(pa.int32())
    schema = pa.schema([("range", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("tf", pa.binary()), ("pos", pa.binary()), ("top_tf", numbers), ("top_dl", numbers), ("ids", members)])
    tracemalloc.start()
    blocks._range_blocks(rows, ("chunk_id",), 0, schema)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * n * per
