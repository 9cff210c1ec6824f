"""Pages of the fused ranking of all matches against a ranking of all matches."""

import random

import pytest
from pyspark.sql import functions as F

from spanlake.operators import corpus, fusion, paging
from spanlake.operators import lexical as lx
from spanlake.ordered import with_ordinal, with_running


def tables(spark, seed=0, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = [(f"c{i:03d}", " ".join(rng.choices(words, k=rng.choice([3, 30, 90]))), [rng.gauss(0, 1) for _ in range(4)] if i % 4 else None) for i in range(n)]
    rows[5] = rows[6] = ("c005", "w1 w2 w3", [1.0, 0.0, 0.0, 0.0])
    rows[6] = ("c006", *rows[5][1:])
    chunks = spark.createDataFrame([*rows, ("c900", None, None)], "chunk_id string, content string, vec array<float>").repartition(3)
    q = [(1, "w1 w2 w7", [1.0, 0.2, 0.0, 0.0]), (2, "w3", None), (3, "absent", [0.0, 1.0, 0.0, 0.0]), (4, "", None), (5, "w9 w9 w10 w11 w12", [0.1, 0.1, 0.1, 0.9])]
    return chunks, spark.createDataFrame(q, "query_id int, text string, vec array<float>")


@pytest.mark.parametrize("mode, page, size", [("hybrid", 1, 12), ("hybrid", 3, 25), ("hybrid", -1, 0), ("keyword", 2, 12), ("semantic", 99, 12)])
def test_pages_are_those_of_the_whole_ranking(spark, mode, page, size):
    chunks, q = tables(spark)
    req = q.select("query_id", F.lit(page).alias("page"), F.lit(size).alias("page_size"))
    whole = fusion.hybrid_search(q, fusion.SearchIndex(chunks), mode=mode, limit=0)
    want = fusion.ranked_page(whole, req)
    got = paging.hybrid_page(q, fusion.SearchIndex(chunks), req, mode)
    key = lambda df: sorted((r.query_id, r.rank, r.chunk_id, r.total, r.page, r.page_size, r.pages, round(r.score, 9), round(r.bm25, 9), round(r.score_norm, 9), r.start, r.end) for r in df.collect())
    assert key(got) == key(want)
    assert key(got) or mode == "x"


def test_deep_places_are_counted(spark, monkeypatch):
    chunks, q = tables(spark, 3, 300)
    pool = lx.all_scores(q, lx.build_bm25(chunks.select("chunk_id", "content")))
    ranked = {(r.query_id, r.chunk_id): r["rank"] for r in lx.rank_hits(pool, 0).collect()}
    wanted = pool.select("query_id", "chunk_id").filter(F.xxhash64("chunk_id") % 3 == 0)
    for most in (paging.SMALL, 1):  # counted, or ranked as a whole
        monkeypatch.setattr(paging, "SMALL", most)
        got = {(r.query_id, r.chunk_id): r["rank"] for r in paging.places(pool, wanted).collect()}
        assert got and got == {k: ranked[k] for k in got} and len(got) == wanted.count()


def test_no_arm_is_read_whole(spark, monkeypatch):
    """Reads go to the depth that a page needs, whatever the number of matches."""
    chunks, q = tables(spark, 1, 150)
    depths = []
    inner = paging.bm25_search
    monkeypatch.setattr(paging, "bm25_search", lambda queries, index, k: depths.append(k) or inner(queries, index, k))
    paging.hybrid_page(q, fusion.SearchIndex(chunks), q.select("query_id", F.lit(1).alias("page"), F.lit(12).alias("page_size"))).collect()
    assert depths == [3 * (60 + 12) - 60 + 1]


def test_pages_of_an_empty_corpus(spark):
    chunks, q = tables(spark)
    req = q.select("query_id", F.lit(1).alias("page"), F.lit(12).alias("page_size"))
    for mode in ("hybrid", "semantic"):
        assert paging.hybrid_page(q, fusion.SearchIndex(chunks.limit(0)), req, mode).count() == 0
        assert paging.hybrid_page(q.drop("vec"), fusion.SearchIndex(chunks.drop("vec")), req, mode).count() == (0 if mode == "semantic" else paging.hybrid_page(q.drop("vec"), fusion.SearchIndex(chunks), req, "keyword").count())


def test_wide_rows_are_ordered_by_narrow_ones(spark):
    rows = [(f"c{i}", f"s{i % 2}", (i * 7) % 50, "text " * 20) for i in range(50)]
    df = spark.createDataFrame(rows, "chunk_id string, source_file string, at int, content string")
    sums = {"before": F.char_length("content").cast("long")}
    key = lambda d: sorted(map(tuple, d.select("chunk_id", "source_file", "at", "content", "n", "before").collect()))
    plain = with_running(df, ["source_file"], ["at", "chunk_id"], "n", sums)
    narrow = with_running(df, ["source_file"], ["at", "chunk_id"], "n", sums, id=["chunk_id"])
    assert key(plain) == key(narrow)
    assert sorted(r.n for r in with_ordinal(df, [], ["at", "chunk_id"], "n", id=["chunk_id"]).collect()) == list(range(50))


def test_windows_of_a_few_focus_chunks(spark):
    rows = [(f"c{i:02d}", f"s{i % 3}", f"t{i}", i, i, None) for i in range(30)]
    df = spark.createDataFrame(rows, "chunk_id string, source_file string, content string, start_offset int, created_at int, deleted_at string")
    got = corpus.window_around(spark.createDataFrame([("c09",), ("c28",)], "chunk_id string"), df, 1).collect()
    assert sorted((r.focus_id, r.chunk_id, r.text, r.is_focus, r.has_prev, r.has_next) for r in got) == [
        ("c09", "c06", "t6", False, True, True), ("c09", "c09", "t9", True, True, True), ("c09", "c12", "t12", False, True, True),
        ("c28", "c25", "t25", False, True, False), ("c28", "c28", "t28", True, True, False),
    ]
