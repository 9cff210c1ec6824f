import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.operators import fusion, lexical as lx, locate
from spanlake.operators.vectors import block_topk, vector_search, vector_search_ann
from spanlake.ordered import with_ordinal, with_running


def docs(spark, texts):
    return spark.createDataFrame([(f"d{i:03d}", t) for i, t in enumerate(texts)], "chunk_id string, content string")


def qs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def brute_bm25(texts, query):
    toks = [re.findall(r"\w+", t.lower()) for t in texts]
    avg = sum(map(len, toks)) / len(toks)
    out = {}
    for i, ts in enumerate(toks):
        tf, s = Counter(ts), 0.0
        for q in re.findall(r"\w+", query.lower()):
            if tf[q]:
                df = sum(q in x for x in toks)
                s += math.log((len(toks) - df + 0.5) / (df + 0.5) + 1) * tf[q] * 2.2 / (tf[q] + 1.2 * (0.25 + 0.75 * len(ts) / avg))
        if s:
            out[f"d{i:03d}"] = s
    return out


TEXTS = ["cat cat dog", "dog bird", "", "cat fish bird bird", "dog", "dog"]


@pytest.mark.parametrize("small", [True, False])
def test_bm25_matches_brute_force(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(lx, "SMALL_TERMS", 0)
    index = lx.build_bm25(docs(spark, TEXTS))
    got = lx.bm25_search(qs(spark, "cat cat bird", "dog", "zebra"), index, 0).collect()
    for q, text in enumerate(["cat cat bird", "dog", "zebra"]):
        want = brute_bm25(TEXTS, text)
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert {r.chunk_id: r.score for r in mine} == pytest.approx(want)
        assert [r.chunk_id for r in mine] == sorted(want, key=lambda c: (-round(want[c], 9), c))


def test_bm25_limit_replace_and_empty(spark):
    index = lx.build_bm25(docs(spark, TEXTS))
    assert lx.bm25_search(qs(spark, "dog"), index, 2).count() == 2
    fresh = spark.createDataFrame([("d000", "zebra")], "chunk_id string, content string")
    up = lx.upsert_bm25(index, fresh, spark.createDataFrame([("d004",)], "chunk_id string"))
    again = lx.upsert_bm25(up, fresh)
    want = brute_bm25(["zebra", "dog bird", "", "cat fish bird bird", "dog"], "zebra cat")
    got = {r.chunk_id: r.score for r in lx.bm25_search(qs(spark, "zebra cat"), again, 0).collect()}
    assert got == pytest.approx(want)
    none = lx.build_bm25(docs(spark, TEXTS).limit(0))
    assert lx.bm25_search(qs(spark, "dog"), none, 5).count() == 0


def test_idf_order(spark):
    index = lx.build_bm25(docs(spark, TEXTS))
    w = {r.term: r.idf for r in lx.idf(spark.createDataFrame([("dog",), ("fish",), ("none",)], "term string"), index).collect()}
    assert w["none"] > w["fish"] > w["dog"] > 0


def test_ordinals_of_a_hot_key(spark):
    rows = [("hot", i % 7, i, 1) for i in range(500)] + [("b", 3, 1000, 5), ("b", 1, 1001, 6)]
    df = spark.createDataFrame(rows, "k string, o int, id int, v int").repartition(5)
    got = with_running(df, ["k"], ["o", "id"], ordinal="n", sums={"s": F.col("v")}).collect()
    for key in ("hot", "b"):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        run = 0
        want = {}
        for n, r in enumerate(mine):
            want[r[2]] = (n, run)
            run += r[3]
        assert {r.id: (r.n, r.s) for r in got if r.k == key} == want
    assert [r.n for r in with_ordinal(df.limit(0), ["k"], ["o"], "n").collect()] == []


def random_vectors(spark, n, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.standard_normal((n, dim)).astype(np.float32)
    m[n // 2] = m[0]
    m[n // 3] = m[0]
    return m, spark.createDataFrame([(f"v{i:03d}", m[i].tolist()) for i in range(n)], "chunk_id string, vec array<float>")


def exact(m, q, k):
    u = m / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = u @ (q / np.linalg.norm(q.astype(float)))
    return sorted(range(len(m)), key=lambda i: (-round(s[i], 9), i))[:k]


@pytest.mark.parametrize("small_left", [100, 0])
def test_vector_search_exact(spark, small_left):
    m, df = random_vectors(spark, 90)
    q = spark.createDataFrame([(i, m[i].tolist()) for i in (0, 5)] + [(9, None)], "query_id long, vec array<float>")
    got = vector_search(q, df.repartition(5), 6, small_left=small_left).collect()
    for i in (0, 5):
        mine = [r.chunk_id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])]
        assert mine == [f"v{j:03d}" for j in exact(m, m[i], 6)]
    assert not [r for r in got if r.query_id == 9]


def test_block_topk_blocks_agree(spark):
    _, df = random_vectors(spark, 70)
    left = df.toDF("left_id", "left_vec")
    right = df.toDF("right_id", "right_vec")
    a, b = (block_topk(left, right, 4, min_sim=0.1, exclude_self=True, block_rows=n).collect() for n in (1000, 16))
    key = lambda r: (r.left_id, r.right_id, r["rank"])
    assert sorted(map(key, a)) == sorted(map(key, b))


def test_ann_recall(spark):
    m, df = random_vectors(spark, 200, dim=16)
    q = spark.createDataFrame([(i, m[i].tolist()) for i in range(20)], "query_id long, vec array<float>")
    pairs = lambda d: {(r.query_id, r.chunk_id) for r in d.collect()}
    want, got = pairs(vector_search(q, df, 5)), pairs(vector_search_ann(q, df, 5, tables=24, bits=4))
    assert len(want & got) / len(want) > 0.8


def test_rrf_and_provenance(spark):
    arm = "query_id long, chunk_id string, rank int"
    bm = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], arm)
    vec = spark.createDataFrame([(1, "a", 2), (1, "c", 1)], arm)
    got = {r.chunk_id: r for r in fusion.rrf_fuse_arms(bm, None, vec).withColumn("kind", fusion.match_kind(F.col("bm25"), F.col("vector"))).collect()}
    assert got["a"].score == pytest.approx(1 / 61 + 1 / 62)
    assert {k: r.kind for k, r in got.items()} == {"a": "hybrid", "b": "keyword", "c": "semantic"}


def test_page_clamping(spark):
    pool = spark.createDataFrame([(1, f"c{i}", 1.0 / i, i) for i in range(1, 31)], "query_id long, chunk_id string, score double, rank int")
    req = spark.createDataFrame([(1, 9, 13)], "query_id long, page int, page_size int")
    rows = fusion.ranked_page(pool, req).collect()
    assert {(r.total, r.page, r.page_size, r.pages) for r in rows} == {(30, 3, 12, 3)} and len(rows) == 6
    assert max(r.score_norm for r in rows) == pytest.approx(1 / 25)


FIVE = "Filler one here. Some more filler. The rare zebra ran. After words follow. Last one."


def test_locate_sentence_with_context(spark):
    d = docs(spark, [FIVE, "filler words", "zebra " * 80])
    index, q = lx.build_bm25(d), qs(spark, "rare zebra")
    pairs = d.withColumn("query_id", F.lit(0).cast("long"))
    win, scores = locate.locate_passage(pairs, locate.query_weights(q, index), 60)
    rows = {r.chunk_id: r for r in win.collect()}
    assert "The rare zebra ran." in FIVE[rows["d000"].win_start : rows["d000"].win_end] and rows["d000"].win_start > 0
    assert "d001" not in rows and "d002" not in rows  # no hit; one sentence wider than the window
    mine = sorted((r for r in scores.collect() if r.chunk_id == "d000"), key=lambda r: r.sent)
    assert len(mine) == 5 and mine[2].score == 1.0
    late = locate.locate_window(pairs, locate.query_weights(q, index), 60).collect()
    w = {r.chunk_id: r for r in late}
    assert "zebra" in FIVE[w["d000"].win_start : w["d000"].win_end] and w["d000"].win_end - w["d000"].win_start <= 60
    assert w["d002"].win_end - w["d002"].win_start <= 60


def test_find_evidence_cascade(spark):
    d = docs(spark, [FIVE, "Nothing in common. At all here.", "zebra " * 80])
    chunks = d.withColumns({"source_file": F.lit("s"), "speaker": F.lit("x"), "vec": F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")})
    q = spark.createDataFrame([(0, "the rare zebra", [1.0, 0.0])], "query_id long, text string, vec array<float>")
    rows = {r.chunk_id: r for r in locate.find_evidence(q, fusion.SearchIndex(chunks), chunks).collect()}
    assert rows["d000"].how == "sentence" and rows["d000"].match == "hybrid"
    assert "zebra" in rows["d000"].snippet
    assert rows["d002"].how == "window" and rows["d001"].match == "semantic"
    assert rows["d001"].how in ("semantic", "head") and rows["d001"].total == 3
    marked = [s.text for s in rows["d000"].segments if s.mark]
    assert marked == ["rare", "zebra"]


LONG = " ".join(f"zebra stripes number {i} run over the wide plain and then rest." for i in range(200))


@pytest.mark.parametrize("small", [True, False])
def test_long_chunk_leaves_room_for_others(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(lx, "SMALL_TERMS", 0)
    monkeypatch.setattr(lx, "DOC_BLOCK", 7)
    d = docs(spark, [LONG, LONG, "a zebra " + "with many other words " * 20, "no match here", "one more zebra " + "and some other words too " * 20])
    index, q = lx.build_passage_index(d), qs(spark, "zebra stripes run", "plain zebra")
    whole, got, cut = (lx.passage_search(q, index, k, scan_factor=f).collect() for k, f in ((0, None), (3, None), (3, 3)))
    key = lambda rows: sorted((r.query_id, r["rank"], r.chunk_id, r.start, r.end, round(r.score, 9)) for r in rows)
    assert key(got) == [x for x in key(whole) if x[1] <= 3] and len(got) == 6
    assert len(cut) < len(got)
    assert len(fusion.hybrid_search(q, fusion.SearchIndex(d), limit=3).collect()) == 6


def test_every_hit_is_located(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    key = ("query_id", "chunk_id")
    located = {tuple(r[c] for c in key) for r in entry.queries()["locate_passage_sentences_all"](spark, sf).select(*key).distinct().collect()}
    top = {tuple(r[c] for c in key) for r in entry.queries()["locate_passage_sentences"](spark, sf).select(*key).distinct().collect()}
    assert top < located and len(located) > 3 * 40


def test_chunk_is_located_once_for_all_queries(spark):
    d = docs(spark, [FIVE, "The zebra ran far. Rest now."])
    index, q = lx.build_bm25(d), qs(spark, *["rare zebra ran"] * 30)
    pairs = q.select("query_id").crossJoin(d.select("chunk_id"))
    weights = locate.query_weights(q, index)
    met = locate._met(pairs, d, locate._summed(weights), locate._texts)
    assert met.filter(~F.col("head")).count() == 2  # chunks, not the 60 pairs
    win, scores = locate.locate_passage(pairs, weights, 60, d)
    plain, _ = locate.locate_passage(pairs.join(d, "chunk_id"), weights, 60)
    assert sorted(win.collect()) == sorted(plain.collect()) and win.count() == 60 and scores.count() == 30 * 7
    calls = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def embed(text):
        calls.add(1)
        return [1.0, float(len(text))]

    vecs = q.withColumn("vec", F.array(F.lit(1.0), F.lit(9.0)).cast("array<float>"))
    sem, _ = locate.semantic_locate(pairs, vecs, embed, contents=d)
    assert sem.count() == 60 and calls.value == 7  # a sentence is embedded once, not for every query


def test_repeated_pairs_and_weights_are_located_as_rows(spark):
    d = docs(spark, [FIVE])
    q = qs(spark, "rare zebra")
    pairs, weights = q.select("query_id").crossJoin(d.select("chunk_id")), locate.query_weights(q, lx.build_bm25(d))
    twice = lambda df: df.unionByName(df)
    for once, several, rows in (
        (locate.locate_passage(pairs, weights, 60, d)[0], locate.locate_passage(pairs, twice(weights), 60, twice(d))[0], 8),
        (locate.locate_passage(pairs, weights, 60, d)[0], locate.locate_passage(twice(pairs), weights, 60, twice(d))[0], 64),
        (locate.locate_window(pairs, weights, 60, d), locate.locate_window(pairs, weights, 60, twice(d)), 1),
    ):
        (a,), got = once.collect(), several.collect()
        assert len(got) == rows and {(r.win_start, r.win_end) for r in got} == {(a.win_start, a.win_end)}
        assert all(r.score == pytest.approx(4 * a.score) for r in got)


def test_terms_are_counted_a_bounded_number_of_tokens_at_a_time(monkeypatch):
    from collections import Counter

    import pyarrow as pa

    from spanlake.operators import lexical

    texts = [["a", "b", "a"], [], ["b"] * 9, ["c", "a"], ["a"], [], ["d", "d"]]
    batch = pa.RecordBatch.from_arrays([pa.array([f"c{i}" for i in range(len(texts))]), pa.array(texts, pa.list_(pa.string()))], names=["chunk_id", "toks"])
    monkeypatch.setattr(lexical, "COUNTED_TOKENS", 4)
    out = list(lexical._counted(["chunk_id"])([batch.slice(1), batch.slice(0, 1), batch.slice(0, 0)]))
    got = sorted(tuple(r.values()) for b in out for r in b.to_pylist())
    want = sorted((t, f"c{i}", n, len(x)) for i, x in enumerate(texts) for t, n in Counter(x).items())
    assert got == want and len(out) > 3 and max(sum(b["tf"].to_pylist()) for b in out) == 9


def test_span_groups_stay_where_the_scores_are(spark):
    """The groups of a pair are those of a plain count, in small batches too, and rows that lie together aren't shuffled."""
    import random

    rnd, rows, want = random.Random(3), [], set()
    for q, c in [(q, f"c{c}") for q in range(4) for c in range(30)]:
        sents, at = [], 0
        for sent in range(rnd.choice([1, 3, 8, 20])):
            end = at + rnd.randrange(1, 60)
            sents.append((q, c, sent, at, end, rnd.choice([0.1, 0.4, 0.5, 0.7, 1.0])))
            at = end + 1
        rows += rnd.sample(sents, len(sents))
        runs = []
        for _, _, sent, start, end, score in (s for s in sents if s[5] >= 0.5):
            if runs and runs[-1][3] == sent - 1:
                runs[-1] = (runs[-1][0], end, max(score, runs[-1][2]), sent)
            else:
                runs.append((start, end, score, sent))
        best = sorted(runs, key=lambda r: (-r[2], r[0]))[:3]
        wide = [sum(r[1] - r[0] + 3 for r in best[:k]) for k in range(4)]
        best = best[: 3 if len(best) == 3 and wide[3] <= 150 else 2]
        if len(best) > 1 and wide[len(best)] <= 150:
            want |= {(q, c, n, r[0], r[1], r[2], r == best[0]) for n, r in enumerate(sorted(best), 1)}
    scores = spark.createDataFrame(rows, "query_id long, chunk_id string, sent int, start int, end int, score double")
    assert len(want) > 50
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = locate.multi_span_groups(scores.coalesce(1), 150, together=True)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert sorted(map(tuple, locate.multi_span_groups(scores.repartition(5), 150).collect())) == sorted(want)
        assert locate.multi_span_groups(scores.filter("score < 0.5"), 150).count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
