"""Pipeline operators against brute force on small tables, with nulls, empties, repeats and clashing columns."""

import base64
import collections
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm import decontaminate, fingerprints, langid, line_dedup, minhash, pieces, sharding, substring, toxicity, warc
from spanlake.llm.words import U64, hashed_words, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: names that the operators use inside
CLASHING = ("id", "a", "b", "n", "key", "size", "shard", "slot", "label", "gram", "score", "lang_pred", "held_out", "ta", "tb", "lo", "hi", "n_lines", "_part", "digest", "head", "salt",
    "_gone", "_doc", "_th", "_parts", "_n_lines", "_n_removed", "_row", "_first", "_all", "_language", "_found", "_held", "c", "p", "class_id", "least")


def clash(df):
    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING if c not in df.columns))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    shared = " ".join(words(rng, 80))
    rows = []
    for i in range(n):
        t = " ".join(words(rng, rng.choice([0, 1, 3, 30, 120, 300])))
        if i % 5 == 0:
            t += " " + shared + " " + " ".join(words(rng, 10))
        if i % 7 == 6:
            t = rows[rng.randrange(len(rows))][1] or ""
        if i % 11 == 10:
            w = (rows[5][1] or "x").split()
            for _ in range(max(1, len(w) // 100)):
                w[rng.randrange(len(w))] = "edited"
            t = " ".join(w)
        rows.append((i * 3, t))
    return [*rows, (1000, None), (1003, ""), (None, rows[0][1]), (1006, " \n\t "), (1009, "é ñ 日本 " * 40)]


# words


def test_words_are_hashed_alike_in_blocks():
    rng = np.random.default_rng(0)
    data = bytes(rng.choice(np.frombuffer(b"abc \n\xc3\xa9", np.uint8), 3 << 20)) + b" " + b"z" * (2 << 20) + b" end"
    s, e, h = hashed_words(data)
    assert [data[a:b] for a, b in zip(s[:500], e[:500])] == data.split()[:500]
    assert len(s) == len(data.split())
    by = {}
    for a, b, x in zip(s.tolist(), e.tolist(), h.tolist()):
        by.setdefault(x, data[a:b] if b - a < 100 else (a, b))
    assert len(by) == len({w for w in data.split()})
    assert len(hashed_words(b"")[2]) == 0


# 1 WARC


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "<p>a</p>", "é" * 50_000, "<p>b</p>"]
    rows = [(i, f"http://x/{i}\r\nX: 1" if i else None, h) for i, h in enumerate(html, 10)] + [(None, "u", "<p>a</p>"), (10, None, "<p>a</p>")]
    got = warc.round_trip(spark, clash(spark.createDataFrame(rows, "page_id long, url string, html string")), with_payload=True).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = collections.Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        same = i == first[h or ""]
        want[(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if same else "revisit", None if same else first[h or ""])] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.payload.decode() == (dict((i, h) for i, _, h in rows)[r.page_id] or "") for r in got if r.record_type == "response")
    assert warc.round_trip(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_ranges_own_each_record_once():
    rng = random.Random(3)
    import gzip

    bodies = [rng.randbytes(rng.choice([0, 10, 40_000])) + b"\x1f\x8b\x08" * rng.randrange(3) for _ in range(40)]
    data = b"".join(gzip.compress(warc.page_record(i, "u", b, "D", None), rng.randrange(10), mtime=0) for i, b in enumerate(bodies))
    for step in (1, 777, 50_000, len(data)) if len(data) < 100_000 else (777, 50_000, len(data)):
        got = [x for lo in range(0, len(data), step) for x in warc.records_in_range(io.BytesIO(data), lo, min(lo + step, len(data)))]
        assert [int(h["x-page-id"]) for _, _, h, _ in got] == list(range(40))
        assert [b.partition(b"\r\n\r\n")[2] for *_, b in got] == bodies
    with pytest.raises(ValueError, match="cut off"):
        list(warc.records_in_range(io.BytesIO(data[:-20]), 0, len(data)))


# 2 line dedup


def brute_lines(rows, t=0.8):
    first, occ = {}, []
    for d, text in rows:
        if d is None or text is None:
            continue
        for i, line in enumerate(text.split("\n")):
            s = frozenset(line.split())
            if s:
                occ.append((d, i, s))
                first[s] = min(first.get(s, (d, i)), (d, i))
    best = dict(first)
    for x in first:
        for y in first:
            o = len(x & y)
            if o / (len(x) + len(y) - o) >= t - 1e-9:
                best[x] = min(best[x], first[y])
    gone = {(d, i) for d, i, s in occ if best[s] < (d, i)}
    out = {}
    for d, text in rows:
        if text is None:
            out[(d, text)] = (None, 0)
        else:
            kept = [x for i, x in enumerate(text.split("\n")) if (d, i) not in gone]
            out[(d, text)] = ("\n".join(kept), len(text.split("\n")) - len(kept))
    return out


def line_corpus():
    rng = random.Random(5)
    base = [words(rng, n, 60) for n in (1, 2, 3, 4, 5, 6, 9, 10, 20, 40) for _ in range(6)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w) + 1)
                w[k : k + rng.randrange(2)] = words(rng, rng.randrange(2), 60)
            rng.shuffle(w)
            lines.append(rng.choice([" ", "  ", "\t"]).join(w))
        rows.append((d, "\n".join(lines)))
    return [*rows, (100, None), (101, ""), (None, rows[3][1]), (102, "\n \n\n")]


def test_line_dedup_matches_brute_force(spark):
    rows = line_corpus()
    got = line_dedup.without_similar_lines(clash(frame(spark, rows))).select("doc_id", "text", "n_removed").collect()
    want = brute_lines(rows)
    assert sorted((str(r.doc_id), r.text, r.n_removed) if r.text is not None else (str(r.doc_id), "", 0) for r in got) == sorted(
        (str(d), w[0] if w[0] is not None else "", w[1]) for (d, _), w in want.items()
    )
    assert sum(r.n_removed for r in got) > 20


def test_line_dedup_many_near_copies(spark):
    rng = random.Random(2)
    base = words(rng, 30)
    rows = []
    for d in range(80):
        w = list(base)
        for _ in range(d % 4):
            w[rng.randrange(30)] = f"e{rng.randrange(9)}"
        rows.append((d, " ".join(w)))
    got = {r.doc_id: r.n_removed for r in line_dedup.without_similar_lines(frame(spark, rows)).collect()}
    assert got == {d: n for (d, _), (_, n) in brute_lines(rows).items()}


def test_line_dedup_edges(spark):
    assert line_dedup.without_similar_lines(frame(spark, [])).count() == 0
    twice = frame(spark, [(1, "a b"), (1, "a b"), (2, "a b\nc")])
    assert sorted((r.doc_id, r.text) for r in line_dedup.without_similar_lines(twice).collect()) == [(1, "a b"), (1, "a b"), (2, "c")]
    with pytest.raises(ValueError):
        line_dedup.similar_lines(twice, 0.5)


# 3 toxicity


def test_cumulative_link_recovers_order():
    rng = np.random.default_rng(0)
    n = 3000
    x = rng.random((n, 6)) < 0.4
    score = x @ np.array([2.0, -1.5, 1.0, 0, 0, 0])
    y = np.digitize(score + rng.logistic(size=n), [0.0, 2.0])
    rows, cols = np.nonzero(x)
    w, theta = toxicity.fit_cumulative_link(rows, cols, y, 6, 3, l2=0.1, steps=400)
    assert np.abs(w - [2, -1.5, 1, 0, 0, 0]).max() < 0.35 and np.abs(theta - [0, 2]).max() < 0.35
    assert (np.diff(theta) > 0).all()


def test_cumulative_link_gradient():
    """The fit ends where the numerical gradient of the penalised likelihood is near zero."""
    rng = np.random.default_rng(1)
    x = rng.random((400, 4)) < 0.5
    y = rng.integers(0, 3, 400)
    rows, cols = np.nonzero(x)
    w, theta = toxicity.fit_cumulative_link(rows, cols, y, 4, 3, l2=1.0, steps=1500)

    def loss(v):
        s = x @ v[:4]
        p = np.concatenate([np.zeros((400, 1)), 1 / (1 + np.exp(s[:, None] - v[None, 4:])), np.ones((400, 1))], axis=1)
        return -np.log(p[np.arange(400), y + 1] - p[np.arange(400), y]).sum() + 0.5 * (v[:4] ** 2).sum()

    v = np.concatenate([w, theta])
    grad = [(loss(v + e) - loss(v - e)) / 2e-5 for e in np.eye(6) * 1e-5]
    assert np.abs(grad).max() < 0.5


def test_toxicity_held_out(spark):
    """About 2,000 labelled rows to learn from, as many to judge by."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    even = labels.filter("doc_id % 2 = 0")
    got = {r.doc_id: r.severity for r in toxicity.graded(clash(docs), even).collect()}
    assert len(got) == docs.count()
    rest = labels.filter("doc_id % 2 = 1").collect()
    bad, good = [got[r.doc_id] for r in rest if r.toxic], [got[r.doc_id] for r in rest if not r.toxic]
    good = np.array(good)
    auc = np.mean([(b > good).mean() + 0.5 * (b == good).mean() for b in bad])
    assert auc > 0.95
    odd = frame(spark, [(1, None), (2, ""), (None, "x"), (3, "a " * 100_000)])
    assert toxicity.graded(odd, labels.limit(0)).select("severity").distinct().collect()[0][0] == 0
    assert toxicity.graded(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("sf, recall, precision", [("0.01", 0.6, 0.9), ("0.1", 0.9, 0.95)])
def test_toxic_flag_held_out(spark, sf, recall, precision):
    """Learned and set on the even labels, judged on the odd ones."""
    folder = f"/root/testdata/sf{sf}"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = {r.doc_id: r.toxic for r in toxicity.graded(docs, labels.filter("doc_id % 2 = 0")).collect()}
    flags = [(bool(r.toxic), got[r.doc_id]) for r in labels.filter("doc_id % 2 = 1 and toxic is not null").collect()]
    caught, bad, flagged = flags.count((True, True)), sum(t for t, _ in flags), sum(f for _, f in flags)
    assert caught / bad > recall and caught / flagged > precision


def test_unknown_toxic_has_no_grade(spark):
    labels = spark.createDataFrame([(1, 0, None), (2, 0, 1), (3, 1, 1), (4, 0, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.grade for r in toxicity.label_grades(labels).collect()} == {1: None, 2: 2, 3: 1, 4: 0, 5: 1}


def test_flag_threshold_has_best_f1():
    rng = np.random.default_rng(5)
    p, toxic = np.round(rng.random(200), 2), rng.random(200) < 0.2
    f1 = lambda c: 2 * ((p >= c) & toxic).sum() / ((p >= c).sum() + toxic.sum())
    assert f1(toxicity.flag_threshold(p, toxic)) == max(f1(c) for c in p)
    assert toxicity.flag_threshold(p, toxic & False) == 0.5


# 4 language


def test_bloom_filters_hold_all_and_count_chance():
    rng = np.random.default_rng(0)
    mine = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    cells = np.zeros(1 << 14, U64)
    for c in langid.places(mine, 1 << 14):
        cells[c] |= U64(1)
    f = langid.Filters(("xx", "yy"), cells)
    mask = np.bitwise_and.reduce([cells[c] for c in langid.places(mine, 1 << 14)])
    assert (mask & U64(1)).all()
    other = rng.integers(0, 2**63, 50_000, dtype=np.uint64)
    mask = np.bitwise_and.reduce([cells[c] for c in langid.places(other, 1 << 14)])
    assert abs((mask & U64(1)).mean() - f.chance()[0]) < 0.02 and f.chance()[1] == 0


def test_grams_in_blocks(monkeypatch):
    text = "Über die Brücke, 42 Wörter! " * 30
    whole = np.concatenate(list(langid.grams(text)))
    monkeypatch.setattr(langid, "_BLOCK", 17)
    assert (np.concatenate(list(langid.grams(text))) == whole).all()


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    odd = frame(spark, [(9001, None), (9002, ""), (9003, "123 ... !"), (9004, "é"), (None, "the of and")]).withColumn("lang", F.lit(None).cast("string"))
    rows = langid.identify(clash(docs.unionByName(odd)), columns=("doc_id", "lang")).collect()
    assert len(rows) == docs.count() + 5
    held = [r for r in rows if r.held_out and r.lang]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (9001, 9002, 9003)} == dict.fromkeys((9001, 9002, 9003), "und")
    assert all(0 <= r.score <= 1 for r in rows)
    assert next(r.lang_pred for r in rows if r.doc_id == 9004) != "und"
    assert {r.lang_pred for r in langid.identify(odd).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


# 5 decontamination


def brute_scores(passage, items):
    """BM25 of a passage's distinct words for single-part items, as a share of the item's own score."""
    n = len(items)
    df = collections.Counter(w for x in items for w in set(x))
    mean = sum(map(len, items)) / n
    out = {}
    for i, x in enumerate(items):
        tf = collections.Counter(x)
        imp = {w: np.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w, c in tf.items()}
        out[i] = sum(imp[w] for w in set(passage) if w in imp) / sum(imp.values())
    return out


def test_block_max_wand_finds_all_above_threshold():
    rng = random.Random(4)
    items = [[f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(5, 60))] for _ in range(70)]
    hashed = [decontaminate._hashes(" ".join(x)) for x in items]
    df = collections.Counter(w for x in hashed for w in set(x.tolist()))
    built = decontaminate.build(
        [{"item_id": i, "question": x, "answer": x[:0], "df": [df[w] for w in np.unique(x).tolist()]} for i, x in enumerate(hashed)], 70, sum(map(len, items)) / 70
    )
    for _ in range(60):
        passage = [f"w{rng.randrange(70)}" for _ in range(rng.randrange(3, 90))]
        at = np.flatnonzero(np.isin(built.words, decontaminate._hashes(" ".join(passage))))
        want = {i: s for i, s in brute_scores(passage, items).items() if s >= 0.5}
        got = decontaminate.block_max_wand([built.postings[k] for k in at.tolist()], 0.5) if len(at) else {}
        assert {built.part_item[p] for p in got} == set(want)
        assert all(abs(want[built.part_item[p]] - s) < 1e-9 for p, s in got.items())
        assert built.reachable(at, 0.5) or not want


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, rng.randrange(8, 50))) + ". " + " ".join(words(rng, rng.randrange(1, 6))) + ".") for i in range(40)]
    items += [(40, " ".join(words(rng, 200))), (41, None), (42, ""), (None, "x y z only here. Yes.")]
    noise = lambda: " ".join(words(rng, rng.randrange(0, 200)))
    docs, want = [], {}
    for d in range(60):
        held = rng.sample(range(41), rng.choice([0, 0, 1, 2]))
        docs.append((d, " ".join([noise(), *(f"{items[i][1].upper() if d % 2 else items[i][1]} {noise()}" for i in held)])))
        want[d] = sorted(held)
    docs += [(100, None), (101, ""), (102, items[3][1].split(".")[0] + " " + noise())]
    want |= {100: [], 101: [], 102: []}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(clash(frame(spark, docs)), clash(bench)).collect()
    assert {r.doc_id: sorted(x.item_id for x in r["items"]) for r in got} == want
    assert all(r.contaminated == bool(want[r.doc_id]) for r in got)
    small = [x for x in decontaminate.indexes(bench, index_bytes=2000)]
    assert len(small) > 2 and sum(len(x.item_ids) for x in small) == 42
    assert not decontaminate.contaminated(frame(spark, docs), bench.limit(0)).filter("contaminated").count()


# 6 fingerprints


def shingle_set(text, n=5):
    w = (text or "").lower().encode().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_fingerprints_of_edited_texts(spark):
    rows = corpus()
    got = fingerprints.edited_fingerprints(clash(frame(spark, rows)), k=64).collect()
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0)))
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    same = {}
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + nxt[:m]
        r = by[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r.near_edited), (nxt, r.near_next)):
            a, b = shingle_set(t), shingle_set(other)
            exact = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(near - exact) < (1e-9 if len(a | b) <= 64 else 0.3)
        same.setdefault(t, r.fingerprint)
        assert same[t] == r.fingerprint
    assert fingerprints.edited_fingerprints(frame(spark, [])).count() == 0
    alone = fingerprints.edited_fingerprints(frame(spark, [(7, "abc def ghi")])).collect()[0]
    assert alone.near_next == 1.0 and alone.n_chars == 11


def test_fingerprints_merge(spark):
    rng = random.Random(8)
    docs = [(i % 3, " ".join(words(rng, 400))) for i in range(30)]
    df = spark.createDataFrame([*docs, (3, None)], "g int, text string").select("g", fingerprints.fingerprint("text").alias("f"))
    got = {r.g: r.f for r in fingerprints.merged(df, ["g"], "f").collect()}
    for g in range(3):
        parts = [fingerprints.sketches([t])[0] for i, t in docs if i == g]
        whole = np.unique(np.concatenate([shingles(hashed_words(t.encode())[2], 5) for i, t in docs if i == g]))
        assert got[g] == fingerprints.packed(whole[: fingerprints.K])
        assert abs(fingerprints.distinct(fingerprints.unpacked(got[g])) / len(whole) - 1) < 0.35
        assert fingerprints.containment(parts[0], fingerprints.unpacked(got[g])) > 0.6
    assert got[3] == ""


# 7 MinHash


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 2**63, 300, dtype=np.uint64)
    x, y = rng.random(300) * 3, rng.random(300) * 3
    x[:40] = 0
    exact = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    k = 4000
    same = (minhash.signature(items, x, k) == minhash.signature(items, y, k)).mean()
    assert abs(same - exact) < 0.04
    assert (minhash.signature(items, x, 64) == minhash.signature(items[::-1], x[::-1], 64)).all()
    assert len(minhash.signature(items, x * 0, 64)) == 0
    assert len(minhash.signature(items[:1], np.array([0.01]), 16)) == 16


def classes_of(rows, t=0.8):
    rows = [(d, x) for d, x in rows if d is not None and x is not None]
    root = {d: d for d, _ in rows}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    sets = {d: shingle_set(x) for d, x in rows}
    texts = dict(rows)
    for a in texts:
        for b in texts:
            if a < b:
                u, v = sets[a], sets[b]
                if texts[a] == texts[b] or (u and v and len(u & v) / len(u | v) >= t):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {d: find(d) for d in texts}


def test_near_duplicates_match_brute_force(spark):
    rows = corpus(9, 80)
    got = minhash.near_duplicates(clash(frame(spark, rows))).collect()
    assert len(got) == len(rows)
    want = classes_of(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id in want} == want
    assert all(r.is_first == (r.class_id == r.doc_id) for r in got if r.doc_id is not None)
    assert [r.is_first for r in got if r.doc_id is None] == [True]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_through_chains(spark):
    """Each text is near the next only; all are one class."""
    base = [f"c{i}" for i in range(400)]
    rows = []
    for d in range(14):
        w = list(base)
        for i in range(d):
            w[i * 25 : i * 25 + 25] = [f"x{i}y{j}" for j in range(25)]
        rows.append((d, " ".join(w)))
    want = classes_of(rows)
    assert set(want.values()) == {0}
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(frame(spark, rows), bands=40, rows=4).collect()} == want


# 8 substrings


def brute_substrings(rows, window=50):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        if d is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        if d is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < d:
                    gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("group_rows", [20_000, 2])
def test_substrings_match_brute_force(spark, group_rows):
    rng = random.Random(12)
    rows = corpus(12, 50)
    rows += [(500 + i, " ".join(["again"] * (60 + i) + words(rng, 5) + rows[10][1].split()[3:90])) for i in range(4)]
    rows += [(500, "a b c"), (502, " ".join(["again"] * 70))]
    got = substring.without_repeats(clash(frame(spark, rows)), group_rows=group_rows).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute_substrings(rows)
    assert sum(r.n_removed for r in got) > 500


def test_substrings_of_nothing(spark):
    assert substring.without_repeats(frame(spark, [])).count() == 0


def test_suffix_tree_nodes():
    rng = random.Random(1)
    suffixes = [np.array([rng.randrange(1, 3) for _ in range(rng.randrange(1, 9))], U64) for _ in range(40)]
    tree = substring.SuffixTree(suffixes, 8)
    nodes = tree.nodes(np.arange(9))
    for depth in range(9):
        for i, a in enumerate(suffixes):
            assert (nodes[depth, i] < 0) == (len(a) < depth)
            for j, b in enumerate(suffixes):
                if len(a) >= depth and len(b) >= depth:
                    assert (nodes[depth, i] == nodes[depth, j]) == (a[:depth].tolist() == b[:depth].tolist())


# 9 SentencePiece

ODD = ["", "  a  b ", "▁x y", "a\n\n b\t", "<s> hi </s> <0x41>", "日本語 😀 \x00", "   ", "a▁b ▁▁c", "é" * 5000, " ", "word", "x" * 200_000]


def test_pieces_match_sentencepiece():
    import sentencepiece

    model = pieces.read_model()
    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab  é▁\n\tñ日.") for _ in range(rng.randrange(60))) for _ in range(400)]
    ids = pieces.encode(texts, model, verify=True)
    assert ids == own.encode(texts)
    assert pieces.decode(ids, model) == own.decode(ids)
    assert pieces._loaded(model).tokenizer.encode(texts[1]).ids == ids[1]


def test_unigram_pieces(tmp_path):
    """A hand-written unigram model with byte fallback."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    entries = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    entries += [("▁", -3.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("▁a", -3.5, 1), ("ab", -5.0, 1), ("▁ab", -6.0, 1), ("ba", -5.2, 1)]
    for piece, score, kind in entries:
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.trainer_spec.model_type = 1
    proto.trainer_spec.byte_fallback = True
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.escape_whitespaces = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    model = proto.SerializeToString()
    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(5)
    texts = ["".join(rng.choice("aab é") for _ in range(rng.randrange(30))) for _ in range(300)]
    assert pieces.encode(texts, model, verify=True) == own.encode(texts)


def test_token_ids(spark):
    import sentencepiece

    model = pieces.read_model()
    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    rows = list(enumerate([*ODD, None]))
    got = pieces.token_ids(clash(frame(spark, rows)), model).collect()
    for r in got:
        text = rows[r.doc_id][1] or ""
        ids = own.encode(text)
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids).encode()).hexdigest()
        assert r.round_trip == ("▁" not in text)
    assert pieces.token_ids(frame(spark, []), model).count() == 0


def test_parity_is_enforced():
    backend = pieces._loaded(pieces.read_model())
    assert backend.differ(["abc"], [[1, 2]]) == ["abc"]
    with pytest.raises(ValueError, match="otherwise"):
        backend.check(["abc"])


# 10 sharding


def test_shards_are_even_and_whole(spark):
    rng = random.Random(7)
    rows = [(i, "x" * rng.randrange(400) + "é" * rng.randrange(3), rng.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 7}", None) for i in range(1500)]
    rows += [(5000 + i, "copy " * 60, "en", "hot", None) for i in range(700)] + [(9000, None, None, None, None), (None, "", "en", "a", None)]
    df = spark.createDataFrame(rows, DOCS)
    dims = [F.length("text"), sharding.code(F.col("lang")), sharding.code(F.col("source"))]
    got = sharding.kd_shards(clash(df), dims, shards=16).collect()
    assert len(got) == len(rows)
    size, slots = collections.Counter(), collections.defaultdict(list)
    texts = {i: t or "" for i, t, *_ in rows}
    for r in got:
        assert r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        size[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert set(size) == set(range(16))
    assert max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 16 + 4 * 405
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = sharding.kd_shards(df, dims, target_bytes=sum(size.values()) // 5).collect()
    assert len({r.shard for r in by}) in (5, 6)


def test_shards_of_little(spark):
    dims = [F.length("text")]
    assert sharding.kd_shards(frame(spark, []), dims, shards=4).count() == 0
    got = sharding.kd_shards(frame(spark, [(1, "a"), (1, "a"), (2, "b")]), dims, shards=4).collect()
    assert len(got) == 3 and all(0 <= r.shard < 4 for r in got)


def test_decoding_matches_sentencepiece():
    import pyarrow.parquet as pq
    import sentencepiece

    model = pieces.read_model()
    own = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t]
    texts += ["", " a  b ", "Über \U0001f600 日本語\n\ttab", "x" * 500]
    ids = [own.encode(t) for t in texts]
    assert pieces.decode(ids, model) == [own.decode(x) for x in ids]
