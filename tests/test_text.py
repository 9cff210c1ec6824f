import pytest
from pyspark.sql import functions as F

from spanlake.functions import conditions, text as tx, vectors as vx
from spanlake.operators import transcripts as tr


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("x")).first()["x"]


def test_tokens_lower_case_and_split(spark):
    assert one(spark, "Hello, World! É-t test-123.", tx.tokenize("t")) == ["hello", "world", "é", "t", "test", "123"]


def test_token_spans_slice_back(spark):
    t = "Ça va. 𝒳y naïve!"
    spans = one(spark, t, tx.tokenize_spans("t"))
    assert [t[s.start : s.end].lower() for s in spans] == [s.term for s in spans]
    assert [s.sent for s in spans][0] == 0 and spans[-1].sent == 1


def test_label_terms(spark):
    assert one(spark, "The ab abc 2024 x9y yeah océan", tx.terms_tfidf("t")) == ["abc", "x9y", "océan"]


def test_sentences_and_paragraphs(spark):
    t = "One  two. Three!\r\n\r\nFour\nfive? six"
    assert one(spark, t, tx.sentences("t")) == ["One two.", "Three!", "Four five?", "six"]
    assert one(spark, "  \n \n ", tx.sentences("t")) == []


def test_first_sentences(spark):
    assert one(spark, "A b.  C d! E", tx.first_sentences("t", 2)) == "A b. C d!"
    assert one(spark, "A b. C d", tx.first_sentences("t", 2)) == "A b."
    long = "word " * 100
    assert one(spark, long, tx.first_sentences("t", 2)) == ("word " * 56).strip()[:280].strip() + "…"
    assert one(spark, "no end", tx.first_sentences("t", 2)) == "no end"


def test_passages_overlap_and_end(spark):
    t = " ".join(f"w{i}" for i in range(200))
    ps = one(spark, t, tx.chunk_passages("t"))
    assert ps[0].start == 0 and ps[-1].end == len(t)
    assert all(t[p.start : p.end] == p.text for p in ps)
    assert all(a.end > b.start for a, b in zip(ps, ps[1:]))
    assert [p.text.split()[0] for p in ps] == ["w0", "w40", "w80", "w120", "w160"]


def test_query_cleaning(spark):
    assert one(spark, "I really think the Cats like CATS and dogs", tx.clean_query("t")) == "cats dogs"
    assert one(spark, "  so it is ", tx.clean_query("t")) == "so it is"


def test_query_variants(spark):
    v = one(spark, "The cat", tx.query_variants(F.col("t"), F.lit("body"), F.lit("Animals")))
    assert v == ["The cat", "cat", "The cat body", "Animals The cat"]
    assert one(spark, " ", tx.query_variants(F.col("t"), F.lit("b"), F.lit("p"))) == []
    cut = one(spark, "x", tx.query_variants(F.col("t"), F.lit("é" * 150), F.lit("")))[1]
    assert cut == "x " + "é" * 100


def test_labels(spark):
    assert one(spark, "océan · wind ßa", tx.title_case("t")) == "Océan · Wind ßa"
    assert one(spark, "A_b C!é", tx.slugify("t")) == "a-b-c"
    assert one(spark, "a" * 81, tx.preview_text("t", 80)) == "a" * 80 + "…"


@pytest.mark.parametrize(
    "sel,span",
    [("beta gamma", (6, 16)), ("beta  \n gamma", (6, 16)), (" gamma\tdelta ", (11, 24)), ("zeta", None), ("", None), ("a\\E.b", None)],
)
def test_locate_selection(spark, sel, span):
    content = "alpha beta gamma \n  delta"
    content = "alpha beta gamma  \ndelta" if span == (11, 24) else content
    got = one(spark, content, tx.locate_selection(F.col("t"), F.lit(sel)))
    assert (got and (got.start, got.end)) == span


def test_snippet_segments(spark):
    hits = F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("end")), F.struct(F.lit(4).alias("start"), F.lit(6).alias("end")))
    segs = one(spark, "0123456789", tx.snippet_segments(F.col("t"), F.lit(1), F.lit(9), hits))
    assert [(s.text, s.mark) for s in segs] == [("…", False), ("1", False), ("234", True), ("5", True), ("678", False), ("…", False)]


def test_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0]), ([1.0, 1.0], [-2.0, -2.0])], "a array<float>, b array<float>")
    got = [r[0] for r in rows.select(vx.cosine("a", "b")).collect()]
    assert got == pytest.approx([0, 0, 0, -1])
    blob = rows.select(vx.encode_vec("a").alias("x")).first()["x"]
    assert bytes(blob) == b"\x00\x00\x80?\x00\x00\x00\x00"
    e = spark.createDataFrame([("same words",), ("same words",), ("other",)], "t string").select(vx.stub_embed("t", 16).alias("v")).collect()
    assert e[0].v == e[1].v != e[2].v


@pytest.mark.parametrize(
    "cond,want",
    [("", True), ("has_read(n1)", True), ("!has_read( n1 )", False), ("has_read(n2)", False), ("audience==EXPERT", True),
     ("audience!= expert", False), ("label.k==v", True), ("label.k==w", False), ("label.none==", True), ("label.k=v", True), ("what", True)],
)
def test_conditions(spark, cond, want):
    got = one(spark, cond, conditions.eval_condition(F.col("t"), F.lit("Expert"), F.array(F.lit("n1")), F.create_map(F.lit("k"), F.lit("v"))))
    assert got is want


def greedy(sents, target):
    out, part, n, pos = [], [], 0, 0
    for i, s in enumerate(sents):
        part.append(s)
        n += len(s.split())
        if n >= target or i == len(sents) - 1:
            c = " ".join(part)
            out.append((c, pos, pos + len(c.encode())))
            pos += len(c.encode()) + 1
            part, n = [], 0
    return out


def test_chunking_forty_by_ten(spark):
    raw = " ".join(" ".join(["word"] * 9) + f" end{i}." for i in range(40))
    got = tr.chunk_raw(spark.createDataFrame([("f", raw)], "source_file string, raw string")).orderBy("start_offset").collect()
    assert len(got) == 3 and all(a.end_offset < b.start_offset for a, b in zip(got, got[1:]))


@pytest.mark.parametrize("block", [3, 7])
def test_chunking_hot_source_in_blocks(spark, block):
    """A source of many blocks, cut in parallel, equals the sequential rule; so do short sources."""
    import random

    rnd = random.Random(block)
    texts = {"hot": [" ".join(["é"] * rnd.randint(1, 9)) for _ in range(700)], "s1": ["a b", "c"], "s2": ["x " * 30]}
    texts["s2"] = ["x"] * 45
    rows = [(k, i, t) for k, ts in texts.items() for i, t in enumerate(ts)]
    rnd.shuffle(rows)
    got = tr.chunk_transcript(spark.createDataFrame(rows, "source_file string, ord int, text string"), target=20, block=block)
    want = sorted((k, *c) for k, ts in texts.items() for c in greedy(ts, 20))
    assert sorted((r.source_file, r.content, r.start_offset, r.end_offset) for r in got.collect()) == want
