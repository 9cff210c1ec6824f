"""Registered queries: span location (D14-D18) and evidence pages."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from spanlake.operators import blocks, lexical, locate
from spanlake.operators.fusion import SearchIndex
from spanlake.plans import fixtures as fx
from spanlake.plans.fixtures import oracle

PAIRS = 3  # located hits per query: the top of each keyword ranking; the queries named _all locate every hit (0)


def _pairs(spark, sf, k):
    docs = fx.docs(spark, sf)
    index = blocks.build_blocks(docs)
    q = fx.queries(spark, sf)
    return q, index, lexical.bm25_search(q, index, k).select("query_id", "chunk_id"), docs


def locate_passage(spark, sf, k=PAIRS):
    q, index, pairs, docs = _pairs(spark, sf, k)
    win, _ = locate.locate_passage(pairs, locate.query_weights(q, index), contents=docs)
    return win.select("query_id", "chunk_id", "win_start", "win_end", F.round("score", 6).alias("score"))


def locate_passage_sentences(spark, sf, k=PAIRS):
    q, index, pairs, docs = _pairs(spark, sf, k)
    _, scores = locate.locate_passage(pairs, locate.query_weights(q, index), contents=docs)
    return scores.select("query_id", "chunk_id", "sent", "start", "end", "score")


def locate_window(spark, sf, k=PAIRS):
    q, index, pairs, docs = _pairs(spark, sf, k)
    win = locate.locate_window(pairs, locate.query_weights(q, index), contents=docs)
    return win.select("query_id", "chunk_id", "win_start", "win_end", F.round("score", 6).alias("score"))


def semantic_locate(spark, sf, k=PAIRS):
    q, _, pairs, docs = _pairs(spark, sf, k)
    win, _ = locate.semantic_locate(pairs, q, contents=docs)
    return win.select("query_id", "chunk_id", "win_start", "win_end", F.round("score", 5).alias("score"))


def multi_span_snippet(spark, sf, k=PAIRS):
    q, index, pairs, docs = _pairs(spark, sf, k)
    _, scores = locate.locate_passage(pairs, locate.query_weights(q, index), max_window=1 << 20, contents=docs)
    return locate.multi_span_groups(scores, budget=900, together=True).select(
        "query_id", "chunk_id", "ord", "start", "end", "score", "focus"
    )


def find_evidence(spark, sf):
    chunks = fx.live(spark, sf)
    out = locate.find_evidence(fx.queries_with_vec(spark, sf), SearchIndex(chunks), chunks, page=2)
    return out.select(
        "query_id", "rank", "chunk_id", "match", "how", "focus_start", "focus_end", "snippet", "total", "page",
        F.round("score_norm", 6).alias("score_norm"),
    )


QUERIES = {
    "locate_passage": locate_passage,
    "locate_passage_sentences": locate_passage_sentences,
    "locate_window": locate_window,
    "semantic_locate": semantic_locate,
    "multi_span_snippet": multi_span_snippet,
    "find_evidence": find_evidence,
}
_LOCATED = [n for n in QUERIES if n != "find_evidence"]
QUERIES |= {f"{n}_all": partial(QUERIES[n], k=0) for n in _LOCATED}


def _pairs_sql(k: int) -> dict:
    return {"pairs": (("bm_ranked",), "SELECT query_id, chunk_id FROM bm_ranked" + (f" WHERE rank <= {k}" if k else ""))}


_BASE = {
    "wts": (
        ("qt", "dfs", "dstat"),
        "SELECT query_id, term, ln((n_docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1.0) AS w FROM qt LEFT JOIN dfs USING (term), dstat",
    ),
    # a sentence starts at the first non-blank character after the previous boundary
    "bounds": (
        ("docs",),
        r"""SELECT chunk_id, i - 1 AS k, e - length(p) AS a, e, p FROM (SELECT chunk_id, p, i, sum(length(p)) OVER (PARTITION BY chunk_id ORDER BY i) AS e FROM (
        SELECT chunk_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT chunk_id, string_split(regexp_replace(content, '([.!?])([ \n\t])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM docs)))""",
    ),
    "sent": (
        ("bounds",),
        rf"""SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY k) - 1 AS sent, (a + length(p) - length(regexp_replace(p, '^{fx.WS_SQL}+', '')))::INT AS s, e::INT AS e
        FROM bounds WHERE regexp_matches(p, '{fx.NON_WS_SQL}')""",
    ),
    "hit": (
        ("pairs", "toks", "wts"),
        "SELECT p.query_id, p.chunk_id, t.s, t.e, w.w FROM pairs p JOIN toks t USING (chunk_id) JOIN wts w ON w.query_id = p.query_id AND w.term = t.term",
    ),
    # a sentence's terms once, however many queries ask for them
    "tsent": (
        ("toks", "sent"),
        "SELECT t.chunk_id, x.sent, t.term, count(*) AS n FROM toks t ASOF JOIN sent x ON x.chunk_id = t.chunk_id AND t.s >= x.s WHERE t.s < x.e GROUP BY ALL",
    ),
    "rawsc": (
        ("tsent", "wts", "pairs"),
        "SELECT w.query_id, t.chunk_id, t.sent, sum(t.n * w.w) AS raw FROM tsent t JOIN wts w USING (term) SEMI JOIN pairs p ON p.query_id = w.query_id AND p.chunk_id = t.chunk_id GROUP BY ALL",
    ),
    "bestsc": (
        ("rawsc",),
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY round(raw, 9) DESC, sent) AS r FROM rawsc) WHERE r = 1 AND raw > 0",
    ),
}


def _bounded(max_w: int, k: int) -> dict:
    return {
        **_BASE,
        **_pairs_sql(k),
        "okb": (
            ("bestsc", "sent"),
            f"SELECT b.query_id, b.chunk_id, b.sent, b.raw, s.s, s.e FROM bestsc b JOIN sent s USING (chunk_id, sent) WHERE s.e - s.s <= {max_w}",
        ),
        "scores": (
            ("okb", "sent", "rawsc"),
            """SELECT o.query_id, o.chunk_id, s.sent, s.s, s.e, round(coalesce(r.raw, 0) / o.raw, 9) AS score FROM okb o JOIN sent s USING (chunk_id)
            LEFT JOIN rawsc r ON r.query_id = o.query_id AND r.chunk_id = o.chunk_id AND r.sent = s.sent""",
        ),
    }


def _oracles(k: int) -> dict[str, str]:
    return {
        "locate_passage": oracle(
            """SELECT query_id, chunk_id, CASE WHEN coalesce(w1 + o.s - p.s <= 240, false) THEN p.s ELSE o.s END AS win_start, CASE WHEN tn THEN ne ELSE oe END AS win_end, round(raw, 6) AS score
        FROM (SELECT o.query_id, o.chunk_id, o.sent, o.raw, o.s, o.e AS oe, n.e AS ne, coalesce(n.e - o.s <= 240, false) AS tn, CASE WHEN coalesce(n.e - o.s <= 240, false) THEN n.e - o.s ELSE o.e - o.s END AS w1
        FROM okb o LEFT JOIN sent n ON n.chunk_id = o.chunk_id AND n.sent = o.sent + 1) o LEFT JOIN (SELECT chunk_id, sent + 1 AS sent, s FROM sent) p USING (chunk_id, sent)""",
            "okb",
            extra=_bounded(240, k),
        ),
        "locate_passage_sentences": oracle(
            'SELECT query_id, chunk_id, sent, s AS "start", e AS "end", score FROM scores', "scores", extra=_bounded(240, k)
        ),
        "locate_window": oracle(
            """SELECT query_id, chunk_id, CASE WHEN s < e THEN s ELSE ws END AS win_start, CASE WHEN s < e THEN e ELSE we END AS win_end, round(sum, 6) AS score FROM (
        SELECT p.query_id, p.chunk_id, ws, we, sum, coalesce(max(CASE WHEN t.s < ws AND t.e > ws THEN t.e END), min(ws)) AS s, coalesce(min(CASE WHEN t.s < we AND t.e > we THEN t.s END), min(we)) AS e
        FROM (SELECT query_id, chunk_id, sum, greatest(st - greatest(240 - (last - st), 0) // 2, 0) AS ws, least(last + greatest(240 - (last - st), 0) - greatest(240 - (last - st), 0) // 2, total) AS we
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY round(sum, 9) DESC, st) AS r FROM (
        SELECT a.query_id, a.chunk_id, a.s AS st, sum(b.w) AS sum, max(b.e) AS last FROM hit a JOIN hit b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND b.s >= a.s AND b.e - a.s <= 240 GROUP BY ALL))
        JOIN (SELECT chunk_id, max(e) AS total FROM toks GROUP BY chunk_id) USING (chunk_id) WHERE r = 1) p JOIN toks t USING (chunk_id) GROUP BY ALL)""",
            "hit",
            "toks",
            extra=_BASE | _pairs_sql(k),
        ),
        "multi_span_snippet": oracle(
            """SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY s) AS ord, s AS "start", e AS "end", score, r = 1 AS focus FROM (
        SELECT *, max(width) OVER (PARTITION BY query_id, chunk_id) AS total FROM (SELECT *, max(CASE WHEN r = 3 THEN width END) OVER (PARTITION BY query_id, chunk_id) AS w3 FROM (
        SELECT *, count(*) OVER (PARTITION BY query_id, chunk_id) AS n, sum(e - s + 3) OVER (PARTITION BY query_id, chunk_id ORDER BY r) AS width FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY round(score, 9) DESC, s) AS r FROM (
        SELECT query_id, chunk_id, min(s) AS s, max(e) AS e, max(score) AS score FROM (SELECT *, sent - row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY sent) AS isl FROM scores WHERE score >= 0.5) GROUP BY query_id, chunk_id, isl)) WHERE r <= 3))
        WHERE n >= 2 AND r <= CASE WHEN w3 <= 900 THEN 3 ELSE 2 END) WHERE total <= 900""",
            "scores",
            extra=_bounded(1 << 20, k),
        ),
    }


ORACLES = _oracles(PAIRS) | {f"{n}_all": text for n, text in _oracles(0).items()}
