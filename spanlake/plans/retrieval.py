"""Registered queries: retrieval (D1-D19)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from spanlake.operators import blocks, fusion, lexical, paging
from spanlake.operators.vectors import rank_regions, vector_search, vector_search_ann
from spanlake.plans import fixtures as fx
from spanlake.plans.fixtures import oracle

LIMIT = 10
SCAN = 3  # the reference looks at the best 3k passages only; the queries named _all look at every one


def _r(col: str, places: int = 6):
    return F.round(col, places).alias(col)


def build_bm25(spark, sf):
    index = lexical.build_bm25(fx.docs(spark, sf))
    return index.postings


def bm25_search(spark, sf):
    index = blocks.build_blocks(fx.docs(spark, sf))
    return lexical.bm25_search(fx.queries(spark, sf), index, LIMIT).select("query_id", "chunk_id", "rank", _r("score"))


def idf(spark, sf):
    index = blocks.build_blocks(fx.docs(spark, sf))
    terms = fx.queries(spark, sf).select(F.explode(F.split("text", " ")).alias("term"))
    return lexical.idf(terms, index).select("term", "df", _r("idf"))


def upsert_bm25(spark, sf):
    """Documents labelled good are re-added in upper case behind a new word; toxic ones are deleted."""
    d = fx.table(spark, sf, "documents")
    lab = fx.table(spark, sf, "labels")
    key = fx.chunk_key(F.col("doc_id")).alias("chunk_id")
    index = lexical.build_bm25(fx.docs(spark, sf))
    changed = d.join(lab.filter("quality = 1 and toxic = 0"), "doc_id", "left_semi").select(
        key, F.concat(F.lit("Revised "), F.upper("lang")).alias("content")
    )
    deleted = lab.filter("toxic = 1").select(key)
    out = lexical.upsert_bm25(index, changed, deleted)
    return (
        out.postings.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))
        .crossJoin(F.broadcast(out.stats))
        .select("term", "df", "tf", "n_docs", _r("avg_dl"))
    )


def _passage(scan):
    def run(spark, sf):
        index = blocks.build_passage_blocks(fx.docs(spark, sf))
        return lexical.passage_search(fx.queries(spark, sf), index, LIMIT, scan_factor=scan).select(
            "query_id", "chunk_id", "start", "end", "rank", _r("score")
        )

    return run


def vector_search_q(spark, sf):
    return vector_search(
        fx.queries_with_vec(spark, sf), fx.vectors(spark, sf), LIMIT
    ).select("query_id", "chunk_id", "rank", _r("score"))


def vector_search_ann_q(spark, sf):
    return vector_search_ann(
        fx.queries_with_vec(spark, sf), fx.vectors(spark, sf), LIMIT
    ).select("query_id", "chunk_id", "rank", _r("score"))


def _index(spark, sf):
    return fusion.SearchIndex(fx.docs_with_vec(spark, sf))


def rrf_fuse_arms(spark, sf, scan=SCAN):
    idx, q = _index(spark, sf), fx.queries_with_vec(spark, sf)
    return fusion.rrf_fuse_arms(
        lexical.bm25_search(q, idx.keyword, 20),
        lexical.passage_search(q, idx.passages, 20, scan_factor=scan),
        vector_search(q, idx.chunks, 20),
    ).select("query_id", "chunk_id", "start", "end", _r("bm25", 8), _r("vector", 8), _r("score", 8))


def rrf_fuse_lists(spark, sf):
    idx, q = _index(spark, sf), fx.queries_with_vec(spark, sf)
    lists = (
        lexical.bm25_search(q, idx.keyword, 20).select("query_id", "chunk_id", "rank", F.lit("k").alias("list_id"))
    ).unionByName(
        vector_search(q, idx.chunks, 20).select("query_id", "chunk_id", "rank", F.lit("v").alias("list_id"))
    )
    return fusion.rrf_fuse_lists(lists).select("query_id", "chunk_id", _r("score", 8))


def _hybrid(mode, scan=SCAN):
    def run(spark, sf):
        return fusion.hybrid_search(
            fx.queries_with_vec(spark, sf), _index(spark, sf), mode=mode, limit=LIMIT, scan_factor=scan
        ).select("query_id", "chunk_id", "rank", "start", "end", _r("score", 8))

    return run


def match_kind(spark, sf):
    hits = fusion.hybrid_search(fx.queries_with_vec(spark, sf), _index(spark, sf), limit=0)
    return hits.groupBy("query_id", fusion.match_kind(F.col("bm25"), F.col("vector")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.min("rank").alias("best_rank")
    )


def ranked_page(spark, sf):
    """Page and size vary with the query; the pool is the whole keyword ranking."""
    pool = lexical.bm25_search(fx.queries(spark, sf), blocks.build_blocks(fx.docs(spark, sf)), 0)
    req = fx.queries(spark, sf).select(
        "query_id",
        (F.col("query_id") % 9).cast("int").alias("page"),
        (F.col("query_id") * 3 - 5).cast("int").alias("page_size"),
    )
    return fusion.ranked_page(pool, req).select(
        "query_id", "chunk_id", "rank", "total", "page", "page_size", "pages", _r("score_norm")
    )


def hybrid_page(spark, sf):
    """Pages of the fused ranking of all matches; page and size vary with the query."""
    req = fx.queries(spark, sf).select(
        "query_id", (F.col("query_id") % 9).cast("int").alias("page"), (F.col("query_id") * 3 - 5).cast("int").alias("page_size")
    )
    return paging.hybrid_page(fx.queries_with_vec(spark, sf), _index(spark, sf), req).select(
        "query_id", "chunk_id", "rank", "total", "page", "page_size", "pages", "start", "end", _r("score", 8), _r("score_norm")
    )


def _bullets(spark, sf):
    """Benchmark texts as nodes: first sentence-like piece as title, the rest as body."""
    q = fx.queries_with_vec(spark, sf)
    return q.select(
        F.col("query_id").alias("node_id"),
        F.substring("text", 1, 60).alias("title"),
        F.expr("substring(text, 61)").alias("body"),
        F.when(F.col("query_id") % 2 == 0, F.substring("text", 100, 30)).otherwise("").alias("parent_title"),
        "vec",
    )


def suggest(spark, sf, scan=SCAN):
    nodes = _bullets(spark, sf)
    used = fx.queries(spark, sf).select(
        F.col("query_id").alias("node_id"), fx.chunk_key(F.col("query_id")).alias("chunk_id")
    )
    return fusion.suggest(nodes, _index(spark, sf), used, limit=5, scan_factor=scan).select(
        "node_id", "rank", "chunk_id", "label", _r("score", 8), _r("confidence", 6)
    )


def context_check(spark, sf, scan=SCAN):
    nodes = _bullets(spark, sf).withColumn(
        "parent_title", F.when(F.col("node_id") % 5 == 0, "").otherwise(F.col("title"))
    )
    mine = fx.table(spark, sf, "labels").select(
        (F.col("doc_id") % 40).alias("node_id"), fx.chunk_key(F.col("doc_id")).alias("chunk_id")
    )
    return fusion.context_check(nodes, mine, _index(spark, sf), scan_factor=scan).select("node_id", _r("score"), "in_context", "message")


def rank_regions_q(spark, sf):
    from spanlake.operators.cluster import centroids

    regions = centroids(fx.members(spark, sf), "region_id").select("region_id", F.col("centroid").alias("digest_vec"))
    return rank_regions(fx.queries_with_vec(spark, sf), regions, 5).select("query_id", "region_id", "rank", _r("score", 5))


QUERIES = {
    "build_bm25": build_bm25,
    "bm25_search": bm25_search,
    "idf": idf,
    "upsert_bm25": upsert_bm25,
    "passage_search": _passage(SCAN),
    "passage_search_all": _passage(None),
    "vector_search": vector_search_q,
    "vector_search_ann": vector_search_ann_q,
    "rrf_fuse_arms": rrf_fuse_arms,
    "rrf_fuse_arms_all": partial(rrf_fuse_arms, scan=None),
    "rrf_fuse_lists": rrf_fuse_lists,
    "match_kind": match_kind,
    "hybrid_search": _hybrid("hybrid"),
    "hybrid_search_all": _hybrid("hybrid", None),
    "hybrid_search_keyword": _hybrid("keyword"),
    "hybrid_search_keyword_all": _hybrid("keyword", None),
    "hybrid_search_semantic": _hybrid("semantic"),
    "ranked_page": ranked_page,
    "hybrid_page": hybrid_page,
    "suggest": suggest,
    "suggest_all": partial(suggest, scan=None),
    "context_check": context_check,
    "context_check_all": partial(context_check, scan=None),
    "rank_regions": rank_regions_q,
}

_NODE_Q = r"""
nodesq AS (SELECT item_id AS node_id, substring(text, 1, 60) AS title, substring(text, 61) AS body,
  CASE WHEN item_id % 2 = 0 THEN substring(text, 100, 30) ELSE '' END AS parent_title FROM benchmark)
"""


def _hybrid_sql(mode: str, scan: int | None = SCAN) -> str:
    return oracle(
        "SELECT query_id, chunk_id, rank, s AS \"start\", e AS \"end\", round(score, 8) AS score FROM pool",
        "pool",
        extra=fused_extra(mode, scan=scan),
    )


def fused_extra(mode: str = "hybrid", limit: int = LIMIT, scan: int | None = SCAN):
    return fx.fused_sql(limit, mode, scan=scan)


def _suggest_sql(scan: int | None = SCAN) -> str:
    from spanlake.functions.wordlists import QUERY_STOP_WORDS, SUGGESTION_SUFFIXES

    stop = fx._quoted(QUERY_STOP_WORDS)
    suffixes = fx._quoted(SUGGESTION_SUFFIXES)
    trim = lambda c: f"regexp_replace({c}, '^{fx.WS_SQL}+|{fx.WS_SQL}+$', '', 'g')"
    extra = {
        "nodesq": (
            (),
            f"""SELECT item_id AS node_id, {trim('substring(text, 1, 60)')} AS t, substring(text, 1, 60) AS title, {trim('substring(text, 61)')} AS b,
            {trim("CASE WHEN item_id % 2 = 0 THEN substring(text, 100, 30) ELSE '' END")} AS p FROM benchmark""",
        ),
        "kwq": (
            ("nodesq",),
            f"""SELECT *, array_to_string(list_filter(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{Nd}}]+'), lambda x: x NOT IN ({stop})), ' ') AS kw FROM nodesq""",
        ),
        "variants": (
            ("kwq",),
            """SELECT node_id, unnest(v) AS text, generate_subscripts(v, 1) - 1 AS variant FROM (SELECT node_id, list_filter([t,
            CASE WHEN kw <> t AND kw <> '' THEN kw END,
            CASE WHEN b <> '' THEN t || ' ' || CASE WHEN strlen(b) <= 200 THEN b ELSE substring(b, 1, list_max(list_filter(range(1, 201), lambda i: strlen(substring(b, 1, i)) <= 200))) END END,
            CASE WHEN p <> '' THEN p || ' ' || t END], lambda x: x IS NOT NULL) AS v FROM kwq WHERE t <> '')""",
        ),
        "q": (("variants",), "SELECT node_id || '#' || variant AS query_id, text FROM variants"),
        "qv": (
            ("variants",),
            "SELECT node_id || '#' || variant AS query_id, embedding::DOUBLE[] AS vec FROM variants JOIN embeddings ON vec_id = node_id",
        ),
        **fx.fused_sql(10, scan=scan),
    }
    return oracle(
        f"""SELECT node_id, rank, chunk_id, trim(title) || ' — ' || ([{suffixes}])[((rank - 1) % 5 + 1)::INT] AS label, round(score, 8) AS score,
        round(score / first_value(score) OVER (PARTITION BY node_id ORDER BY rank), 6) AS confidence FROM (
        SELECT node_id, chunk_id, score, row_number() OVER (PARTITION BY node_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (
        SELECT split_part(query_id, '#', 1)::BIGINT AS node_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM pool GROUP BY ALL)
        WHERE chunk_id <> 'd' || lpad(node_id::VARCHAR, 8, '0')) JOIN nodesq USING (node_id) WHERE rank <= 5""",
        "pool",
        "nodesq",
        extra=extra,
    )


def _context_sql(scan: int | None = SCAN) -> str:
    extra = {
        "q": ((), "SELECT item_id AS query_id, substring(text, 1, 60) AS text FROM benchmark WHERE item_id % 5 <> 0"),
        "qv": (
            (),
            "SELECT item_id AS query_id, embedding::DOUBLE[] AS vec FROM benchmark JOIN embeddings ON vec_id = item_id WHERE item_id % 5 <> 0",
        ),
        **fx.fused_sql(50, scan=scan),
    }
    return oracle(
        """SELECT item_id AS node_id, round(coalesce(sc, 1.0), 6) AS score, coalesce(sc, 1.0) >= 0.3 AS in_context,
        CASE WHEN coalesce(sc, 1.0) >= 0.3 THEN '' ELSE 'Out of Context' END AS message
        FROM benchmark LEFT JOIN (SELECT l.nid, avg(coalesce(p.score / t.top, 0.0)) AS sc FROM (SELECT doc_id % 40 AS nid, 'd' || lpad(doc_id::VARCHAR, 8, '0') AS chunk_id FROM labels) l
        JOIN q ON q.query_id = l.nid LEFT JOIN pool p ON p.query_id = l.nid AND p.chunk_id = l.chunk_id
        LEFT JOIN (SELECT query_id, max(score) AS top FROM pool GROUP BY query_id) t ON t.query_id = l.nid GROUP BY l.nid) ON nid = item_id""",
        "pool",
        "q",
        extra=extra,
    )


ORACLES = {
    "build_bm25": oracle("SELECT term, chunk_id, tf, dl FROM post", "post"),
    "bm25_search": oracle(
        f"SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm_ranked WHERE rank <= {LIMIT}", "bm_ranked"
    ),
    "idf": oracle(
        """SELECT term, coalesce(df, 0) AS df, round(ln((n_docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5) + 1.0), 6) AS idf
        FROM (SELECT DISTINCT lower(unnest(string_split(text, ' '))) AS term FROM q) LEFT JOIN dfs USING (term), dstat""",
        "q",
        "dfs",
        "dstat",
    ),
    "upsert_bm25": oracle(
        "SELECT term, df, t AS tf, n_docs, round(avg_dl, 6) AS avg_dl FROM (SELECT term, count(*) AS df, sum(tf) AS t FROM post GROUP BY term), dstat",
        "post",
        "dstat",
        extra={
            "docs": (
                (),
                """SELECT 'd' || lpad(d.doc_id::VARCHAR, 8, '0') AS chunk_id,
                CASE WHEN l.quality = 1 THEN 'Revised ' || upper(lang) ELSE text END AS content
                FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0""",
            )
        },
    ),
    "passage_search": oracle(
        "SELECT query_id, chunk_id, s AS \"start\", e AS \"end\", rank, round(score, 6) AS score FROM parm",
        "parm",
        extra={"parm": fx.passage_arm_sql(LIMIT)},
    ),
    "passage_search_all": oracle(
        "SELECT query_id, chunk_id, s AS \"start\", e AS \"end\", rank, round(score, 6) AS score FROM parm",
        "parm",
        extra={"parm": fx.passage_arm_sql(LIMIT, None)},
    ),
    "vector_search": oracle(
        f"SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM vec_ranked WHERE rank <= {LIMIT}", "vec_ranked"
    ),
    "rrf_fuse_arms": oracle(
        "SELECT query_id, chunk_id, s AS \"start\", e AS \"end\", round(bm25, 8) AS bm25, round(vector, 8) AS vector, round(score, 8) AS score FROM fused",
        "fused",
        extra=fx.fused_sql(1, arm=20),
    ),
    "rrf_fuse_arms_all": oracle(
        "SELECT query_id, chunk_id, s AS \"start\", e AS \"end\", round(bm25, 8) AS bm25, round(vector, 8) AS vector, round(score, 8) AS score FROM fused",
        "fused",
        extra=fx.fused_sql(1, arm=20, scan=None),
    ),
    "rrf_fuse_lists": oracle(
        """SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT query_id, chunk_id, rank FROM bm_ranked WHERE rank <= 20
        UNION ALL SELECT query_id, chunk_id, rank FROM vec_arm WHERE rank <= 20) GROUP BY ALL""",
        "bm_ranked",
        "vec_arm",
    ),
    "match_kind": oracle(
        """SELECT query_id, CASE WHEN bm25 > 0 AND vector > 0 THEN 'hybrid' WHEN vector > 0 THEN 'semantic' ELSE 'keyword' END AS kind,
        count(*) AS n, min(rank) AS best_rank FROM pool GROUP BY ALL""",
        "pool",
        extra=fx.fused_sql(0),
    ),
    "hybrid_search": _hybrid_sql("hybrid"),
    "hybrid_search_all": _hybrid_sql("hybrid", None),
    "hybrid_search_keyword": _hybrid_sql("keyword"),
    "hybrid_search_keyword_all": _hybrid_sql("keyword", None),
    "hybrid_search_semantic": _hybrid_sql("semantic"),
    "ranked_page": oracle(
        """SELECT query_id, chunk_id, rank, total, least(greatest(query_id % 9, 1), pages) AS page, page_size, pages, round(score / top, 6) AS score_norm
        FROM bm_ranked JOIN (SELECT query_id, total, top, page_size, greatest(ceil(total / page_size), 1)::INT AS pages FROM (
        SELECT query_id, count(*) AS total, max(score) AS top, CASE WHEN query_id * 3 - 5 <= 18 THEN 12 WHEN query_id * 3 - 5 <= 37 THEN 25 WHEN query_id * 3 - 5 <= 75 THEN 50 ELSE 100 END AS page_size
        FROM bm_ranked GROUP BY query_id)) USING (query_id)
        WHERE rank > (least(greatest(query_id % 9, 1), pages) - 1) * page_size AND rank <= least(greatest(query_id % 9, 1), pages) * page_size""",
        "bm_ranked",
    ),
    "hybrid_page": oracle(
        """SELECT query_id, chunk_id, rank, total, least(greatest(query_id % 9, 1), pages) AS page, page_size, pages, s AS "start", e AS "end", round(score, 8) AS score, round(score / top, 6) AS score_norm
        FROM pool JOIN (SELECT query_id, total, top, page_size, greatest(ceil(total / page_size), 1)::INT AS pages FROM (
        SELECT query_id, count(*) AS total, max(score) AS top, CASE WHEN query_id * 3 - 5 <= 18 THEN 12 WHEN query_id * 3 - 5 <= 37 THEN 25 WHEN query_id * 3 - 5 <= 75 THEN 50 ELSE 100 END AS page_size
        FROM pool GROUP BY query_id)) USING (query_id)
        WHERE rank > (least(greatest(query_id % 9, 1), pages) - 1) * page_size AND rank <= least(greatest(query_id % 9, 1), pages) * page_size""",
        "pool",
        extra=fx.fused_sql(0, scan=None),
    ),
    "suggest": _suggest_sql(),
    "suggest_all": _suggest_sql(None),
    "context_check": _context_sql(),
    "context_check_all": _context_sql(None),
    "rank_regions": oracle(
        """SELECT query_id, region_id, rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, region_id) AS rank FROM (
        SELECT query_id, region_id, list_dot_product(vec, centroid) / sqrt(list_dot_product(vec, vec)) / sqrt(list_dot_product(centroid, centroid)) AS score FROM qv, centroids)) WHERE rank <= 5""",
        "qv",
        "centroids",
    ),
}
