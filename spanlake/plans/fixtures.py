"""Corpus and outline tables derived from the given parquet tables.

Every function reads whole tables; ``ORACLE`` holds the same derivations as SQL common table
expressions so that both engines start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunk_key(doc_id):
    return F.concat(F.lit("d"), F.lpad(doc_id.cast("string"), 8, "0"))


def docs(spark, sf_dir) -> DataFrame:
    """(chunk_id, content): every document is one chunk."""
    return table(spark, sf_dir, "documents").select(chunk_key(F.col("doc_id")).alias("chunk_id"), F.col("text").alias("content"))


def vectors(spark, sf_dir) -> DataFrame:
    """(chunk_id, vec, label)."""
    return table(spark, sf_dir, "embeddings").select(
        chunk_key(F.col("vec_id")).alias("chunk_id"), F.col("embedding").alias("vec"), "label"
    )


def queries(spark, sf_dir) -> DataFrame:
    """(query_id, text)."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def queries_with_vec(spark, sf_dir) -> DataFrame:
    """(query_id, text, vec): the embedding of equal number is the query vector."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return queries(spark, sf_dir).join(v, "query_id", "left")


def docs_with_vec(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).join(vectors(spark, sf_dir).drop("label"), "chunk_id", "left")


def chunks(spark, sf_dir) -> DataFrame:
    """The chunk table; documents labelled toxic count as soft-deleted."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("gone"))
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    created = F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id"))
    return (
        d.join(lab, "doc_id", "left")
        .join(emb, "doc_id", "left")
        .select(
            chunk_key(F.col("doc_id")).alias("chunk_id"),
            F.col("source").alias("source_file"),
            F.col("text").alias("content"),
            (F.col("doc_id") * 100000).alias("start_offset"),
            (F.col("doc_id") * 100000 + F.col("n_chars")).alias("end_offset"),
            F.col("lang").alias("speaker"),
            "vec",
            created.alias("created_at"),
            F.when(F.col("gone"), created).alias("deleted_at"),
        )
    )


def live(spark, sf_dir) -> DataFrame:
    return chunks(spark, sf_dir).filter(F.col("deleted_at").isNull())


def segments(spark, sf_dir) -> DataFrame:
    """(upload_id, ord, speaker, text) from conversation turns."""
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("u"), F.col("conv_id").cast("string")).alias("upload_id"),
        F.col("turn").alias("ord"),
        F.col("role").alias("speaker"),
        "text",
    )


def uploads(spark, sf_dir) -> DataFrame:
    """(upload_id, filename, status, created_at) from orders."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("upload_id"),
        F.concat(F.lit("file"), F.col("o_custkey").cast("string"), F.lit(".txt")).alias("filename"),
        F.when(F.col("o_orderstatus") == "F", "failed")
        .when(F.col("o_orderstatus") == "O", "pending")
        .otherwise("done")
        .alias("status"),
        F.col("o_orderdate").alias("created_at"),
    )


# ---- outline -------------------------------------------------------------------------------------


def _at(seconds) -> object:
    return F.timestamp_seconds(F.lit(1700000000) + seconds)


def nodes(spark, sf_dir) -> DataFrame:
    """Regions, nations, customers, parts and suppliers as outline bullets, orders as evidence bullets."""
    r = table(spark, sf_dir, "region").select(
        F.concat(F.lit("r"), F.col("r_regionkey")).alias("node_id"),
        F.lit("outline").alias("type"),
        F.col("r_name").alias("title"),
        F.lit("").alias("body"),
        F.lit(True).alias("locked"),
        _at(F.col("r_regionkey")).alias("created_at"),
    )
    n = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("n"), F.col("n_nationkey")).alias("node_id"),
        F.lit("outline").alias("type"),
        F.col("n_name").alias("title"),
        F.concat(F.lit("About "), F.col("n_name")).alias("body"),
        F.lit(False).alias("locked"),
        _at(F.col("n_nationkey")).alias("created_at"),
    )
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("node_id"),
        F.lit("outline").alias("type"),
        F.col("c_name").alias("title"),
        F.when(F.col("c_acctbal") > 0, F.concat(F.lit("Segment\n"), F.col("c_mktsegment"))).otherwise("").alias("body"),
        (F.col("c_acctbal") < 0).alias("locked"),
        _at(F.col("c_custkey") % 97).alias("created_at"),
    )
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("node_id"),
        F.lit("chunk_ref").alias("type"),
        F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("Order  "), F.col("o_orderkey"), F.lit(" is "), F.col("o_orderstatus")).alias("body"),
        F.lit(True).alias("locked"),
        _at(F.col("o_orderkey") % 89).alias("created_at"),
    )
    p = table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey")).alias("node_id"),
        F.when(F.col("p_size") > 25, "outline").otherwise("synth").alias("type"),
        F.col("p_name").alias("title"),
        F.lit("").alias("body"),
        F.lit(False).alias("locked"),
        _at(F.col("p_partkey") % 83).alias("created_at"),
    )
    s = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey")).alias("node_id"),
        F.lit("outline").alias("type"),
        F.lit(" ").alias("title"),
        F.col("s_name").alias("body"),
        F.lit(False).alias("locked"),
        _at(F.col("s_suppkey") % 79).alias("created_at"),
    )
    return r.union(n).union(c).union(o).union(p).union(s)


def edges(spark, sf_dir) -> DataFrame:
    """region -> nation -> customer -> order as linear edges, part -> supplier as branch, supplier -> nation as jump."""
    n = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("r"), F.col("n_regionkey")).alias("from_node"),
        F.concat(F.lit("n"), F.col("n_nationkey")).alias("to_node"),
        F.lit("linear").alias("type"),
        F.lit(None).cast("string").alias("condition"),
        (F.col("n_nationkey") % 3).cast("int").alias("weight"),
    )
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("n"), F.col("c_nationkey")).alias("from_node"),
        F.concat(F.lit("c"), F.col("c_custkey")).alias("to_node"),
        F.lit("linear").alias("type"),
        F.lit(None).cast("string").alias("condition"),
        (F.col("c_custkey") % 7).cast("int").alias("weight"),
    )
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("from_node"),
        F.concat(F.lit("o"), F.col("o_orderkey")).alias("to_node"),
        F.lit("linear").alias("type"),
        F.lit(None).cast("string").alias("condition"),
        (F.col("o_orderkey") % 5).cast("int").alias("weight"),
    )
    ps = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", "l_suppkey")
        .agg(F.min("l_linenumber").alias("ln"))
        .select(
            F.concat(F.lit("p"), F.col("l_partkey")).alias("from_node"),
            F.concat(F.lit("s"), F.col("l_suppkey")).alias("to_node"),
            F.lit("branch").alias("type"),
            F.when(F.col("ln") <= 2, "audience==expert").when(F.col("ln") == 3, "label.level==2").alias("condition"),
            F.col("ln").cast("int").alias("weight"),
        )
    )
    sn = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey")).alias("from_node"),
        F.concat(F.lit("n"), F.col("s_nationkey")).alias("to_node"),
        F.lit("jump").alias("type"),
        F.when(F.col("s_acctbal") < 0, "audience!=novice").alias("condition"),
        F.lit(0).alias("weight"),
    )
    return (
        n.union(c).union(o).union(ps).union(sn)
        .withColumn("edge_id", F.concat_ws(">", "from_node", "to_node"))
        .withColumn("created_at", _at(F.col("weight")))
    )


def threads(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("t"), F.col("n_nationkey")).alias("thread_id"), F.col("n_name").alias("name")
    )


def thread_nodes(spark, sf_dir) -> DataFrame:
    """(thread_id, node_id, position): a nation's thread runs over its customers by key."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("t"), F.col("c_nationkey")).alias("thread_id"),
        F.concat(F.lit("c"), F.col("c_custkey")).alias("node_id"),
        F.col("c_custkey").cast("int").alias("position"),
    )


def evidence(spark, sf_dir) -> DataFrame:
    """Orders of a customer cite the document of the customer's number."""
    o = table(spark, sf_dir, "orders")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("o_custkey"), F.col("text").alias("content"), "source")
    start = (F.col("o_orderkey") % 50).cast("int")
    cited = F.substring(F.col("content"), start + 1, F.lit(40))
    return o.join(d, "o_custkey", "left").select(
        F.concat(F.lit("e"), F.col("o_orderkey")).alias("evidence_id"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("node_id"),
        chunk_key(F.col("o_custkey")).alias("chunk_id"),
        F.coalesce("source", F.lit("")).alias("source_file"),
        start.alias("char_start"),
        (start + 40).alias("char_end"),
        F.when(F.col("content").isNull(), "lost")
        .when(F.col("o_orderstatus") == "P", F.translate(cited, "aeiou", "AEIOU"))
        .otherwise(cited)
        .alias("text"),
        (F.col("o_orderkey") % 4).cast("int").alias("position"),
        (F.col("o_orderpriority") == "1-URGENT").alias("edited"),
        _at(F.col("o_orderkey")).alias("created_at"),
    )


# ---- labelled regions ----------------------------------------------------------------------------


def members(spark, sf_dir) -> DataFrame:
    """(region_id, chunk_id, vec): embeddings grouped by their label."""
    return vectors(spark, sf_dir).select(
        F.concat(F.lit("r"), F.col("label").cast("string")).alias("region_id"), "chunk_id", "vec"
    )


def builds(spark, sf_dir) -> DataFrame:
    """(build_id, created_at, status) from the region table."""
    k = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(
        F.concat(F.lit("b"), k).alias("build_id"),
        _at(k).alias("created_at"),
        F.when(k == 4, "building").otherwise("ready").alias("status"),
    )


def build_of_label(label):
    return F.concat(F.lit("b"), F.least(label, F.lit(3)).cast("string"))


# ---- the same tables for DuckDB ------------------------------------------------------------------

WS_SQL = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NON_WS_SQL = "[^" + WS_SQL[1:]


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


ORACLE: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), "SELECT 'd' || lpad(doc_id::VARCHAR, 8, '0') AS chunk_id, text AS content FROM documents"),
    "vecs": (
        (),
        "SELECT 'd' || lpad(vec_id::VARCHAR, 8, '0') AS chunk_id, embedding::DOUBLE[] AS vec, label FROM embeddings",
    ),
    "q": ((), "SELECT item_id AS query_id, text FROM benchmark"),
    "qv": (
        (),
        "SELECT item_id AS query_id, embedding::DOUBLE[] AS vec FROM benchmark JOIN embeddings ON vec_id = item_id",
    ),
    "chunks": (
        (),
        """SELECT 'd' || lpad(d.doc_id::VARCHAR, 8, '0') AS chunk_id, d.source AS source_file, d.text AS content,
        d.doc_id * 100000 AS start_offset, d.doc_id * 100000 + d.n_chars AS end_offset, d.lang AS speaker,
        e.embedding::DOUBLE[] AS vec, 1700000000 + d.doc_id AS created_at,
        CASE WHEN l.doc_id IS NOT NULL THEN 1700000000 + d.doc_id END AS deleted_at
        FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l ON l.doc_id = d.doc_id
        LEFT JOIN embeddings e ON e.vec_id = d.doc_id""",
    ),
    "live": (("chunks",), "SELECT * FROM chunks WHERE deleted_at IS NULL"),
    "segments": (
        (),
        "SELECT 'u' || conv_id AS upload_id, turn AS ord, role AS speaker, text FROM conversations",
    ),
    "uploads": (
        (),
        """SELECT o_orderkey AS upload_id, 'file' || o_custkey || '.txt' AS filename,
        CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'pending' ELSE 'done' END AS status,
        o_orderdate AS created_at FROM orders""",
    ),
    "nodes": (
        (),
        """SELECT 'r' || r_regionkey AS node_id, 'outline' AS type, r_name AS title, '' AS body, true AS locked, r_regionkey::BIGINT AS created_at FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'outline', n_name, 'About ' || n_name, false, n_nationkey FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'outline', c_name, CASE WHEN c_acctbal > 0 THEN 'Segment' || chr(10) || c_mktsegment ELSE '' END, c_acctbal < 0, c_custkey % 97 FROM customer
        UNION ALL SELECT 'o' || o_orderkey, 'chunk_ref', o_orderpriority, 'Order  ' || o_orderkey || ' is ' || o_orderstatus, true, o_orderkey % 89 FROM orders
        UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_size > 25 THEN 'outline' ELSE 'synth' END, p_name, '', false, p_partkey % 83 FROM part
        UNION ALL SELECT 's' || s_suppkey, 'outline', ' ', s_name, false, s_suppkey % 79 FROM supplier""",
    ),
    "edges": (
        (),
        """SELECT *, from_node || '>' || to_node AS edge_id, weight AS created_at FROM (
        SELECT 'r' || n_regionkey AS from_node, 'n' || n_nationkey AS to_node, 'linear' AS type, NULL::VARCHAR AS condition, (n_nationkey % 3)::INT AS weight FROM nation
        UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'linear', NULL, c_custkey % 7 FROM customer
        UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, 'linear', NULL, o_orderkey % 5 FROM orders
        UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'branch', CASE WHEN min(l_linenumber) <= 2 THEN 'audience==expert' WHEN min(l_linenumber) = 3 THEN 'label.level==2' END, min(l_linenumber) FROM lineitem GROUP BY l_partkey, l_suppkey
        UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'jump', CASE WHEN s_acctbal < 0 THEN 'audience!=novice' END, 0 FROM supplier)""",
    ),
    "threads": ((), "SELECT 't' || n_nationkey AS thread_id, n_name AS name FROM nation"),
    "thread_nodes": (
        (),
        "SELECT 't' || c_nationkey AS thread_id, 'c' || c_custkey AS node_id, c_custkey AS position FROM customer",
    ),
    "evidence": (
        (),
        """SELECT 'e' || o_orderkey AS evidence_id, 'c' || o_custkey AS node_id, 'd' || lpad(o_custkey::VARCHAR, 8, '0') AS chunk_id,
        coalesce(d.source, '') AS source_file, (o_orderkey % 50) AS char_start, (o_orderkey % 50) + 40 AS char_end,
        CASE WHEN d.text IS NULL THEN 'lost' WHEN o_orderstatus = 'P' THEN translate(substring(d.text, (o_orderkey % 50) + 1, 40), 'aeiou', 'AEIOU')
        ELSE substring(d.text, (o_orderkey % 50) + 1, 40) END AS text, (o_orderkey % 4) AS position,
        o_orderpriority = '1-URGENT' AS edited, o_orderkey AS created_at
        FROM orders LEFT JOIN documents d ON d.doc_id = o_custkey""",
    ),
    "members": (("vecs",), "SELECT 'r' || label AS region_id, chunk_id, vec FROM vecs"),
    "builds": (
        (),
        "SELECT 'b' || r_regionkey AS build_id, r_regionkey AS created_at, CASE WHEN r_regionkey = 4 THEN 'building' ELSE 'ready' END AS status FROM region",
    ),
    "centroids": (
        ("members",),
        """SELECT region_id, list(x / n ORDER BY dim) AS centroid, any_value(cnt) AS n FROM (
        SELECT region_id, dim, sum(v) AS x, sqrt(sum(sum(v) * sum(v)) OVER (PARTITION BY region_id)) AS n, count(*) AS cnt
        FROM (SELECT region_id, unnest(vec) AS v, unnest(range(len(vec))) AS dim FROM members) GROUP BY region_id, dim) GROUP BY region_id""",
    ),
    "region_members": (
        ("members", "centroids"),
        """SELECT m.region_id, m.chunk_id, m.vec, 1 - list_dot_product(m.vec, c.centroid) / sqrt(list_dot_product(m.vec, m.vec)) / sqrt(list_dot_product(c.centroid, c.centroid)) AS distance
        FROM members m JOIN centroids c USING (region_id)""",
    ),
    # retrieval
    "post": (
        ("docs",),
        r"""SELECT term, chunk_id, dl, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term
        FROM (SELECT chunk_id, regexp_extract_all(lower(content), '[\p{L}\p{Nd}]+') AS t FROM docs)) GROUP BY ALL""",
    ),
    "dstat": (
        ("docs",),
        r"SELECT count(*) AS n_docs, avg(len(regexp_extract_all(lower(content), '[\p{L}\p{Nd}]+'))) AS avg_dl FROM docs",
    ),
    "dfs": (("post",), "SELECT term, count(*) AS df FROM post GROUP BY term"),
    "qt": (
        ("q",),
        r"""SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) AS term FROM q) GROUP BY ALL""",
    ),
    "bm": (
        ("qt", "post", "dfs", "dstat"),
        """SELECT query_id, chunk_id, sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score
        FROM qt JOIN post USING (term) JOIN dfs USING (term), dstat GROUP BY ALL""",
    ),
    "bm_ranked": (
        ("bm",),
        "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm",
    ),
    "pieces": (
        ("docs",),
        r"""SELECT chunk_id, content, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (
        SELECT chunk_id, content, regexp_extract_all(content, '[^\p{L}\p{Nd}]*[\p{L}\p{Nd}]+') AS p FROM docs)""",
    ),
    "toks": (
        ("pieces",),
        r"""SELECT chunk_id, i - 1 AS i, lower(regexp_extract(piece, '[\p{L}\p{Nd}]+$')) AS term, e - length(regexp_extract(piece, '[\p{L}\p{Nd}]+$')) AS s, e
        FROM (SELECT chunk_id, piece, i, sum(length(piece)) OVER (PARTITION BY chunk_id ORDER BY i) AS e FROM pieces)""",
    ),
    "ntoks": (("toks",), "SELECT chunk_id, count(*) AS n FROM toks GROUP BY chunk_id"),
    "psg": (
        ("docs", "toks", "ntoks"),
        """SELECT a.chunk_id, a.s::INT AS s, b.e::INT AS e, substring(d.content, a.s::INT + 1, (b.e - a.s)::INT) AS text
        FROM toks a JOIN ntoks n USING (chunk_id) JOIN toks b ON b.chunk_id = a.chunk_id AND b.i = least(a.i + 55, n.n) - 1
        JOIN docs d ON d.chunk_id = a.chunk_id WHERE a.i % 40 = 0 AND (a.i = 0 OR a.i + 15 < n.n)""",
    ),
    "ppost": (
        ("psg",),
        r"""SELECT term, chunk_id, s, e, dl, count(*) AS tf FROM (SELECT chunk_id, s, e, len(t) AS dl, unnest(t) AS term
        FROM (SELECT chunk_id, s, e, regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+') AS t FROM psg)) GROUP BY ALL""",
    ),
    "pstat": (
        ("psg",),
        r"SELECT count(*) AS n_docs, avg(len(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'))) AS avg_dl FROM psg",
    ),
    "pdfs": (("ppost",), "SELECT term, count(*) AS df FROM ppost GROUP BY term"),
    "pbm": (
        ("qt", "ppost", "pdfs", "pstat"),
        """SELECT query_id, chunk_id, s, e, sum(qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1.0) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score
        FROM qt JOIN ppost USING (term) JOIN pdfs USING (term), pstat GROUP BY ALL""",
    ),
    "cosq": (
        ("qv", "vecs"),
        """SELECT query_id, chunk_id, list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec)) / sqrt(list_dot_product(b.vec, b.vec)) AS score FROM qv a, vecs b""",
    ),
    "vec_ranked": (
        ("cosq",),
        "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM cosq",
    ),
    # the vector arm of a chunk index: only vectors of chunks that are there
    "vec_arm": (
        ("cosq", "docs"),
        "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM cosq WHERE chunk_id IN (SELECT chunk_id FROM docs)",
    ),
}


def passage_arm_sql(limit: int, scan: int | None = 3) -> tuple[tuple[str, ...], str]:
    """Ranked passage arm at a limit (0: the whole pool), from the best ``scan * limit`` passages or all (None)."""
    looked = f"WHERE r <= {scan * limit}" if limit and scan else ""
    keep = f"WHERE rank <= {limit}" if limit else ""
    return (
        ("pbm",),
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
        FROM (SELECT query_id, chunk_id, s, e, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY round(score, 9) DESC, s, e) AS rc
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id, s, e) AS r FROM pbm) {looked}) WHERE rc = 1)) {keep}""",
    )


def fused_sql(limit: int, mode: str = "hybrid", arm: int | None = None, scan: int | None = 3) -> dict[str, tuple[tuple[str, ...], str]]:
    """The fused pool and its ranking at a limit (0: everything)."""
    arm = (max(3 * limit, 20) if limit else 0) if arm is None else arm
    bk = f"WHERE rank <= {arm}" if arm else ""
    vk = bk
    parts, deps = [], []
    if mode != "semantic":
        parts += [
            f"SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS bm25, 0.0::DOUBLE AS vector, NULL::INT AS s, NULL::INT AS e FROM bm_ranked {bk}",
            "SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank), 0.0, s, e FROM parm",
        ]
        deps += ["bm_ranked", "parm"]
    if mode != "keyword":
        parts.append(
            f"SELECT query_id, chunk_id, 0.0::DOUBLE AS bm25, 1.0::DOUBLE / (60 + rank) AS vector, NULL::INT AS s, NULL::INT AS e FROM vec_arm {vk}"
        )
        deps.append("vec_arm")
    keep = f"WHERE rank <= {limit}" if limit else ""
    return {
        "parm": passage_arm_sql(arm, scan),
        "fused": (
            tuple(deps),
            "SELECT query_id, chunk_id, sum(bm25) AS bm25, sum(vector) AS vector, max(s) AS s, max(e) AS e, sum(bm25) + sum(vector) AS score FROM ("
            + " UNION ALL ".join(parts)
            + ") GROUP BY ALL",
        ),
        "pool": (
            ("fused",),
            f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM fused) {keep}",
        ),
    }


def oracle(body: str, *names: str, extra: dict | None = None) -> str:
    """``body`` behind a WITH clause holding the named derivations and what they need."""
    known = {**ORACLE, **(extra or {})}
    done: list[str] = []

    def visit(name: str) -> None:
        if name in done:
            return
        for d in known[name][0]:
            visit(d)
        done.append(name)

    for n in names:
        visit(n)
    return ("WITH RECURSIVE " + ",\n".join(f"{n} AS ({known[n][1]})" for n in done) + "\n" + body) if done else body
