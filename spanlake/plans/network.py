"""Registered queries: clustering, keywords, digests, labels and similarity graphs (E1-E29)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions.wordlists import LABEL_STOP_WORDS
from spanlake.operators import cluster as cl
from spanlake.operators import digest as dg
from spanlake.operators import keywords as kw
from spanlake.operators import network as nw
from spanlake.operators.blocks import build_blocks
from spanlake.operators.fusion import SearchIndex, hybrid_search
from spanlake.operators.lexical import bm25_search
from spanlake.plans import fixtures as fx
from spanlake.plans.fixtures import _quoted, oracle
from spanlake.plans.scalars import _TITLE, _dealt, _runes, _trim, _words
from spanlake.runtime import shared_path


def _corpus(spark, sf):
    """Chunks with a vector: (chunk_id, source_file, content, start_offset, vec, ...)."""
    from spanlake.operators.corpus import chunks_with_vector

    return chunks_with_vector(fx.chunks(spark, sf))


def _members(spark, sf):
    m = fx.members(spark, sf)
    return cl.with_distance(m, cl.centroids(m, "region_id"), "region_id")


def cluster_chunks(spark, sf):
    _, members = cl.cluster_chunks(fx.vectors(spark, sf))
    return members.select("region_id", "chunk_id", F.round("distance", 6).alias("distance"))


def cluster_chunks_distributed(spark, sf):
    """The same result from distributed splits of every part over 200 rows."""
    _, members = cl.cluster_chunks(fx.vectors(spark, sf), cl.ClusterParams(local_rows=200))
    return members.select("region_id", "chunk_id", F.round("distance", 6).alias("distance"))


def bisect(spark, sf):
    m = fx.members(spark, sf)
    return cl.bisect(m, "region_id")


def centroids(spark, sf):
    c = cl.centroids(fx.members(spark, sf), "region_id")
    return c.select("region_id", "n", F.posexplode("centroid").alias("dim", "x")).select("region_id", "n", "dim", F.round("x", 5).alias("x"))


def member_distance(spark, sf):
    return _members(spark, sf).select("region_id", "chunk_id", F.round("distance", 5).alias("distance"))


def merge_undersized(spark, sf):
    """Parts are the first signs of each vector; small ones are merged away."""
    v = fx.vectors(spark, sf)
    sign = F.array_join(F.transform(F.slice("vec", 1, 5), lambda x: F.when(x < 0, "0").otherwise("1")), "")
    return cl.merge_undersized(v.withColumn("part0", sign), "part0", 12).select("chunk_id", "part")


def _hits(spark, sf):
    idx = SearchIndex(fx.docs_with_vec(spark, sf))
    q = fx.queries_with_vec(spark, sf)
    return q, hybrid_search(q, idx, limit=20)


def cluster_per_query(spark, sf):
    q, hits = _hits(spark, sf)
    return cl.query_themes(q, hits, fx.vectors(spark, sf)).withColumn("confidence", F.round("confidence", 6))


def query_themes(spark, sf):
    """Another clusterer: hits fall in themes by the sign of their first component."""

    def by_sign(hits):
        return hits.select(
            "query_id", F.when(F.col("vec")[0] < 0, 0).otherwise(1).alias("cluster"), F.concat(F.length("title").cast("string"), F.lit(" letters")).alias("label"),
            "chunk_id", F.lit(1.0).alias("confidence"),
        )

    q = fx.queries(spark, sf)
    hits = bm25_search(q, build_blocks(fx.docs(spark, sf)), 20)
    return cl.query_themes(q, hits, fx.vectors(spark, sf), by_sign)


def digests_by_summariser(spark, sf):
    """Transcript digests by another summariser: the length of all texts and the first text's letters."""

    def by_length(texts, df, n_docs, group, order):
        first = F.min_by("content", F.struct(*order))
        return texts.groupBy(group).agg(
            F.concat(F.sum(F.length("content")).cast("string"), F.lit(" letters")).alias("title"), F.md5(first).alias("abstract"),
            F.array(F.lit("k")).alias("keywords"), F.lit("own").alias("source"),
        )

    out = dg.transcript_digests(fx.live(spark, sf), summarise=by_length)
    return out.select("source_file", "chunk_count", "title", "abstract", F.array_join("keywords", " ").alias("keywords"), "source")


def _label_regions(spark, sf):
    return (
        fx.table(spark, sf, "embeddings")
        .groupBy(F.concat(F.lit("r"), F.col("label").cast("string")).alias("region_id"))
        .agg(F.concat(F.lit("Theme "), F.min("vec_id").cast("string")).alias("title"), F.count(F.lit(1)).alias("chunk_count"))
    )


def sub_themes_by_region(spark, sf):
    hits = bm25_search(fx.queries(spark, sf), build_blocks(fx.docs(spark, sf)), 20)
    return cl.sub_themes_by_region(hits, fx.members(spark, sf), _label_regions(spark, sf)).withColumn("score", F.round("score", 6))


def keyword_df(spark, sf):
    return kw.keyword_df(fx.docs(spark, sf))


def top_keywords(spark, sf, partitions=None):
    d = _dealt(fx.docs(spark, sf), partitions)
    return kw.top_keywords(d, kw.keyword_df(d), kw.corpus_size(d), ["chunk_id"], 4).withColumn("score", F.round("score", 6))


def top_keywords_by_source(spark, sf):
    d = fx.chunks(spark, sf)
    return kw.top_keywords(d, kw.keyword_df(d), kw.corpus_size(d), ["source_file"], 6).withColumn("score", F.round("score", 6))


def tag_regions(spark, sf):
    preset = F.when(F.col("region_id") == "r3", F.array(F.lit("preset"))).otherwise(F.array().cast("array<string>"))
    regions, members = kw.tag_regions(
        _label_regions(spark, sf).withColumn("keywords", preset), fx.members(spark, sf).drop("vec"), fx.docs(spark, sf)
    )
    flat = F.array_join("keywords", " ").alias("keywords")
    return regions.select("region_id", F.lit("").alias("chunk_id"), flat).unionByName(members.select("region_id", "chunk_id", flat))


def extractive_digest(spark, sf):
    d = fx.docs(spark, sf)
    texts = _members(spark, sf).withColumn("distance", F.round("distance", 9)).join(d, "chunk_id")
    out = kw.extractive_digest(texts, kw.keyword_df(d), kw.corpus_size(d), "region_id", ["distance", "chunk_id"])
    return out.select("region_id", "title", "abstract", F.array_join("keywords", " ").alias("keywords"), "source")


def digest_hash(spark, sf):
    return dg.digest_hash(fx.members(spark, sf), ["region_id"], "region")


def digest_hash_transcript(spark, sf):
    return dg.digest_hash(fx.live(spark, sf).select("source_file", "chunk_id"), ["source_file"], "transcript", ["source_file"])


def _cache(spark, sf):
    """Digests of earlier region builds: regions 0-3 by a model, 4-6 extractive."""
    h = digest_hash(spark, sf)
    n = F.substring("region_id", 2, 9).cast("int")
    return h.filter(n <= 6).select(
        "input_hash",
        F.lit("region").alias("kind"),
        F.concat(F.lit("Old "), "region_id").alias("title"),
        F.lit("").alias("abstract"),
        F.array(F.lit("k")).alias("keywords"),
        F.lit(None).cast("array<float>").alias("vec"),
        F.when(n <= 3, "llm:m").otherwise("extractive").alias("source"),
    )


def digest_cache_lookup(spark, sf):
    h = digest_hash(spark, sf)
    hit, miss = dg.digest_cache_lookup(h, _cache(spark, sf), has_llm=True)
    return hit.select("region_id", "title", "source").unionByName(
        miss.select("region_id", F.lit(None).cast("string").alias("title"), F.lit("miss").alias("source"))
    )


def digest_cache_upsert(spark, sf):
    h = digest_hash(spark, sf)
    new = h.filter(F.substring("region_id", 2, 9).cast("int") >= 5).select(
        "input_hash", F.lit("region").alias("kind"), F.concat(F.lit("New "), "region_id").alias("title"), F.lit("a").alias("abstract"),
        F.array().cast("array<string>").alias("keywords"), F.lit(None).cast("array<float>").alias("vec"), F.lit("llm:n").alias("source"),
    )
    return dg.digest_cache_upsert(_cache(spark, sf), new).select("input_hash", "title", "source")


def digest_regions(spark, sf):
    d = fx.docs(spark, sf)
    out, _ = dg.digest_regions(_members(spark, sf), d, _cache(spark, sf))
    return out.select("region_id", "title", "source", F.size("vec").alias("dim"))


def transcript_digests(spark, sf, partitions=None):
    out = dg.transcript_digests(_dealt(fx.live(spark, sf), partitions))
    return out.select("source_file", "chunk_count", "title", "abstract", F.array_join("keywords", " ").alias("keywords"))


def digest_text(spark, sf):
    out = dg.transcript_digests(fx.live(spark, sf))
    blank = F.when(F.col("chunk_count") % 2 == 0, F.lit("")).otherwise(F.col("abstract"))
    return out.select("source_file", dg.digest_text(F.col("title"), blank, F.col("keywords")).alias("text"))


def _regions(spark, sf):
    return cl.centroids(fx.members(spark, sf), "region_id").withColumnRenamed("n", "chunk_count")


def region_links(spark, sf):
    return nw.region_links(_regions(spark, sf), k=2, min_weight=-0.5).withColumn("weight", F.round("weight", 5))


def chunk_edges(spark, sf):
    return nw.chunk_edges(fx.vectors(spark, sf)).withColumn("weight", F.round("weight", 6))


def chunk_edges_top(spark, sf):
    return nw.chunk_edges(fx.vectors(spark, sf), keep_fraction=0.25, block_rows=128).withColumn("weight", F.round("weight", 6))


def transcript_edges(spark, sf):
    return nw.transcript_edges(nw.chunk_edges(fx.vectors(spark, sf)), fx.chunks(spark, sf)).withColumn("weight", F.round("weight", 6))


def tag_files(spark, sf):
    return nw.tag_files(fx.members(spark, sf), fx.chunks(spark, sf)).withColumn("share", F.round("share", 6))


def _labels(spark, sf):
    lab = fx.table(spark, sf, "labels")
    return lab.select(
        fx.chunk_key(F.col("doc_id")).alias("chunk_id"),
        F.concat(F.lit("label "), F.col("doc_id").cast("string")).alias("label"),
        F.when(F.col("quality") == 1, "llm:m").otherwise("head").alias("source"),
    )


def labels_missing(spark, sf):
    return dg.labels_missing(fx.docs(spark, sf), _labels(spark, sf))


def _echo(system: str, prompt: str) -> str:
    """Stands in for a model: labels every odd line by its length."""
    lines = [x for x in prompt.split("\n") if x]
    return "thinking</think>\n" + "\n".join(f"{i + 1}. **words {len(x.split()) - 1}**" for i, x in enumerate(lines) if i % 2 == 0)


def label_chunks(spark, sf):
    out = dg.label_chunks(fx.docs(spark, sf), _echo, "echo")
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("chunks"))


def upsert_labels(spark, sf):
    new = fx.docs(spark, sf).select("chunk_id", F.col("content").alias("label"), F.lit("llm:n").alias("source"))
    missing = dg.labels_missing(fx.docs(spark, sf), _labels(spark, sf))
    blank = new.join(missing, "chunk_id", "left_semi").withColumn(
        "chunk_id", F.when(F.col("label").startswith("T"), "").otherwise(F.col("chunk_id"))
    )
    return dg.upsert_labels(_labels(spark, sf), blank)


def get_labels(spark, sf):
    ids = fx.table(spark, sf, "embeddings").select(fx.chunk_key(F.col("vec_id")).alias("chunk_id"))
    return dg.get_labels(_labels(spark, sf), ids)


def _digest_model(system: str, prompt: str) -> str:
    n = prompt.count("\n")
    return f"TITLE: Theme of {n} texts\nKEYWORDS: Alpha, beta ,\n" + ("ABSTRACT: All of it." if n % 2 else "")


def digest_with_completer(spark, sf):
    d = fx.docs(spark, sf)
    texts = _members(spark, sf).join(d, "chunk_id")
    order = ["distance", "chunk_id"]
    ex = kw.extractive_digest(texts, kw.keyword_df(d), kw.corpus_size(d), "region_id", order)
    out = dg.digest_with_completer(texts, ex, "region_id", order, _digest_model, "m")
    return out.select("region_id", "title", "abstract", F.array_join("keywords", " ").alias("keywords"), "source")


def parse_digest_replies(spark, sf):
    """Replies spelled from the documents: reasoning, decoration and repeated fields around their words."""
    d = fx.table(spark, sf, "documents")
    first = F.array_join(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z]+"), F.lit(0)), " ")
    lead = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("hm TITLE: wrong</think>\n"))).otherwise("```\n")
    reply = F.concat(
        lead, F.lit("** Title : "), first, F.lit("**\nnoise\nTITLE: second\n# SUMMARY: about "), F.col("source"),
        F.lit("\nTAGS: "), F.col("lang"), F.lit(", , "), F.upper("source"), F.lit("\n```"),
    )
    out = dg.parse_digest_replies(d.select("doc_id", reply.alias("reply")))
    return out.select("doc_id", "title", "abstract", F.array_join("keywords", "|").alias("keywords"))


def parse_label_replies(spark, sf):
    d = fx.table(spark, sf, "documents")
    reply = F.concat(
        F.lit("1. \"\"\n- 2) "), F.col("source"), F.lit(" is in\t"), F.col("lang"), F.lit(" one two three four.\n2. again\n[1] 'fine'")
    )
    return d.select(
        "doc_id", *[F.coalesce(dg.numbered_phrase(reply, F.lit(n)), F.lit("")).alias(f"l{n}") for n in (1, 2, 3)]
    )


def _batches(spark, sf):
    """Ten documents per reply, by source order of their number."""
    d = fx.table(spark, sf, "documents")
    return d.select(
        F.floor(F.col("doc_id") / 10).alias("reply_id"), (F.col("doc_id") % 10).cast("int").alias("idx"),
        fx.chunk_key(F.col("doc_id")).alias("chunk_id"), "lang",
    )


def parse_cluster_replies(spark, sf):
    b = _batches(spark, sf)
    body = F.concat(F.lit("[{\"label\":\""), F.col("lang"), F.lit("\",\"chunk_indices\":[0,3,12],\"confidence\":0.5},{\"label\":\"\",\"chunk_indices\":[99]},{\"chunk_indices\":[5,-1]}]"))
    r = b.filter("idx = 0").select(
        "reply_id", F.lit("Topic").alias("title"), F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("reply")
    )
    return dg.parse_cluster_replies(r, b.select("reply_id", "idx", "chunk_id"))


def parse_span_replies(spark, sf):
    b = _batches(spark, sf)
    kind = F.when(F.col("reply_id") % 5 == 0, "other").otherwise("glue")
    body = F.concat(F.lit("[{\"type\":\"chunk\",\"index\":2,\"text\":\"a\"},{\"type\":\""), kind, F.lit("\",\"text\":\" and \"},{\"type\":\"chunk\",\"index\":40,\"text\":\"b\"}]"))
    r = b.filter("idx = 0").select("reply_id", F.when(F.col("reply_id") % 7 == 0, "sorry").otherwise(body).alias("reply"))
    return dg.parse_span_replies(r, b.select("reply_id", "idx", "chunk_id"))


def build_atlas(spark, sf):
    store = nw.BuildStore(spark, shared_path(spark, "atlas"))
    nw.build_atlas(store, "b1", fx.chunks(spark, sf))
    r, m, l = (store.read(t) for t in ("regions", "region_members", "region_links"))
    return nw.build_counts(nw.current_build_id(store.builds()), r, m, l)


def _build_tables(spark, sf):
    lab = F.substring("region_id", 2, 9).cast("int")
    reg = _label_regions(spark, sf).withColumn("build_id", fx.build_of_label(lab))
    mem = fx.members(spark, sf).drop("vec").withColumn("build_id", fx.build_of_label(lab))
    lk = nw.region_links(_regions(spark, sf), k=2, min_weight=-0.5)
    lk = lk.withColumn("build_id", fx.build_of_label(F.least(F.substring("region_a", 2, 9).cast("int"), F.substring("region_b", 2, 9).cast("int"))))
    return fx.builds(spark, sf), reg, mem, lk


def current_build(spark, sf):
    b, reg, mem, _ = _build_tables(spark, sf)
    return nw.of_current(b, reg).join(nw.of_current(b, mem).select("region_id", "chunk_id"), "region_id").select(
        "build_id", "region_id", "title", "chunk_count", "chunk_id"
    )


def build_counts(spark, sf):
    return nw.build_counts(*_build_tables(spark, sf))


def staleness(spark, sf):
    build = fx.vectors(spark, sf).filter("label < 8").agg(F.count(F.lit(1)).alias("chunk_count"))
    return nw.staleness(fx.chunks(spark, sf), build)


def _payload(spark, sf):
    d = dg.transcript_digests(fx.live(spark, sf))
    regions = _label_regions(spark, sf).withColumn("keywords", F.array(F.lit("k")))
    return nw.network_payload(regions, fx.members(spark, sf), fx.chunks(spark, sf), d)


def network_payload(spark, sf):
    return _payload(spark, sf)["transcripts"].select("source_file", "label", "chunks", F.array_join("tags", " ").alias("tags"))


def network_payload_edges(spark, sf):
    return _payload(spark, sf)["edges"].withColumn("weight", F.round("weight", 6))


def region_detail(spark, sf):
    reg, links = _label_regions(spark, sf), nw.region_links(_regions(spark, sf), k=2, min_weight=-0.5)
    mem, near = nw.region_detail(reg, reg, _members(spark, sf), links, fx.chunks(spark, sf), _labels(spark, sf))
    return mem.select("region_id", "chunk_id", F.coalesce("label", "snippet").alias("text"), F.round("distance", 5).alias("w")).unionByName(
        near.select("region_id", F.col("other").alias("chunk_id"), F.col("title").alias("text"), F.round("weight", 5).alias("w"))
    )


def transcript_detail(spark, sf):
    live = fx.live(spark, sf)
    return nw.transcript_detail(live, live, _labels(spark, sf)).select("source_file", "start_offset", "chunk_id", "summary")


QUERIES = {
    "cluster_chunks": cluster_chunks,
    "cluster_chunks_distributed": cluster_chunks_distributed,
    "bisect": bisect,
    "centroids": centroids,
    "centroid_distance": member_distance,
    "merge_undersized": merge_undersized,
    "cluster_per_query": cluster_per_query,
    "query_themes": query_themes,
    "digests_by_summariser": digests_by_summariser,
    "sub_themes_by_region": sub_themes_by_region,
    "keyword_df": keyword_df,
    "top_keywords": top_keywords,
    "top_keywords_by_source": top_keywords_by_source,
    "tag_regions": tag_regions,
    "extractive_digest": extractive_digest,
    "digest_hash": digest_hash,
    "digest_hash_transcript": digest_hash_transcript,
    "digest_cache_lookup": digest_cache_lookup,
    "digest_cache_upsert": digest_cache_upsert,
    "digest_regions": digest_regions,
    "transcript_digests": transcript_digests,
    "digest_text": digest_text,
    "region_links": region_links,
    "chunk_edges": chunk_edges,
    "chunk_edges_top": chunk_edges_top,
    "transcript_edges": transcript_edges,
    "tag_files": tag_files,
    "labels_missing": labels_missing,
    "label_chunks": label_chunks,
    "upsert_labels": upsert_labels,
    "get_labels": get_labels,
    "digest_with_completer": digest_with_completer,
    "parse_digest_replies": parse_digest_replies,
    "parse_label_replies": parse_label_replies,
    "parse_cluster_replies": parse_cluster_replies,
    "parse_span_replies": parse_span_replies,
    "build_atlas": build_atlas,
    "current_build": current_build,
    "build_counts": build_counts,
    "staleness": staleness,
    "network_payload": network_payload,
    "network_payload_edges": network_payload_edges,
    "region_detail": region_detail,
    "transcript_detail": transcript_detail,
}



def _hash_sql(head: str) -> str:
    """Digest cache key over a group's chunk ids; ``head`` are the parts that stand before."""
    sums = ", ".join(f"sum(('0x' || substring(sha256(chunk_id), {1 + 12 * i}, 12))::BIGINT::HUGEINT)" for i in range(5))
    return f"sha256(concat_ws(chr(0), {head}, count(*), {sums}))"


_STOP = _quoted(LABEL_STOP_WORDS)
_EX = {
    "dterms": (
        ("docs",),
        rf"""SELECT chunk_id, term FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+')) AS term FROM docs)
        WHERE strlen(term) BETWEEN 3 AND 30 AND NOT regexp_full_match(term, '[0-9]+') AND term NOT IN ({_STOP})""",
    ),
    "tdf": (("dterms",), "SELECT term, count(DISTINCT chunk_id) AS df FROM dterms GROUP BY term"),
    "ndoc": (("docs",), "SELECT count(*) AS n FROM docs"),
    "src": ((), "SELECT 'd' || lpad(doc_id::VARCHAR, 8, '0') AS chunk_id, source AS source_file FROM documents"),
    "labs": (
        (),
        "SELECT 'd' || lpad(doc_id::VARCHAR, 8, '0') AS chunk_id, 'label ' || doc_id AS label, CASE WHEN quality = 1 THEN 'llm:m' ELSE 'head' END AS source FROM labels",
    ),
    "hashes": (("members",), f"SELECT region_id, {_hash_sql("'region'")} AS input_hash FROM members GROUP BY region_id"),
    "cache": (
        ("hashes",),
        "SELECT input_hash, region_id, 'Old ' || region_id AS title, CASE WHEN substring(region_id, 2)::INT <= 3 THEN 'llm:m' ELSE 'extractive' END AS source FROM hashes WHERE substring(region_id, 2)::INT <= 6",
    ),
    "lreg": ((), "SELECT 'r' || label AS region_id, 'Theme ' || min(vec_id) AS title, count(*) AS chunk_count FROM embeddings GROUP BY label"),
    "rsim": (
        ("centroids",),
        "SELECT a.region_id AS a, b.region_id AS b, list_dot_product(a.centroid, b.centroid) AS w FROM centroids a, centroids b WHERE a.region_id <> b.region_id",
    ),
    "rlink": (
        ("rsim",),
        "SELECT least(a, b) AS region_a, greatest(a, b) AS region_b, max(w) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(w, 9) DESC, b) AS r FROM rsim WHERE w >= -0.5) WHERE r <= 2 GROUP BY 1, 2",
    ),
}


def _kw(group: str, n: int, src: str = "") -> str:
    return f"""SELECT {group}, term, rank, score FROM (SELECT {group}, term, tf * ((n + 1)::DOUBLE / (df + 1)) AS score,
    row_number() OVER (PARTITION BY {group} ORDER BY round(tf * ((n + 1)::DOUBLE / (df + 1)), 9) DESC, term) AS rank
    FROM (SELECT {group}, term, count(*) AS tf FROM dterms {src} GROUP BY ALL) JOIN tdf USING (term), ndoc) WHERE rank <= {n}"""


def _knn(vecs: str, k: int, floor: float) -> dict:
    return {
        "csim": (
            ("vecs",),
            f"""SELECT * FROM (SELECT a.chunk_id AS a, b.chunk_id AS b, list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec)) / sqrt(list_dot_product(b.vec, b.vec)) AS w
            FROM {vecs} a, {vecs} b WHERE a.chunk_id <> b.chunk_id) WHERE w >= {floor}""",
        ),
        "cedge": (
            ("csim",),
            f"SELECT least(a, b) AS a, greatest(a, b) AS b, max(w) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(w, 9) DESC, b) AS r FROM csim) WHERE r <= {k} GROUP BY 1, 2",
        ),
    }


def _tedge(k: int) -> dict:
    return {
        "fpair": (
            ("cedge", "src"),
            "SELECT least(x.source_file, y.source_file) AS x, greatest(x.source_file, y.source_file) AS y, max(weight) AS weight FROM cedge e JOIN src x ON x.chunk_id = e.a JOIN src y ON y.chunk_id = e.b WHERE x.source_file <> y.source_file AND weight > 0 GROUP BY 1, 2",
        ),
        "tedge": (
            ("fpair",),
            f"""SELECT DISTINCT least(me, other) AS a, greatest(me, other) AS b, weight FROM (SELECT *, row_number() OVER (PARTITION BY me ORDER BY round(weight, 9) DESC, other) AS r FROM (
            SELECT x AS me, y AS other, weight FROM fpair UNION ALL SELECT y, x, weight FROM fpair)) WHERE r <= {k}""",
        ),
    }


_TAGS = {
    "shares": (
        ("members", "src"),
        "SELECT source_file, region_id, n / sum(n) OVER (PARTITION BY source_file) AS share FROM (SELECT source_file, region_id, count(*) AS n FROM members JOIN src USING (chunk_id) GROUP BY source_file, region_id)",
    ),
    "ftags": (
        ("shares",),
        """SELECT source_file, rank, region_id, share FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY share DESC, region_id) AS rank, max(share) OVER (PARTITION BY source_file) AS top FROM shares)
        WHERE rank <= 3 AND (rank = 1 OR (share >= 0.15 AND share >= top - 0.1))""",
    ),
}

_ABSTRACT = r"""CASE WHEN len(p) > 1 THEN array_to_string(p[1:least(2, len(p) - 1)], ' ') ELSE {runes} END""".replace("{runes}", _runes("p[1]", 280))
_PIECES = rf"string_split(regexp_replace(array_to_string({_words('content')}, ' '), '([.!?])( |$)', '\1' || chr(1), 'g'), chr(1))"


def _o(body, *names, **extra):
    return oracle(body, *names, extra={**_EX, **extra})


_TD = {
    "docs": (("live",), "SELECT chunk_id, content FROM live"),
    "skw": (("dterms", "tdf", "ndoc", "src"), "SELECT source_file, string_agg(term, ' ' ORDER BY rank) AS keywords, list(term ORDER BY rank) AS kl FROM (" + _kw("source_file", 6, "JOIN src USING (chunk_id)") + ") GROUP BY source_file"),
    "tdig": (
        ("live", "skw"),
        f"""SELECT source_file, cnt AS chunk_count, {_TITLE.format(c="array_to_string(kl[1:3], ' · ')")} AS title, {_ABSTRACT} AS abstract, keywords, kl FROM (
        SELECT source_file, count(*) AS cnt, string_split(regexp_replace(array_to_string({_words("arg_min(content, start_offset)")}, ' '), '([.!?])( |$)', '\\1' || chr(1), 'g'), chr(1)) AS p FROM live GROUP BY source_file) JOIN skw USING (source_file)""",
    ),
}

ORACLES = {
    "centroids": _o("SELECT region_id, n, unnest(range(len(centroid))) AS dim, round(unnest(centroid), 5) AS x FROM centroids", "centroids"),
    "centroid_distance": _o("SELECT region_id, chunk_id, round(distance, 5) AS distance FROM region_members", "region_members"),
    "sub_themes_by_region": _o(
        "SELECT query_id, region_id, any_value(title) AS label, count(*) AS n, round(avg(score), 6) AS score FROM bm_ranked JOIN members USING (chunk_id) JOIN lreg USING (region_id) WHERE rank <= 20 GROUP BY query_id, region_id",
        "bm_ranked", "members", "lreg",
    ),
    "keyword_df": _o("SELECT term, df FROM tdf", "tdf"),
    "top_keywords": _o("SELECT chunk_id, rank, term, round(score, 6) AS score FROM (" + _kw("chunk_id", 4) + ")", "dterms", "tdf", "ndoc"),
    "top_keywords_by_source": _o(
        "SELECT source_file, rank, term, round(score, 6) AS score FROM (" + _kw("source_file", 6, "JOIN src USING (chunk_id)") + ")", "dterms", "tdf", "ndoc", "src"
    ),
    "tag_regions": _o(
        f"""SELECT region_id, '' AS chunk_id, CASE WHEN region_id = 'r3' THEN 'preset' ELSE coalesce(k, '') END AS keywords FROM lreg LEFT JOIN (SELECT region_id, string_agg(term, ' ' ORDER BY rank) AS k FROM ({_kw('region_id', 6, 'JOIN members USING (chunk_id)')}) GROUP BY region_id) USING (region_id)
        UNION ALL SELECT region_id, chunk_id, coalesce(k, '') FROM members LEFT JOIN (SELECT chunk_id, string_agg(term, ' ' ORDER BY rank) AS k FROM ({_kw('chunk_id', 4)}) GROUP BY chunk_id) USING (chunk_id)""",
        "dterms", "tdf", "ndoc", "members", "lreg",
    ),
    "extractive_digest": _o(
        f"""SELECT region_id, {_TITLE.format(c="array_to_string(kl[1:3], ' · ')")} AS title, {_ABSTRACT} AS abstract, array_to_string(kl, ' ') AS keywords, 'extractive' AS source
        FROM (SELECT region_id, {_PIECES} AS p FROM (SELECT region_id, content, row_number() OVER (PARTITION BY region_id ORDER BY round(distance, 9), chunk_id) AS r FROM region_members JOIN docs USING (chunk_id)) WHERE r = 1)
        JOIN (SELECT region_id, list(term ORDER BY rank) AS kl FROM ({_kw('region_id', 6, 'JOIN members USING (chunk_id)')}) GROUP BY region_id) USING (region_id)""",
        "region_members", "docs", "dterms", "tdf", "ndoc",
    ),
    "digest_hash": _o("SELECT region_id, input_hash FROM hashes", "hashes"),
    "digest_hash_transcript": _o(
        f"SELECT source_file, {_hash_sql("'transcript', source_file")} AS input_hash FROM live GROUP BY source_file", "live"
    ),
    "digest_cache_lookup": _o(
        "SELECT h.region_id, title, coalesce(source, 'miss') AS source FROM hashes h LEFT JOIN (SELECT * FROM cache WHERE source LIKE 'llm:%') USING (input_hash)", "hashes", "cache"
    ),
    "digest_cache_upsert": _o(
        """SELECT input_hash, title, source FROM cache WHERE substring(region_id, 2)::INT < 5
        UNION ALL SELECT input_hash, 'New ' || region_id, 'llm:n' FROM hashes WHERE substring(region_id, 2)::INT >= 5""", "hashes", "cache"
    ),
    "digest_regions": _o(
        f"""SELECT region_id, CASE WHEN substring(region_id, 2)::INT <= 6 THEN 'Old ' || region_id ELSE {_TITLE.format(c="array_to_string(kl[1:3], ' · ')")} END AS title,
        CASE WHEN substring(region_id, 2)::INT <= 3 THEN 'llm:m' ELSE 'extractive' END AS source, 64 AS dim
        FROM (SELECT region_id, list(term ORDER BY rank) AS kl FROM ({_kw('region_id', 6, 'JOIN members USING (chunk_id)')}) GROUP BY region_id)""",
        "members", "dterms", "tdf", "ndoc",
    ),
    "digest_with_completer": _o(
        f"""SELECT region_id, 'Theme of ' || n || ' texts' AS title, CASE WHEN n % 2 = 1 THEN 'All of it.' ELSE abstract END AS abstract, 'alpha beta' AS keywords, CASE WHEN n % 2 = 1 THEN 'llm:m' ELSE 'llm:m+extractive' END AS source
        FROM (SELECT region_id, {_ABSTRACT} AS abstract FROM (SELECT region_id, {_PIECES} AS p FROM (SELECT region_id, content, row_number() OVER (PARTITION BY region_id ORDER BY distance, chunk_id) AS r FROM region_members JOIN docs USING (chunk_id)) WHERE r = 1))
        JOIN (SELECT region_id, sum(1 + length({_trim('content')}) - length(replace({_trim('content')}, chr(10), '')))::INT AS n FROM (SELECT region_id, content, row_number() OVER (PARTITION BY region_id ORDER BY distance, chunk_id) AS r FROM region_members JOIN docs USING (chunk_id)) WHERE r <= 15 GROUP BY region_id) USING (region_id)""",
        "region_members", "docs",
    ),
    "transcript_digests": _o("SELECT source_file, chunk_count, title, abstract, keywords FROM tdig", "tdig", **_TD),
    "digest_text": _o(
        "SELECT source_file, concat_ws(chr(10), nullif(title, ''), CASE WHEN chunk_count % 2 = 0 THEN NULL ELSE nullif(abstract, '') END, nullif(keywords, '')) AS text FROM tdig", "tdig", **_TD
    ),
    "region_links": _o("SELECT region_a, region_b, round(weight, 5) AS weight FROM rlink", "rlink"),
    "chunk_edges": _o("SELECT a, b, round(weight, 6) AS weight FROM cedge", "cedge", **_knn("vecs", 6, 0.35)),
    "chunk_edges_top": _o(
        "SELECT a, b, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (ORDER BY round(weight, 9) DESC, a, b) AS r, count(*) OVER () AS n FROM cedge) WHERE r <= ceil(n * 0.25)",
        "cedge", **_knn("vecs", 6, 0.35),
    ),
    "transcript_edges": _o("SELECT a, b, round(weight, 6) AS weight FROM tedge", "tedge", **_knn("vecs", 6, 0.35), **_tedge(4)),
    "tag_files": _o("SELECT source_file, rank, region_id, round(share, 6) AS share FROM ftags", "ftags", **_TAGS),
    "labels_missing": _o("SELECT chunk_id FROM docs WHERE chunk_id NOT IN (SELECT chunk_id FROM labs WHERE source LIKE 'llm:%')", "docs", "labs"),
    "query_themes": _o(
        """SELECT query_id, CASE WHEN vec[1] < 0 THEN 0 ELSE 1 END AS cluster, length(text) || ' letters' AS label, chunk_id, 1.0::DOUBLE AS confidence
        FROM bm_ranked JOIN vecs USING (chunk_id) JOIN q USING (query_id) WHERE rank <= 20""", "bm_ranked", "vecs", "q"
    ),
    "digests_by_summariser": _o(
        """SELECT source_file, count(*) AS chunk_count, sum(length(content)) || ' letters' AS title, md5(first(content ORDER BY start_offset, chunk_id)) AS abstract, 'k' AS keywords, 'own' AS source
        FROM live WHERE source_file <> '' GROUP BY source_file""", "live"
    ),
    "upsert_labels": _o(
        """SELECT chunk_id, label, source FROM labs WHERE chunk_id NOT IN (SELECT chunk_id FROM fresh) UNION ALL SELECT * FROM fresh""",
        "labs", "fresh",
        fresh=(("docs", "labs"), "SELECT chunk_id, content AS label, 'llm:n' AS source FROM docs WHERE chunk_id NOT IN (SELECT chunk_id FROM labs WHERE source LIKE 'llm:%') AND NOT starts_with(content, 'T')"),
    ),
    "get_labels": _o("SELECT chunk_id, label, source FROM labs WHERE chunk_id IN (SELECT 'd' || lpad(vec_id::VARCHAR, 8, '0') FROM embeddings)", "labs"),
    "parse_digest_replies": """SELECT doc_id, array_to_string(regexp_extract_all(text, '[A-Za-z]+')[1:8], ' ') AS title, 'about ' || source AS abstract, lang || '|' || lower(source) AS keywords
      FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z]+')) > 0 UNION ALL SELECT doc_id, 'second', 'about ' || source, lang || '|' || lower(source) FROM documents WHERE len(regexp_extract_all(text, '[A-Za-z]+')) = 0""",
    "parse_label_replies": """SELECT doc_id, 'fine' AS l1, array_to_string(regexp_extract_all(source || ' is in ' || lang || ' one two three four', '\\S+')[1:6], ' ') AS l2, '' AS l3 FROM documents""",
    "parse_cluster_replies": """SELECT doc_id // 10 AS reply_id, CASE WHEN doc_id % 10 = 5 THEN 2 ELSE 0 END AS cluster, CASE WHEN doc_id % 10 = 5 THEN 'Topic — Topic' ELSE 'Topic — ' || h.lang END AS label,
      'd' || lpad(d.doc_id::VARCHAR, 8, '0') AS chunk_id, CASE WHEN doc_id % 10 = 5 THEN 0.0 ELSE 0.5 END AS confidence
      FROM documents d JOIN (SELECT doc_id // 10 AS reply_id, lang FROM documents WHERE doc_id % 10 = 0) h ON h.reply_id = d.doc_id // 10 WHERE doc_id % 10 IN (0, 3, 5)""",
    "parse_span_replies": """SELECT r AS reply_id, i AS ord, CASE WHEN error IS NULL THEN ['chunk', 'glue', 'chunk'][i + 1] END AS type, CASE WHEN error IS NULL AND i = 0 THEN 'd' || lpad((r * 10 + 2)::VARCHAR, 8, '0') END AS chunk_id,
      CASE WHEN error IS NULL THEN ['a', ' and ', 'b'][i + 1] END AS text, error
      FROM (SELECT r, CASE WHEN r % 7 = 0 THEN 'invalid JSON' WHEN r % 5 = 0 THEN 'unknown span type' END AS error, unnest(range(CASE WHEN r % 7 = 0 OR r % 5 = 0 THEN 1 ELSE 3 END)) AS i
      FROM (SELECT doc_id // 10 AS r FROM documents WHERE doc_id % 10 = 0))""",
    "current_build": _o(
        "SELECT 'b3' AS build_id, region_id, title, chunk_count, chunk_id FROM lreg JOIN members USING (region_id) WHERE substring(region_id, 2)::INT >= 3", "lreg", "members"
    ),
    "build_counts": _o(
        """SELECT build_id, (SELECT count(*) FROM lreg WHERE 'b' || least(substring(region_id, 2)::INT, 3) = build_id) AS regions, (SELECT count(*) FROM members WHERE 'b' || least(substring(region_id, 2)::INT, 3) = build_id) AS chunks,
        (SELECT count(*) FROM rlink WHERE 'b' || least(substring(region_a, 2)::INT, substring(region_b, 2)::INT, 3) = build_id) AS links FROM builds""",
        "builds", "lreg", "members", "rlink",
    ),
    "staleness": _o(
        """SELECT e AS embedded, b AS built, e - b AS behind, (e - b) * 10 > b AS stale FROM (SELECT (SELECT count(*) FROM live WHERE len(vec) > 0) AS e, (SELECT count(*) FROM vecs WHERE label < 8) AS b)""", "live", "vecs"
    ),
    "network_payload": oracle(
        """SELECT source_file, CASE WHEN len(kl) > 0 THEN array_to_string(kl[1:3], ' · ') ELSE source_file END AS label, n AS chunks, coalesce(tags, '') AS tags
        FROM (SELECT source_file, count(*) AS n FROM src WHERE chunk_id IN (SELECT chunk_id FROM members) GROUP BY source_file) LEFT JOIN (SELECT source_file, string_agg(region_id, ' ' ORDER BY rank) AS tags FROM ftags GROUP BY source_file) USING (source_file) LEFT JOIN tdig USING (source_file)""",
        "src", "members", "ftags", "tdig", extra={**_EX, **_TD, **_TAGS},
    ),
    "network_payload_edges": _o("SELECT a, b, round(weight, 6) AS weight FROM tedge", "tedge", **_knn("vecs", 10, 0.3), **_tedge(12)),
    "region_detail": _o(
        f"""SELECT region_id, chunk_id, coalesce(label, {_runes('content', 320)}) AS text, round(distance, 5) AS w FROM region_members JOIN docs USING (chunk_id) LEFT JOIN labs USING (chunk_id)
        UNION ALL SELECT x.region_id, other, title, round(weight, 5) FROM (SELECT region_a AS region_id, region_b AS other, weight FROM rlink UNION ALL SELECT region_b, region_a, weight FROM rlink) x JOIN lreg ON lreg.region_id = other""",
        "region_members", "docs", "labs", "rlink", "lreg",
    ),
    "transcript_detail": _o(
        f"SELECT source_file, start_offset, chunk_id, coalesce(label, {_runes('content', 60)}) AS summary FROM live LEFT JOIN labs USING (chunk_id)", "live", "labs"
    ),
}
