"""Registered queries: text and vector scalars (C1-C21)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanlake.functions import conditions as cond
from spanlake.functions import text as tx
from spanlake.functions import vectors as vx
from spanlake.functions.wordlists import FILLER_WORDS, LABEL_STOP_WORDS, QUERY_STOP_WORDS
from spanlake.operators import transcripts as tr
from spanlake.plans import fixtures as fx
from spanlake.plans.fixtures import NON_WS_SQL, WS_SQL, _quoted, oracle


def _docs(spark, sf):
    return fx.docs(spark, sf)


def _sum_text(name):
    return F.sha2(F.array_join(name, "|"), 256)


def tokenize(spark, sf):
    return _docs(spark, sf).withColumn("t", tx.tokenize("content")).select(
        "chunk_id", F.size("t").alias("n"), _sum_text("t").alias("digest")
    )


def tokenize_spans(spark, sf):
    t = _docs(spark, sf).select("chunk_id", F.explode(tx.tokenize_spans("content")).alias("t"))
    return t.select("chunk_id", "t.term", "t.start", "t.end")


def terms_tfidf(spark, sf):
    return _docs(spark, sf).withColumn("t", tx.terms_tfidf("content")).select(
        "chunk_id", F.size("t").alias("n"), _sum_text("t").alias("digest")
    )


def _raw(spark, sf):
    """Documents and whole pages as raw transcripts; page markup has blank lines and odd spacing."""
    d = fx.table(spark, sf, "documents").select(F.concat(F.lit("doc"), "doc_id").alias("source_file"), F.col("text").alias("raw"))
    p = fx.table(spark, sf, "pages").select(
        F.concat(F.lit("page"), "page_id").alias("source_file"), F.regexp_replace("html", "<p>", "\r\n\r\n<p>").alias("raw")
    )
    return d.unionByName(p)


def _dealt(df, partitions):
    """A table of few file splits dealt to ``partitions`` tasks; as it is read if None."""
    return df.repartition(partitions) if partitions else df


def parse_transcript(spark, sf, partitions=None):
    return tr.parse_transcript(_dealt(_raw(spark, sf), partitions))


def sentence_spans(spark, sf):
    s = _docs(spark, sf).select("chunk_id", F.posexplode(tx.sentence_spans("content")).alias("sent", "s"))
    return s.select("chunk_id", "sent", "s.start", "s.end")


def first_sentences(spark, sf):
    return _docs(spark, sf).select("chunk_id", tx.first_sentences("content", 2).alias("abstract"))


def chunk_transcript(spark, sf, partitions=None):
    return tr.chunk_raw(_dealt(_raw(spark, sf), partitions)).select("source_file", "start_offset", "end_offset", F.md5("content").alias("content_md5"))


def chunk_segments(spark, sf):
    s = fx.segments(spark, sf).select(F.col("upload_id").alias("source_file"), "ord", tx.collapse_ws("text").alias("text"))
    return tr.chunk_transcript(s).select("source_file", "start_offset", "end_offset", F.md5("content").alias("content_md5"))


def token_windows(spark, sf):
    w = _docs(spark, sf).select("chunk_id", F.explode(tx.token_windows("content")).alias("w"))
    return w.select("chunk_id", "w.start_token", "w.text")


def token_windows_resume(spark, sf):
    """Windows of the labelled documents are already written; the rest is still to do."""
    w = token_windows(spark, sf)
    done = fx.table(spark, sf, "labels").select(fx.chunk_key(F.col("doc_id")).alias("chunk_id"))
    return tr.remaining_windows(w, w.join(done, "chunk_id", "left_semi"), ["chunk_id", "start_token"])


def chunk_passages(spark, sf):
    p = _docs(spark, sf).select("chunk_id", F.explode(tx.chunk_passages("content")).alias("p"))
    return p.select("chunk_id", "p.start", "p.end", "p.text")


def passage_id(spark, sf):
    p = chunk_passages(spark, sf).withColumn("key", tx.passage_id("chunk_id", "start", "end"))
    return p.select(F.sha2("key", 256).alias("key_hash"), tx.split_passage_id("key").alias("k")).select(
        "key_hash", "k.chunk_id", "k.start", "k.end"
    )


def split_passage_id(spark, sf):
    """Keys with a degenerate span or a missing part are refused."""
    d = fx.table(spark, sf, "documents")
    key = F.when(F.col("doc_id") % 3 == 0, F.concat_ws("\x00", "source", F.col("n_chars").cast("string"))).otherwise(
        F.concat_ws("\x00", "source", (F.col("n_chars") % 7).cast("string"), (F.col("doc_id") % 11).cast("string"))
    )
    return d.select("doc_id", tx.split_passage_id(key).alias("k")).select("doc_id", "k.chunk_id", "k.start", "k.end")


def _bench(spark, sf, *cols):
    return fx.table(spark, sf, "benchmark").select("item_id", *cols)


def extract_keywords(spark, sf):
    return _docs(spark, sf).select("chunk_id", tx.extract_keywords("content").alias("keywords"))


def clean_query(spark, sf):
    return _docs(spark, sf).select("chunk_id", tx.clean_query(F.concat(F.lit("  "), "content")).alias("query"))


def expand_queries(spark, sf):
    from spanlake.operators.fusion import expand_queries as op

    d = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("node_id"),
        F.when(F.col("doc_id") % 10 == 0, " ").otherwise(F.substring("text", 1, 50)).alias("title"),
        F.expr("substring(text, 51)").alias("body"),
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("parent_title"),
    )
    return op(d)


def label_texts(spark, sf):
    return _docs(spark, sf).select(
        "chunk_id",
        tx.title_case("content").alias("title_case"),
        tx.trim_words("content", 8).alias("trim_words"),
        tx.head_label("content").alias("head_label"),
        tx.preview_text("content", 80).alias("preview_text"),
        tx.trim_runes("content", 60).alias("trim_runes"),
        tx.collapse_ws("content").alias("collapse_ws"),
        tx.slugify("content").alias("slugify"),
    )


def locate_selection(spark, sf):
    """Every fifth selection has its spaces doubled, every seventh is not in the text."""
    d = fx.table(spark, sf, "documents")
    piece = F.substring(F.col("text"), F.lit(11), F.lit(60))
    sel = (
        F.when(F.col("doc_id") % 7 == 0, F.concat(piece, F.lit("#absent")))
        .when(F.col("doc_id") % 5 == 0, F.regexp_replace(piece, " ", " \n "))
        .otherwise(piece)
    )
    return d.select("doc_id", tx.locate_selection(F.col("text"), sel).alias("s")).select("doc_id", "s.start", "s.end")


def snippet_segments(spark, sf):
    """Mark every third token of a window in the middle of each document."""
    d = _docs(spark, sf).withColumn("t", tx.tokenize_spans("content"))
    hits = F.transform(
        F.filter("t", lambda x, i: i % 3 == 0), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
    )
    half = (F.char_length("content") / 2).cast("int")
    segs = tx.snippet_segments(F.col("content"), F.greatest(half - 160, F.lit(0)), half + 160, hits)
    return d.select("chunk_id", F.posexplode(segs).alias("i", "s")).select("chunk_id", "i", "s.text", "s.mark")


def encode_vec(spark, sf):
    v = fx.vectors(spark, sf).withColumn("blob", vx.encode_vec("vec"))
    back = F.aggregate(F.zip_with("vec", vx.decode_vec("blob"), lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    return v.select("chunk_id", F.octet_length("blob").alias("bytes"), back.alias("error"))


def cosine(spark, sf):
    v = fx.vectors(spark, sf)
    c = fx.members(spark, sf).select("chunk_id", F.col("vec").alias("other"))
    pairs = v.withColumn("other_id", fx.chunk_key(F.col("label"))).join(
        c.withColumnRenamed("chunk_id", "other_id"), "other_id"
    )
    return pairs.select("chunk_id", "other_id", F.round(vx.cosine("vec", "other"), 6).alias("cosine"))


def stub_embed(spark, sf):
    e = _docs(spark, sf).select("chunk_id", vx.stub_embed("content", 64).alias("vec"))
    return e.select("chunk_id", F.size("vec").alias("dim"), F.round(vx.dot("vec", "vec"), 4).alias("norm"))


def eval_condition(spark, sf):
    """Conditions spelled from event types, contexts from the users that raised them."""
    e = fx.table(spark, sf, "events")
    k = F.col("event_id") % 8
    c = (
        F.when(k == 0, "")
        .when(k == 1, F.concat(F.lit("audience=="), F.upper("event_type")))
        .when(k == 2, F.concat(F.lit("audience!="), F.col("event_type")))
        .when(k == 3, F.concat(F.lit("has_read( n"), (F.col("user_id") % 5).cast("string"), F.lit(" )")))
        .when(k == 4, F.concat(F.lit("!has_read(n"), (F.col("user_id") % 5).cast("string"), F.lit(")")))
        .when(k == 5, F.concat(F.lit("label.kind=="), F.col("event_type")))
        .when(k == 6, "label.other==")
        .otherwise("whatever")
    )
    ctx_read = F.array(F.lit("n1"), F.lit("n3"))
    labels = F.create_map(F.lit("kind"), F.lit("click"))
    return e.select("event_id", cond.eval_condition(c, F.lit("click"), ctx_read, labels).alias("holds"))


def excerpt_diverges(spark, sf):
    ev = fx.evidence(spark, sf)
    d = fx.docs(spark, sf)
    return ev.join(d, "chunk_id").select(
        "evidence_id",
        cond.excerpt_diverges(F.col("text"), F.col("char_start"), F.col("char_end"), F.col("content")).alias("diverges"),
    )


QUERIES = {
    "tokenize": tokenize,
    "tokenize_spans": tokenize_spans,
    "terms_tfidf": terms_tfidf,
    "parse_transcript": parse_transcript,
    "sentence_spans": sentence_spans,
    "first_sentences": first_sentences,
    "chunk_transcript": chunk_transcript,
    "chunk_transcript_segments": chunk_segments,
    "token_windows": token_windows,
    "token_windows_resume": token_windows_resume,
    "chunk_passages": chunk_passages,
    "passage_id": passage_id,
    "split_passage_id": split_passage_id,
    "extract_keywords": extract_keywords,
    "clean_query": clean_query,
    "expand_queries": expand_queries,
    "label_texts": label_texts,
    "locate_selection": locate_selection,
    "snippet_segments": snippet_segments,
    "encode_vec": encode_vec,
    "cosine": cosine,
    "stub_embed": stub_embed,
    "eval_condition": eval_condition,
    "excerpt_diverges": excerpt_diverges,
}

_TOK = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{Nd}}]+')"
_TRIM = "regexp_replace({c}, '^" + WS_SQL + "+|" + WS_SQL + "+$', '', 'g')"
_WORDS = "regexp_extract_all({c}, '" + NON_WS_SQL + "+')"


def _trim(c):
    return _TRIM.replace("{c}", c)


def _words(c):
    return _WORDS.replace("{c}", c)


def _flat(c):
    return f"array_to_string({_words(c)}, ' ')"


def _runes(c, n):
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE {_trim(f'substring({c}, 1, {n})')} || '…' END"


_RAW_SQL = """SELECT 'doc' || doc_id AS source_file, text AS raw FROM documents
UNION ALL SELECT 'page' || page_id, replace(html, '<p>', chr(13) || chr(10) || chr(13) || chr(10) || '<p>') FROM pages"""

_PARSE = {
    "rawt": ((), _RAW_SQL),
    "sents": (
        ("rawt",),
        rf"""SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY pi, si) - 1 AS ord, text FROM (
        SELECT source_file, pi, generate_subscripts(ss, 1) AS si, {_trim(r"regexp_replace(unnest(ss), '[ \t\r\n]+', ' ', 'g')")} AS text FROM (
        SELECT source_file, generate_subscripts(ps, 1) AS pi, string_split(regexp_replace(unnest(ps), '([.!?])([ \n\t])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ss
        FROM (SELECT source_file, regexp_split_to_array(replace(raw, chr(13) || chr(10), chr(10)), '\n[ \t]*\n+') AS ps FROM rawt))) WHERE text <> ''""",
    ),
}



def _chunk_sql(sents: str) -> dict:
    """Greedy chunks as a walk over a source's sentences: words so far and the chunk's first sentence."""
    return {
        "sw": ((sents,), f"SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY ord) - 1 AS pos, text, len({_words('text')}) AS nw, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY source_file ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM {sents}"),
        "walk": (("sw",), """SELECT source_file, pos, nw::BIGINT AS acc, 0::BIGINT AS first FROM sw WHERE pos = 0
        UNION ALL SELECT w.source_file, s.pos, CASE WHEN w.acc >= 160 THEN s.nw ELSE w.acc + s.nw END, CASE WHEN w.acc >= 160 THEN s.pos ELSE w.first END FROM walk w JOIN sw s ON s.source_file = w.source_file AND s.pos = w.pos + 1"""),
        "tchunk": (("walk", "sw"), "SELECT source_file, min(b) AS start_offset, max(b + strlen(text)) AS end_offset, md5(string_agg(text, ' ' ORDER BY pos)) AS content_md5 FROM walk JOIN sw USING (source_file, pos) GROUP BY source_file, first"),
    }


_SEG_SENTS = {"segt": (("segments",), f"SELECT upload_id AS source_file, ord, {_flat('text')} AS text FROM segments")}
_TITLE = "array_to_string(list_transform(string_split({c}, ' '), lambda w: CASE WHEN w[1] = 'ß' THEN w ELSE upper(substring(w, 1, 1)) || substring(w, 2) END), ' ')"

ORACLES = {
    "tokenize": f"SELECT chunk_id, len(t) AS n, sha256(array_to_string(t, '|')) AS digest FROM (SELECT chunk_id, {_TOK.format(c='content')} AS t FROM ({fx.ORACLE['docs'][1]}))",
    "tokenize_spans": oracle('SELECT chunk_id, term, s AS "start", e AS "end" FROM toks', "toks"),
    "terms_tfidf": f"""SELECT chunk_id, len(t) AS n, sha256(array_to_string(t, '|')) AS digest FROM (SELECT chunk_id, list_filter(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+'),
      lambda x: strlen(x) BETWEEN 3 AND 30 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ({_quoted(LABEL_STOP_WORDS)})) AS t FROM ({fx.ORACLE['docs'][1]}))""",
    "parse_transcript": oracle("SELECT source_file, ord, text FROM sents", "sents", extra=_PARSE),
    "sentence_spans": oracle(
        'SELECT chunk_id, sent, s AS "start", e AS "end" FROM sent', "sent", extra={
            "bounds": (("docs",), r"""SELECT chunk_id, i - 1 AS k, e - length(p) AS a, e, p FROM (SELECT chunk_id, p, i, sum(length(p)) OVER (PARTITION BY chunk_id ORDER BY i) AS e FROM (
            SELECT chunk_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT chunk_id, string_split(regexp_replace(content, '([.!?])([ \n\t])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS ps FROM docs)))"""),
            "sent": (("bounds",), rf"""SELECT chunk_id, row_number() OVER (PARTITION BY chunk_id ORDER BY k) - 1 AS sent, (a + length(p) - length(regexp_replace(p, '^{WS_SQL}+', '')))::INT AS s, e::INT AS e
            FROM bounds WHERE regexp_matches(p, '{NON_WS_SQL}')"""),
        }
    ),
    "chunk_transcript": oracle("SELECT * FROM tchunk", "tchunk", extra={**_PARSE, **_chunk_sql("sents")}),
    "chunk_transcript_segments": oracle("SELECT * FROM tchunk", "tchunk", extra={**_SEG_SENTS, **_chunk_sql("segt")}),
    "encode_vec": oracle("SELECT chunk_id, 4 * len(vec) AS bytes, 0.0 AS error FROM vecs", "vecs"),
    "stub_embed": oracle("SELECT chunk_id, 64 AS dim, 1.0 AS norm FROM docs", "docs"),
    "first_sentences": rf"""SELECT chunk_id, CASE WHEN len(p) > 1 THEN array_to_string(p[1:least(2, len(p) - 1)], ' ') ELSE {_runes('flat', 280)} END AS abstract
      FROM (SELECT chunk_id, flat, string_split(regexp_replace(flat, '([.!?])( |$)', '\1' || chr(1), 'g'), chr(1)) AS p FROM (SELECT chunk_id, {_flat('content')} AS flat FROM ({fx.ORACLE['docs'][1]})))""",
    "token_windows": f"""SELECT chunk_id, st AS start_token, array_to_string(w[st + 1:st + 300], ' ') AS text FROM (
      SELECT chunk_id, w, unnest(range(0, len(w), 150)) AS st FROM (SELECT chunk_id, {_words('content')} AS w FROM ({fx.ORACLE['docs'][1]})))""",
    "token_windows_resume": f"""SELECT chunk_id, st AS start_token, array_to_string(w[st + 1:st + 300], ' ') AS text FROM (
      SELECT chunk_id, w, unnest(range(0, len(w), 150)) AS st FROM (SELECT chunk_id, {_words('content')} AS w FROM ({fx.ORACLE['docs'][1]})
      WHERE chunk_id NOT IN (SELECT 'd' || lpad(doc_id::VARCHAR, 8, '0') FROM labels)))""",
    "chunk_passages": oracle('SELECT chunk_id, s AS "start", e AS "end", text FROM psg', "psg"),
    "passage_id": oracle(
        'SELECT sha256(chunk_id || chr(0) || s || chr(0) || e) AS key_hash, chunk_id, s AS "start", e AS "end" FROM psg', "psg"
    ),
    "split_passage_id": """SELECT doc_id, CASE WHEN ok THEN source END AS chunk_id, CASE WHEN ok THEN n_chars % 7 END AS "start", CASE WHEN ok THEN doc_id % 11 END AS "end"
      FROM (SELECT *, doc_id % 3 <> 0 AND doc_id % 11 > n_chars % 7 AS ok FROM documents)""",
    "extract_keywords": f"SELECT chunk_id, array_to_string(list_filter({_TOK.format(c='content')}, lambda x: x NOT IN ({_quoted(QUERY_STOP_WORDS)})), ' ') AS keywords FROM ({fx.ORACLE['docs'][1]})",
    "clean_query": f"""SELECT chunk_id, CASE WHEN k = '' THEN {_trim('content')} ELSE k END AS query FROM (SELECT chunk_id, content, coalesce((
      SELECT string_agg(term, ' ' ORDER BY i) FROM (SELECT term, min(i) AS i FROM (SELECT unnest(t) AS term, generate_subscripts(t, 1) AS i) WHERE strlen(term) >= 2 AND term NOT IN ({_quoted(QUERY_STOP_WORDS + FILLER_WORDS)}) GROUP BY term)), '') AS k
      FROM (SELECT chunk_id, content, {_TOK.format(c='content')} AS t FROM ({fx.ORACLE['docs'][1]})))""",
    "expand_queries": f"""SELECT node_id, unnest(v) AS query, generate_subscripts(v, 1) - 1 AS variant FROM (SELECT node_id, list_filter([t,
      CASE WHEN kw <> t AND kw <> '' THEN kw END,
      CASE WHEN b <> '' THEN t || ' ' || CASE WHEN strlen(b) <= 200 THEN b ELSE substring(b, 1, list_max(list_filter(range(1, 201), lambda i: strlen(substring(b, 1, i)) <= 200))) END END,
      CASE WHEN p <> '' THEN p || ' ' || t END], lambda x: x IS NOT NULL) AS v FROM (SELECT *, array_to_string(list_filter({_TOK.format(c='t')}, lambda x: x NOT IN ({_quoted(QUERY_STOP_WORDS)})), ' ') AS kw
      FROM (SELECT doc_id AS node_id, {_trim("CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE substring(text, 1, 50) END")} AS t, {_trim('substring(text, 51)')} AS b,
      coalesce(CASE WHEN doc_id % 3 = 0 THEN source END, '') AS p FROM documents) WHERE t <> ''))""",
    "label_texts": f"""SELECT chunk_id, {_TITLE.format(c='content')} AS title_case, array_to_string({_words('content')}[1:8], ' ') AS trim_words,
      array_to_string({_words('content')}[1:6], ' ') AS head_label, CASE WHEN length(content) <= 80 THEN content ELSE substring(content, 1, 80) || '…' END AS preview_text,
      {_runes('content', 60)} AS trim_runes, {_flat('content')} AS collapse_ws, regexp_replace(translate(lower(content), ' _', '--'), '[^a-z0-9-]', '', 'g') AS slugify
      FROM ({fx.ORACLE['docs'][1]})""",
    "locate_selection": f"""SELECT doc_id, CASE WHEN sel = '' THEN NULL WHEN instr(text, sel) > 0 THEN instr(text, sel) - 1 WHEN hit <> '' THEN instr(text, hit) - 1 END AS "start",
        CASE WHEN sel = '' THEN NULL WHEN instr(text, sel) > 0 THEN instr(text, sel) - 1 + length(sel) WHEN hit <> '' THEN instr(text, hit) - 1 + length(hit) END AS "end"
        FROM (SELECT *, regexp_extract(text, array_to_string(list_transform({_words('sel')}, lambda x: regexp_escape(x)), '{WS_SQL}+')) AS hit FROM (
        SELECT doc_id, text, {_trim("CASE WHEN doc_id % 7 = 0 THEN substring(text, 11, 60) || '#absent' WHEN doc_id % 5 = 0 THEN replace(substring(text, 11, 60), ' ', ' ' || chr(10) || ' ') ELSE substring(text, 11, 60) END")} AS sel FROM documents))""",
    "cosine": oracle(
        """SELECT a.chunk_id, b.chunk_id AS other_id, round(list_dot_product(a.vec, b.vec) / sqrt(list_dot_product(a.vec, a.vec)) / sqrt(list_dot_product(b.vec, b.vec)), 6) AS cosine
        FROM vecs a JOIN vecs b ON b.chunk_id = 'd' || lpad(a.label::VARCHAR, 8, '0')""",
        "vecs",
    ),
    "eval_condition": """SELECT event_id, CASE event_id % 8 WHEN 1 THEN event_type = 'click' WHEN 2 THEN event_type <> 'click' WHEN 3 THEN user_id % 5 IN (1, 3)
      WHEN 4 THEN user_id % 5 NOT IN (1, 3) WHEN 5 THEN event_type = 'click' ELSE true END AS holds FROM events""",
    "excerpt_diverges": oracle(
        """SELECT evidence_id, CASE WHEN char_end > length(content) THEN text <> content ELSE substring(content, char_start + 1, char_end - char_start) <> text END AS diverges
        FROM evidence JOIN docs USING (chunk_id)""",
        "evidence",
        "docs",
    ),
}
