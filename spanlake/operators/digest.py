"""Digests, their content-addressed cache, chunk labels and model reply parsing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import collapse_ws, head_label, strip_reasoning, trim_words, trim_ws
from spanlake.functions.vectors import stub_embed
from spanlake.operators.keywords import corpus_size, extractive_digest, keyword_df
from spanlake.ordered import latest, top_k

Completer = Callable[[str, str], str]
Summariser = Callable[..., DataFrame]
NUL = "\x00"

# ---- cache ---------------------------------------------------------------------------------------


def digest_hash(groups: DataFrame, group: Sequence[str], kind: str, parts: Sequence[str] = ()) -> DataFrame:
    """(*group, input_hash): sha256 over kind, extra parts, the number of chunk ids and sums of their hashes.

    groups: (*group, chunk_id). Sums don't depend on order and are added up before the shuffle, so a
    group of any size is keyed by the same rule and never gathered.
    """
    group = list(group)

    def piece(i: int) -> Column:
        return F.conv(F.substring(F.sha2("chunk_id", 256), 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")

    summed = groups.groupBy(*group).agg(F.count(F.lit(1)).alias("_c"), *[F.sum(piece(i)).alias(f"_s{i}") for i in range(5)])
    text = F.concat_ws(NUL, F.lit(kind), *[F.col(p) for p in parts], F.col("_c").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(5)])
    return summed.select(*group, F.sha2(text, 256).alias("input_hash"))


def reusable(source: Column, has_llm: bool) -> Column:
    """A model's digest is final; an extractive one is kept only while no model is bound."""
    return source.startswith("llm:") | F.lit(not has_llm)


def digest_cache_lookup(hashes: DataFrame, cache: DataFrame, has_llm: bool) -> tuple[DataFrame, DataFrame]:
    """Hits (with the cached digest) and misses of a table holding ``input_hash``."""
    found = cache.filter(reusable(F.col("source"), has_llm)).select(
        "input_hash", "title", "abstract", "keywords", "vec", "source"
    )
    return hashes.join(found, "input_hash"), hashes.join(found.select("input_hash"), "input_hash", "left_anti")


def digest_cache_upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """Cache with the new rows in place of those of equal hash; of several the latest by ``seq``, if there is one."""
    fresh = latest(new.select(*cache.columns, *[c for c in ("seq",) if c in new.columns]), ["input_hash"], "seq").select(*cache.columns)
    return cache.join(fresh.select("input_hash"), "input_hash", "left_anti").unionByName(fresh)


def set_digest_vec(cache: DataFrame, vecs: DataFrame) -> DataFrame:
    """Cache with vectors (input_hash, vec) set on existing rows only."""
    v = vecs.select("input_hash", F.col("vec").alias("_v"))
    return cache.join(v, "input_hash", "left").withColumn("vec", F.coalesce("_v", "vec")).drop("_v")


def digest_text(title: Column, abstract: Column, keywords: Column) -> Column:
    """The embedded form of a digest: non-empty parts, one per line."""

    def part(c: Column) -> Column:
        return F.when(c != "", c)

    return F.concat_ws("\n", part(title), part(abstract), part(F.array_join(keywords, " ")))


# ---- summarising ---------------------------------------------------------------------------------


def digest_with_completer(
    texts: DataFrame, extractive: DataFrame, group: str, order: Sequence[str], complete: Completer,
    model: str = "llm", system: str = "", max_chunks: int = 15,
) -> DataFrame:
    """Digests from a model over each group's first ``max_chunks`` texts, field by field backed by
    the extractive digest; a failing model leaves the extractive one."""
    first = top_k(texts, [group], [F.col(c) for c in order], max_chunks)
    prompts = first.groupBy(group).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", trim_ws("content").alias("t")))),
                lambda s: F.concat(F.lit("["), s["rank"].cast("string"), F.lit("] "), s["t"], F.lit("\n")),
            ),
            "",
        ).alias("prompt")
    )

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies = []
            for prompt in pdf["prompt"]:
                try:
                    replies.append(complete(system, prompt))
                except Exception:  # noqa: BLE001 - any failure of the model means "use the extractive digest"
                    replies.append(None)
            yield pdf.assign(reply=replies)[[group, "reply"]]

    kind = texts.schema[group].dataType.simpleString()
    parsed = parse_digest_replies(prompts.mapInPandas(ask, f"{group} {kind}, reply string"))
    t, a, k = F.nullif("m_title", F.lit("")), F.nullif("m_abstract", F.lit("")), F.col("m_keywords")
    has_k = F.size(k) > 0
    whole = t.isNotNull() & a.isNotNull() & has_k
    return (
        extractive.join(
            parsed.select(
                group, F.col("reply").isNotNull().alias("up"), F.col("title").alias("m_title"),
                F.col("abstract").alias("m_abstract"), F.col("keywords").alias("m_keywords"),
            ),
            group,
            "left",
        )
        .withColumn("up", F.coalesce("up", F.lit(False)))
        .select(
            group,
            F.when(F.col("up"), F.coalesce(t, F.col("title"))).otherwise(F.col("title")).alias("title"),
            F.when(F.col("up"), F.coalesce(a, F.col("abstract"))).otherwise(F.col("abstract")).alias("abstract"),
            F.when(F.col("up") & has_k, k).otherwise(F.col("keywords")).alias("keywords"),
            F.when(~F.col("up"), F.col("source"))
            .when(whole, F.lit(f"llm:{model}"))
            .otherwise(F.lit(f"llm:{model}+extractive"))
            .alias("source"),
        )
    )


def digest_regions(
    members: DataFrame, chunks: DataFrame, cache: DataFrame, complete: Completer | None = None, model: str = "llm",
    embed=stub_embed, n_docs_of: DataFrame | None = None, summarise: Summariser = extractive_digest,
) -> tuple[DataFrame, DataFrame]:
    """Digest every region through the cache: (region_id, title, abstract, keywords, source, vec) and the new cache.

    Only cache misses are summarised, only digests without a vector are embedded; ``embed`` None
    means the embedder is not ready and vectors stay empty. ``summarise`` is called as ``extractive_digest`` is and
    gives its columns.
    """
    corpus = n_docs_of if n_docs_of is not None else chunks
    hashes = digest_hash(members, ["region_id"], "region")
    hit, miss = digest_cache_lookup(hashes, cache, complete is not None)
    texts = (
        members.select("region_id", "chunk_id", "distance")
        .join(miss.select("region_id"), "region_id", "left_semi")
        .join(chunks.select("chunk_id", "content"), "chunk_id")
    )
    order = ["distance", "chunk_id"]
    fresh = summarise(texts, keyword_df(corpus), corpus_size(corpus), "region_id", order)
    if complete is not None:
        fresh = digest_with_completer(texts, fresh, "region_id", order, complete, model)
    fresh = fresh.join(miss, "region_id").withColumn("vec", F.lit(None).cast("array<float>"))
    cols = ["region_id", "input_hash", "title", "abstract", "keywords", "source", "vec"]
    done = hit.select(*cols).unionByName(fresh.select(*cols))
    if embed is not None:
        text = digest_text(F.col("title"), F.col("abstract"), F.col("keywords"))
        needs = F.col("vec").isNull() & (text != "")
        have, need = done.filter(~needs), done.filter(needs)
        done = have.unionByName(need.withColumn("vec", embed(text)))
    new_cache = digest_cache_upsert(cache, done.withColumn("kind", F.lit("region")))
    return done.drop("input_hash"), new_cache


def transcript_digests(
    chunks: DataFrame, cache: DataFrame | None = None, complete: Completer | None = None, model: str = "llm", summarise: Summariser = extractive_digest
) -> DataFrame:
    """(source_file, chunk_count, title, abstract, keywords, source) per source file, blank sources skipped."""
    return transcript_digests_cached(chunks, cache, complete, model, summarise)[0]


def transcript_digests_cached(
    chunks: DataFrame, cache: DataFrame | None = None, complete: Completer | None = None, model: str = "llm", summarise: Summariser = extractive_digest
) -> tuple[DataFrame, DataFrame | None]:
    """What ``transcript_digests`` gives, and the cache with the digests made now; only misses are summarised."""
    rows = chunks.filter(F.coalesce("source_file", F.lit("")) != "")
    counts = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("chunk_count"))
    todo = rows
    hit = None
    if cache is not None:
        hashes = digest_hash(rows.select("source_file", "chunk_id"), ["source_file"], "transcript", ["source_file"])
        hit, miss = digest_cache_lookup(hashes, cache, complete is not None)
        todo = rows.join(miss.select("source_file"), "source_file", "left_semi")
    order = ["start_offset", "chunk_id"]
    made = summarise(todo, keyword_df(rows), corpus_size(rows), "source_file", order)
    if complete is not None:
        made = digest_with_completer(todo, made, "source_file", order, complete, model)
    cols = ["source_file", "title", "abstract", "keywords", "source"]
    out = made.select(*cols)
    if hit is None:
        return counts.join(out, "source_file"), None
    made = made.join(hashes, "source_file").withColumns({"vec": F.lit(None).cast("array<float>"), "kind": F.lit("transcript")})
    return counts.join(out.unionByName(hit.select(*cols)), "source_file"), digest_cache_upsert(cache, made)


# ---- labels --------------------------------------------------------------------------------------


def labels_missing(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """Ids without a final label."""
    return ids.select("chunk_id").distinct().join(labels.filter(F.col("source").startswith("llm:")), "chunk_id", "left_anti")


def upsert_labels(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Labels with the new ones in place of those of the same chunk; of several the latest by ``seq``, if there is one."""
    known = new.filter(F.coalesce("chunk_id", F.lit("")) != "")
    fresh = latest(known.select("chunk_id", "label", "source", *[c for c in ("seq",) if c in new.columns]), ["chunk_id"], "seq")
    return labels.select("chunk_id", "label", "source").join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh)


def get_labels(labels: DataFrame, ids: DataFrame) -> DataFrame:
    return labels.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def label_chunks(chunks: DataFrame, complete: Completer, model: str = "llm", system: str = "", batch: int = 12, max_words: int = 6) -> DataFrame:
    """(chunk_id, label, source) from a completer asked for ``batch`` chunks at a time.

    A chunk the reply leaves out gets its first words and source "head"; a batch whose call fails
    yields no rows, so it is asked again next time.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch].reset_index(drop=True)
                prompt = "".join(f"{i + 1}. {t}\n\n" for i, t in enumerate(part["flat"]))
                try:
                    reply = complete(system, prompt)
                except Exception:  # noqa: BLE001 - a failed batch writes nothing
                    continue
                yield part.assign(n=range(1, len(part) + 1), reply=reply)[["chunk_id", "head", "n", "reply"]]

    asked = chunks.select("chunk_id", collapse_ws("content").alias("flat"), head_label("content", max_words).alias("head"))
    replied = asked.mapInPandas(ask, "chunk_id string, head string, n int, reply string")
    phrase = numbered_phrase(F.col("reply"), F.col("n"), max_words)
    got = phrase.isNotNull() & (phrase != "")
    return replied.select(
        "chunk_id",
        F.when(got, phrase).otherwise(F.col("head")).alias("label"),
        F.when(got, F.lit(f"llm:{model}")).otherwise(F.lit("head")).alias("source"),
    )


# ---- replies -------------------------------------------------------------------------------------


def _lines(reply: Column, junk: str) -> Column:
    junk_ends = f"^[{junk}]+|[{junk}]+$"
    return F.transform(F.split(strip_reasoning(reply), "\n"), lambda x: trim_ws(F.regexp_replace(x, junk_ends, "")))


def _field(lines: Column, *names: str) -> Column:
    wanted = F.filter(lines, lambda x: F.upper(trim_ws(F.substring_index(x, ":", 1))).isin(*names) & x.contains(":"))
    values = F.filter(F.transform(wanted, lambda x: trim_ws(F.regexp_replace(x, r"^[^:]*:", ""))), lambda v: v != "")
    return F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(""))


def parse_digest_replies(replies: DataFrame) -> DataFrame:
    """replies plus title (at most 8 words), abstract and keywords; first of each field wins."""
    lines = _lines(F.col("reply"), "`*#> ")
    kw = F.filter(
        F.transform(F.split(_field(lines, "KEYWORDS", "TAGS"), ","), lambda k: trim_ws(F.lower(k))), lambda k: k != ""
    )
    return replies.withColumns(
        {
            "title": trim_words(_field(lines, "TITLE"), 8),
            "abstract": _field(lines, "ABSTRACT", "SUMMARY"),
            "keywords": F.coalesce(kw, F.array().cast("array<string>")),
        }
    )


def numbered_phrase(reply: Column, n: Column, max_words: int = 6) -> Column:
    """The phrase of line "n. phrase" of a reply, or null; the first such line wins."""
    lines = _lines(reply, "`*#>\\- ")
    pattern = r"^\[?(\d+)[.):\]]\s*(.+?)$"
    mine = F.filter(
        lines,
        lambda x: x.rlike(pattern) & (F.regexp_extract(x, pattern, 1).try_cast("int") == n),
    )
    phrases = F.filter(
        F.transform(
            mine,
            lambda x: trim_words(F.regexp_replace(F.regexp_extract(x, pattern, 2), "^[\"'.]+|[\"'.]+$", ""), max_words),
        ),
        lambda v: v != "",
    )
    return F.try_element_at(phrases, F.lit(1))


def strip_fences(reply: Column) -> Column:
    """Drop a surrounding code fence."""
    t = trim_ws(reply)
    opened = F.regexp_replace(t, r"^```[^\n]*\n", "")
    return F.when(t.startswith("```"), F.regexp_replace(opened, r"\n\s*```[^\n]*$", "")).otherwise(t)


def parse_cluster_replies(replies: DataFrame, inputs: DataFrame) -> DataFrame:
    """(reply_id, cluster, label, chunk_id, confidence) from JSON lists of {label, chunk_indices, confidence}.

    replies: (reply_id, title, reply); inputs: (reply_id, idx, chunk_id). Indices outside the input drop
    out by the join, and with them clusters left empty.
    """
    js = F.from_json(
        strip_fences(F.col("reply")), "array<struct<label:string,chunk_indices:array<int>,confidence:double>>"
    )
    rows = replies.select("reply_id", "title", F.posexplode(js).alias("cluster", "c")).select(
        "reply_id",
        "cluster",
        F.concat(F.col("title"), F.lit(" — "), F.coalesce(F.nullif("c.label", F.lit("")), F.col("title"))).alias("label"),
        F.coalesce("c.confidence", F.lit(0.0)).alias("confidence"),
        F.explode("c.chunk_indices").alias("idx"),
    )
    return rows.join(inputs, ["reply_id", "idx"]).select("reply_id", "cluster", "label", "chunk_id", "confidence")


def parse_span_replies(replies: DataFrame, inputs: DataFrame) -> DataFrame:
    """(reply_id, ord, type, chunk_id, text, error) from JSON lists of {type, index, text}.

    A reply that is not such a list, or holds another type, comes back as one row with ``error``.
    """
    js = F.from_json(strip_fences(F.col("reply")), "array<struct<type:string,index:int,text:string>>")
    staged = replies.select("reply_id", js.alias("spans")).withColumn(
        "error",
        F.when(F.col("spans").isNull(), "invalid JSON").when(
            F.exists("spans", lambda s: ~F.coalesce(s["type"], F.lit("")).isin("chunk", "glue")), "unknown span type"
        ),
    )
    none = F.lit(None).cast("string")
    bad = staged.filter(F.col("error").isNotNull()).select(
        "reply_id", F.lit(0).alias("ord"), none.alias("type"), none.alias("chunk_id"), none.alias("text"), "error"
    )
    rows = staged.filter(F.col("error").isNull()).select("reply_id", F.posexplode("spans").alias("ord", "s"))
    good = (
        rows.withColumn("idx", F.when(F.col("s.type") == "chunk", F.coalesce("s.index", F.lit(0))))
        .join(inputs, ["reply_id", "idx"], "left")
        .select("reply_id", "ord", F.col("s.type").alias("type"), "chunk_id", F.col("s.text").alias("text"), none.alias("error"))
    )
    return good.unionByName(bad)

