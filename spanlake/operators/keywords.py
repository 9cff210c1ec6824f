"""Corpus keywords: document frequency and linear tf-idf, per chunk or per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions.text import first_sentences, is_label_term, title_case
from spanlake.operators.lexical import count_terms
from spanlake.ordered import top_k
from spanlake.runtime import cut, has_at_most, salt_of

SALTS = 16
SMALL_VOCABULARY = 2_000_000  # terms whose document frequency may be broadcast


def _raw_terms(text: str):
    return F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def keyword_df(chunks: DataFrame, text: str = "content") -> DataFrame:
    """(term, df): chunks holding each label term. Repeats are dropped inside the row.

    Exploding outer keeps the optimizer from evaluating the pattern a second time in a scan filter.
    """
    terms = chunks.select(text).select(F.explode_outer(F.array_distinct(_raw_terms(text))).alias("term"))
    return terms.filter(is_label_term(F.col("term"))).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_counts(texts: DataFrame, group: Sequence[str], text: str = "content") -> DataFrame:
    """(*group, term, tf). A chunk is one text, so its terms are counted where it is read, without a shuffle."""
    rows = texts.select(*group, text)
    if list(group) == ["chunk_id"]:
        toks = F.coalesce(F.filter(_raw_terms(text), is_label_term), F.array().cast("array<string>"))
        return count_terms(rows.select("chunk_id", toks.alias("toks")), group).select("chunk_id", "term", "tf")
    terms = rows.select(*group, F.explode_outer(_raw_terms(text)).alias("term"))
    return terms.filter(is_label_term(F.col("term"))).groupBy(*group, "term").agg(F.count(F.lit(1)).alias("tf"))


def _leading(n: int):
    """Rows (group, term, score, rounded): the ``n`` best terms of each run of rows with one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            other = pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, batch.num_rows - 1)), True)
            of = np.concatenate([[0], np.cumsum(other.to_numpy(zero_copy_only=False))])
            below = -batch.column("rounded").to_numpy(zero_copy_only=False)
            order = np.lexsort((below, of))
            first = np.flatnonzero(np.concatenate([[True], np.diff(of) > 0]))
            last = np.minimum(first + n, np.append(first[1:], len(of))) - 1
            # terms decide only between those that score like the n-th
            near = np.flatnonzero(below <= below[order[last]][of])
            rows = batch.take(pa.array(near)).append_column("of", pa.array(of[near])).append_column("below", pa.array(below[near]))
            rows = rows.take(pc.sort_indices(rows, [("of", "ascending"), ("below", "ascending"), ("term", "ascending")]))
            of = rows.column("of").to_numpy()
            yield rows.filter(pa.array(np.arange(len(of)) - np.searchsorted(of, of) < n)).select(batch.schema.names[:3])

    return run


def top_keywords(
    texts: DataFrame, df: DataFrame, n_docs: DataFrame, group: Sequence[str], n: int, text: str = "content"
) -> DataFrame:
    """(*group, rank, term, score): the n best terms by tf * (N + 1) / (df + 1), ties alphabetical.

    n_docs: one row (n_docs). A vocabulary of checked size is broadcast; terms of one document need no look-up. A larger
    one is looked up by shuffle, spread over salts since a common term occurs in very many groups. The terms of a chunk stand
    together where they are counted, and only its best are sorted.
    """
    df = cut(df).filter("df > 1")
    tf = term_counts(texts, group, text)
    if has_at_most(df, SMALL_VOCABULARY):
        found = tf.join(F.broadcast(df), "term", "left")
    else:
        freq = df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = tf.withColumn("salt", salt_of(*group, salts=SALTS)).join(freq, ["term", "salt"], "left")
    scored = (
        found
        .crossJoin(F.broadcast(n_docs))  # one row
        .withColumn(
            "score",
            F.col("tf") * ((F.col("n_docs") + 1).cast("double") / (F.coalesce("df", F.lit(1)) + 1)),
        )
    )
    if list(group) == ["chunk_id"]:
        rows = scored.select("chunk_id", "term", "score", F.round("score", 9).alias("rounded"))
        scored = rows.mapInArrow(_leading(n), rows.drop("rounded").schema)
    return top_k(scored, group, [F.round("score", 9).desc(), F.col("term").asc()], n).select(
        *group, "rank", "term", "score"
    )


def as_list(ranked: DataFrame, group: Sequence[str], name: str = "keywords") -> DataFrame:
    """(*group, keywords array): the few ranked terms of each group as a list."""
    return ranked.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias(name)
    )


def corpus_size(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count(F.lit(1)).alias("n_docs"))


def tag_regions(
    regions: DataFrame, members: DataFrame, chunks: DataFrame, per_region: int = 6, per_chunk: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Regions with ``keywords`` filled where empty, members with per-chunk ``keywords``.

    regions: (region_id, keywords, ...), members: (region_id, chunk_id, ...), chunks: (chunk_id, content).
    """
    df, n = keyword_df(chunks), corpus_size(chunks)
    texts = members.select("region_id", "chunk_id").join(chunks.select("chunk_id", "content"), "chunk_id")
    by_chunk = as_list(top_keywords(texts, df, n, ["chunk_id"], per_chunk), ["chunk_id"])
    empty = regions.filter(F.col("keywords").isNull() | (F.size("keywords") <= 0)).select("region_id")
    by_region = as_list(
        top_keywords(texts.join(empty, "region_id", "left_semi"), df, n, ["region_id"], per_region), ["region_id"], "found"
    )
    none = F.array().cast("array<string>")
    tagged = (
        regions.join(by_region, "region_id", "left")
        .withColumn(
            "keywords",
            F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(F.coalesce("found", none)),
        )
        .drop("found")
    )
    return tagged, members.join(by_chunk, "chunk_id", "left").withColumn("keywords", F.coalesce("keywords", none))


def extractive_digest(
    texts: DataFrame, df: DataFrame, n_docs: DataFrame, group: str, order: Sequence[str], keywords: int = 6,
    title_terms: int = 3, n_sentences: int = 2,
) -> DataFrame:
    """(group, title, abstract, keywords, source): top terms and the opening of the first text.

    texts: (group, content, *order); the first text by ``order`` is kept by a partial minimum.
    """
    kw = as_list(top_keywords(texts, df, n_docs, [group], keywords), [group])
    first = texts.groupBy(group).agg(F.min_by("content", F.struct(*order)).alias("content"))
    return first.join(kw, group, "left").select(
        group,
        F.coalesce(title_case(F.array_join(F.slice("keywords", 1, title_terms), " · ")), F.lit("")).alias("title"),
        first_sentences("content", n_sentences).alias("abstract"),
        F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"),
        F.lit("extractive").alias("source"),
    )
