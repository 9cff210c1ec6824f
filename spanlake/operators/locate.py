"""Find the relevant span inside each hit: sentence, term-window and semantic locators, snippets."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spanlake.functions.text import (
    _TOKEN_RE,
    clean_query,
    mark_segments,
    sentence_spans,
    snippet_segments,
    spans_of_sentences,
    tokenize,
    tokenize_spans,
    trim_runes,
    trim_ws,
)
from spanlake.functions.vectors import stub_embed
from spanlake.operators.fusion import SearchIndex, match_kind
from spanlake.operators.lexical import idf
from spanlake.operators.paging import hybrid_page
from spanlake.runtime import cut, shuffle_partitions

MAX_WINDOW = 240
SNIPPET = 320
PAIR = ["query_id", "chunk_id"]


def query_weights(queries: DataFrame, index) -> DataFrame:
    """(query_id, term, w): distinct query terms with their idf."""
    terms = queries.select("query_id", F.explode(F.array_distinct(tokenize("text"))).alias("term"))
    return terms.join(idf(terms, index), "term").select(
        "query_id", "term", F.greatest(F.col("idf"), F.lit(0.0)).alias("w")
    )


def pair_tokens(pairs: DataFrame) -> DataFrame:
    """(query_id, chunk_id, term, start, end, sent): tokens of each pair's content.

    pairs: (query_id, chunk_id, content). Spans are scanned once per distinct chunk.
    """
    texts = pairs.select("chunk_id", "content").dropDuplicates(["chunk_id"])
    toks = texts.select("chunk_id", F.explode_outer(tokenize_spans("content")).alias("t")).select("chunk_id", "t.*")
    return pairs.select(*PAIR).join(toks.filter(F.col("term").isNotNull()), "chunk_id")


def _hits(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    return pair_tokens(pairs).join(weights, ["query_id", "term"])


# ---- spans of a chunk for all queries that ask for it ----------------------------------------------

QUERY_BLOCK = 256  # queries of which one task holds the weights at a time
OUT_ROWS = 1 << 16
_UNITS = float(1 << 44)  # sums of a window are taken in whole units, so equal windows tie exactly


def _met(pairs: DataFrame, contents: DataFrame | None, per_query: DataFrame, chunk_rows) -> DataFrame:
    """Chunks with the queries that ask for them, each run of chunks headed by one row of what tasks need to know of
    these queries: (head, said, chunk_id, own, asked), ordered within partitions.

    A chunk travels once for QUERY_BLOCK queries, not once for each pair. pairs: (query_id, chunk_id [, content]); a
    chunk's text is taken from ``contents`` (chunk_id, content), else from the pairs. ``chunk_rows`` makes
    (chunk_id, own) of (chunk_id, content); ``per_query`` has query_id and columns of any kind.
    """
    spark = pairs.sparkSession
    if contents is None:
        contents = pairs.select("chunk_id", "content").distinct()
    known = cut(per_query)
    blocks = max(1, -(-known.select("query_id").distinct().count() // QUERY_BLOCK))
    parts = shuffle_partitions(spark)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    asked = (
        pairs.filter(F.col("query_id").isNotNull())
        .groupBy("chunk_id", block.alias("block"))
        .agg(F.collect_list("query_id").alias("asked"))
    )
    chunks = chunk_rows(contents).join(asked, "chunk_id").select(
        F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part"), "block", F.lit(False).alias("head"),
        "chunk_id", "own", "asked",
    )
    said = known.filter(F.col("query_id").isNotNull()).groupBy(block.alias("block")).agg(F.collect_list(F.struct(*known.columns)).alias("said"))
    heads = said.crossJoin(spark.range(parts).select(F.col("id").cast("int").alias("part"))).withColumn("head", F.lit(True))
    rows = chunks.unionByName(heads, allowMissingColumns=True).repartition(parts, "part", "block")
    order = ["part", "block", F.col("head").desc()]
    return rows.sortWithinPartitions(*order).select("head", "said", "chunk_id", "own", "asked")


def _per_chunk(met: DataFrame, learn, find, fields: T.StructType) -> DataFrame:
    """(query_id, chunk_id, *fields): ``learn`` turns the rows of a head into what ``find`` needs for a chunk.

    find(known, own, asked) gives (query ids, columns) in arrays or lists of one length.
    """
    kinds = {f.name: f.dataType for f in met.schema}
    schema = T.StructType([T.StructField("query_id", kinds["asked"].elementType), T.StructField("chunk_id", kinds["chunk_id"]), *fields.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = None, [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.concat_arrays([h[i] for h in held]) for i in range(len(arrow))], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    if row["head"]:
                        known = learn(row["said"])
                        continue
                    if known is None:  # no query has anything to look for
                        continue
                    ids, columns = find(known, row["own"], row["asked"])
                    if not len(ids):
                        continue
                    one = pa.array([row["chunk_id"]], arrow.field(1).type)
                    chunk = one.take(pa.array(np.zeros(len(ids), np.int8)))
                    held.append([pa.array(ids, arrow.field(0).type), chunk, *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[2:]))])
                    size += len(ids)
                    if size >= OUT_ROWS:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return met.mapInArrow(run, schema)


def _texts(contents: DataFrame) -> DataFrame:
    return contents.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.coalesce("content", F.lit(""))), asc=False).alias("own"))


def _summed(weights: DataFrame) -> DataFrame:
    return weights.groupBy("query_id", "term").agg(F.sum("w").alias("w"), F.count(F.lit(1)).cast("int").alias("n"))


def _learn_weights(said: list[dict]):
    """(place of a query, its id, place of a term, sums of weights, number of weights): terms are rows, queries columns."""
    queries = {q: i for i, q in enumerate(dict.fromkeys(r["query_id"] for r in said))}
    terms = {t: i for i, t in enumerate(dict.fromkeys(r["term"] for r in said))}
    w, n = np.zeros((len(terms), len(queries))), np.zeros((len(terms), len(queries)), np.int64)
    for r in said:
        w[terms[r["term"]], queries[r["query_id"]]] = r["w"]
        n[terms[r["term"]], queries[r["query_id"]]] = r["n"]
    return queries, np.array(list(queries), object), terms, w, n


def _columns(places: dict, asked: list) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the asked queries that are known, and how often each was asked."""
    return np.unique(np.array([places[q] for q in asked if q in places], np.int64), return_counts=True)


def _found_spans(text: str, terms: dict) -> tuple[np.ndarray, ...]:
    """Start and end of all tokens; number, term and sentence of those that are looked for."""
    starts, ends, at, term = [], [], [], []
    for m in _TOKEN_RE.finditer(text):
        t = terms.get(m.group().lower())
        if t is not None:
            at.append(len(starts))
            term.append(t)
        starts.append(m.start())
        ends.append(m.end())
    return tuple(np.array(x, np.int64) for x in (starts, ends, at, term))


def _around(before: list[int], after: list[int], top: tuple[int, int], max_window: int) -> list[tuple[int, int]]:
    """Windows of one best sentence, one for every choice of a start before it and an end after it."""
    out = []
    for n, p in product(after or [None], before or [None]):
        start, end = top
        took = n is not None and n - start <= max_window
        width = n - start if took else end - start
        back = p is not None and width + start - p <= max_window
        out.append((p if back else start, n if took else end))
    return out


def _best_sentences(known, own: list[str], asked: list):
    """Columns, times asked, sentence spans of each text and raw scores (sentence, column) of a chunk."""
    queries, _, terms, w, _ = known
    spans = [spans_of_sentences(t) for t in own]
    cols, times = _columns(queries, asked)
    starts, _, at, term = _found_spans(own[0], terms)
    first = np.array(spans[0], np.int64).reshape(-1, 2)
    sent = np.searchsorted(first[:, 1], starts[at], side="right")
    inside = sent < len(first)
    inside[inside] = starts[at][inside] >= first[sent[inside], 0]
    sent, term = sent[inside], term[inside]
    used, term = np.unique(term, return_inverse=True)
    counts = np.zeros((len(first), len(used)))
    np.add.at(counts, (sent, term), 1)
    return cols, times, spans, counts @ w[np.ix_(used, cols)] * (times * len(own))


def _passages(max_window: int, all_scores: bool):
    def find(known, own, asked):
        cols, times, spans, raw = _best_sentences(known, own, asked)
        if not raw.size:
            return [], []
        best = np.round(raw, 9).argmax(axis=0)
        top = raw[best, np.arange(len(cols))]
        ids, place = known[1], np.array(spans[0], np.int64).reshape(-1, 2)
        if len(own) == 1 and times.max() == 1:
            ok = np.flatnonzero((top > 0) & (place[best, 1] - place[best, 0] <= max_window))
            cols, best, top, raw = cols[ok], best[ok], top[ok], raw[:, ok]
            if all_scores:
                n = len(place)
                grid = np.tile(np.arange(n), len(cols))
                return ids[np.repeat(cols, n)], [grid, place[grid, 0], place[grid, 1], (raw / top).T.ravel()]
            start, end = place[best, 0], place[best, 1]
            after = place[np.minimum(best + 1, len(place) - 1), 1]
            before = place[np.maximum(best - 1, 0), 0]
            took = (best + 1 < len(place)) & (after - start <= max_window)
            width = np.where(took, after, end) - start
            back = (best > 0) & (width + start - before <= max_window)
            return ids[cols], [np.where(back, before, start), np.where(took, after, end), top]
        rows = []  # a chunk or a pair that occurs more than once: every combination of its rows
        for c, (j, b, t, h) in enumerate(zip(cols, best.tolist(), top.tolist(), times.tolist())):
            bounded = [s[b] for s in spans if b < len(s) and s[b][1] - s[b][0] <= max_window] * h if t > 0 else []
            if all_scores:
                one = [(j, i, s, e, raw[i, c] / t if i < len(raw) else 0.0) for text in spans for i, (s, e) in enumerate(text)] if bounded else []
                rows += one * (h * len(bounded))
                continue
            after = [s[b + 1][1] for s in spans if b + 1 < len(s)] * h
            before = [s[b - 1][0] for s in spans if 0 < b <= len(s)] * h
            rows += [(j, *win, t) for own_span in bounded for win in _around(before, after, own_span, max_window)]
        columns = list(zip(*rows))
        return (ids[list(columns[0])], columns[1:]) if rows else ([], [])

    return find


def _windows(max_window: int):
    def find(known, own, asked):
        queries, ids, terms, w, n = known
        cols, times = _columns(queries, asked)
        starts, ends, at, term = _found_spans(own[0], terms)
        if not len(at) or not len(cols):
            return [], []
        s, e = starts[at], ends[at]
        many = n[np.ix_(term, cols)]
        cols, times, many = (x[..., many.any(axis=0)] for x in (cols, times, many))
        if not len(cols):
            return [], []
        units = np.rint(w[np.ix_(term, cols)] * _UNITS).astype(np.int64)
        upto = np.concatenate([np.zeros((1, len(cols)), np.int64), np.cumsum(units, axis=0)])
        # a word longer than the window opens none
        past = np.maximum(np.searchsorted(e, s + max_window, side="right"), np.arange(len(s)))
        sums = (upto[past] - upto[:-1]) / _UNITS * many * (times * len(own)) ** 2
        hit = many > 0
        sums[~hit | (past == np.arange(len(s)))[:, None]] = -1.0
        best, column = np.round(sums, 9).argmax(axis=0), np.arange(len(cols))
        score = sums[best, column]
        latest = np.maximum.accumulate(np.where(hit, np.arange(len(s))[:, None], 0), axis=0)
        found = score >= 0
        best, column, score, cols = best[found], column[found], score[found], cols[found]
        st, last = s[best], e[latest[past[best] - 1, column]]
        slack = np.maximum(max_window - (last - st), 0)
        ws, we = np.maximum(st - slack // 2, 0), np.minimum(last + slack - slack // 2, ends[-1])
        left, right = np.searchsorted(starts, ws) - 1, np.searchsorted(starts, we) - 1
        a = np.where((left >= 0) & (ends[left] > ws), ends[left], ws)
        b = np.where((right >= 0) & (ends[right] > we), starts[right], we)
        return ids[cols], [np.where(a < b, a, ws), np.where(a < b, b, we), score]

    return find


def _learn_vectors(said: list[dict]):
    queries: dict = {}
    for r in said:
        queries.setdefault(r["query_id"], []).append(r["vec"])
    ids = list(queries)
    return {q: i for i, q in enumerate(ids)}, np.array(ids, object), [queries[q] for q in ids]


def _unit_rows(vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Unit rows of each length with their numbers; vectors without direction are left out."""
    by_size: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        if v:
            by_size.setdefault(len(v), []).append(i)
    out = {}
    for size, at in by_size.items():
        m = np.array([vectors[i] for i in at], np.float64)
        norm = np.sqrt((m * m).sum(axis=1))
        keep = norm > 0
        out[size] = (m[keep] / norm[keep, None], np.array(at)[keep])
    return out


def _cosines(a: list, b: list) -> np.ndarray:
    sims = np.zeros((len(a), len(b)))
    left, right = _unit_rows(a), _unit_rows(b)
    for size in left.keys() & right.keys():
        (x, i), (y, j) = left[size], right[size]
        sims[np.ix_(i, j)] = x @ y.T
    return sims


def _similar(floor: float, max_window: int, all_scores: bool):
    def find(known, own, asked):
        places, ids, vectors = known
        cols, times = _columns(places, asked)
        if not own or not len(cols):
            return [], []
        own = sorted(own, key=lambda s: (s["sent"], s["start"], s["end"]))
        several = [len(vectors[j]) for j in cols]
        sims = _cosines([s["svec"] for s in own], [v for j in cols for v in vectors[j]])
        sent, start, end = (np.array([s[c] for s in own], np.int64) for c in ("sent", "start", "end"))
        ends = np.cumsum(several)
        rows = []
        texts: list[list] = []  # sentences by their number, of every text of the chunk
        for s in own:
            texts.extend([] for _ in range(s["sent"] + 1 - len(texts)))
            texts[s["sent"]].append((s["start"], s["end"]))
        for j, h, a, b in zip(cols, times.tolist(), (ends - several).tolist(), ends.tolist()):
            rounded = np.round(sims[:, a:b], 9)
            at, v = np.unravel_index(rounded.argmax(), rounded.shape)
            top = sims[at, a + v]
            if rounded[at, v] < floor:
                continue
            if all_scores:
                score = np.maximum(sims[:, a:b] / top if top > 0 else np.zeros((len(own), b - a)), 0.0)
                many = h * (b - a)
                rows.append((np.full(len(own) * many, j), *(np.tile(x, many) for x in (sent, start, end)), np.tile(score.T.ravel(), h)))
            else:
                after = [e for _, e in (texts[sent[at] + 1] if sent[at] + 1 < len(texts) else [])]
                before = [s for s, _ in (texts[sent[at] - 1] if sent[at] else [])]
                wins = _around(before * h, after * h, (int(start[at]), int(end[at])), max_window)
                rows.append((np.full(len(wins), j), *np.array(wins).T, np.full(len(wins), top)))
        if not rows:
            return [], []
        columns = [np.concatenate(c) for c in zip(*rows)]
        return ids[columns[0]], columns[1:]

    return find

_INT, _DOUBLE = T.IntegerType(), T.DoubleType()
_WINDOW = T.StructType([T.StructField("win_start", _INT), T.StructField("win_end", _INT), T.StructField("score", _DOUBLE)])
_SCORES = T.StructType([T.StructField("sent", _INT), T.StructField("start", _INT), T.StructField("end", _INT), T.StructField("score", _DOUBLE)])


def locate_passage(
    pairs: DataFrame, weights: DataFrame, max_window: int = MAX_WINDOW, contents: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Sentence locator: (pair, win_start, win_end, score) of found pairs, and all sentence scores
    (pair, sent, start, end, score normalised to the best).

    The window is the best sentence plus one neighbour each side while it fits. pairs: (query_id, chunk_id, content),
    the content in ``contents`` (chunk_id, content) if that is given. Sums of weights depend on their order in the last
    bits, so scores are rounded to nine places before anything is compared with them.
    """
    met = _met(pairs, contents, _summed(weights), _texts)
    win = _per_chunk(met, _learn_weights, _passages(max_window, False), _WINDOW)
    scores = _per_chunk(met, _learn_weights, _passages(max_window, True), _SCORES)
    return win, scores.withColumn("score", F.round("score", 9))


def locate_window(
    pairs: DataFrame, weights: DataFrame, max_window: int = MAX_WINDOW, contents: DataFrame | None = None
) -> DataFrame:
    """Term-window locator: (pair, win_start, win_end, score); arguments as in ``locate_passage``."""
    return _per_chunk(_met(pairs, contents, _summed(weights), _texts), _learn_weights, _windows(max_window), _WINDOW)


def semantic_locate(
    pairs: DataFrame, queries: DataFrame, embed=stub_embed, min_similarity: float | None = None,
    max_window: int = MAX_WINDOW, contents: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Sentence locator by cosine of embeddings: windows and normalised sentence scores.

    queries: (query_id, text [, vec]); ``embed`` is a column function for sentence texts, called once for each
    sentence of a chunk. Other arguments as in ``locate_passage``.
    """
    floor = 0.2 if min_similarity is None else min_similarity
    qv = queries if "vec" in queries.columns else queries.withColumn("vec", embed("text"))

    def embedded(texts: DataFrame) -> DataFrame:
        sents = texts.select("chunk_id", "content", F.posexplode(sentence_spans("content")).alias("sent", "s")).select(
            "chunk_id", "sent", "s.start", "s.end",
            F.substring("content", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("stext"),
        )
        sents = sents.withColumn("svec", embed("stext"))
        return sents.groupBy("chunk_id").agg(F.collect_list(F.struct("sent", "start", "end", "svec")).alias("own"))

    met = _met(pairs, contents, qv.select("query_id", "vec"), embedded)
    win = _per_chunk(met, _learn_vectors, _similar(floor, max_window, False), _WINDOW)
    scores = _per_chunk(met, _learn_vectors, _similar(floor, max_window, True), _SCORES)
    return win, scores.withColumn("score", F.round("score", 9))


def _ranks(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first row of each run of equal groups, and the place of every row in its run, from 0."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
    size = np.diff(np.r_[first, len(group)])
    return first, np.arange(len(group)) - np.repeat(first, size)


def _best_groups(pair: np.ndarray, sent, start, end, score, budget: int) -> tuple[np.ndarray, ...]:
    """(row of the pair, ord, start, end, score, focus) of the groups that are kept; ``pair`` grows."""
    by = np.lexsort((sent, pair))
    _, place = _ranks(pair[by])
    isl = sent[by] - place
    by = by[(again := np.lexsort((isl, pair[by])))]
    isl, p = isl[again], pair[by]
    first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (isl[1:] != isl[:-1])])
    row, p = by[first], p[first]
    start, end, score = np.minimum.reduceat(start[by], first), np.maximum.reduceat(end[by], first), np.maximum.reduceat(score[by], first)
    # rows of a pair may repeat: of groups with one score and start the one that begins first comes first
    by = np.lexsort((again[first], start, -np.round(score, 9), p))
    row, p, start, end, score = (x[by] for x in (row, p, start, end, score))
    r = _ranks(p)[1]
    few = r < 3
    row, p, start, end, score, r = (x[few] for x in (row, p, start, end, score, r))
    first, _ = _ranks(p)
    n = np.diff(np.r_[first, len(p)])
    sums = np.concatenate([[0], np.cumsum(end - start + 3)])
    # widths of the best two and three; a third that does not fit is left out
    two, three = (sums[np.minimum(first + k, len(p))] - sums[first] for k in (2, 3))
    takes = np.where((n == 3) & (three <= budget), 3, 2)
    fits = (n >= 2) & (np.where(takes == 3, three, two) <= budget)
    kept = np.repeat(fits, n) & (r < np.repeat(takes, n))
    row, p, start, end, score, r = (x[kept] for x in (row, p, start, end, score, r))
    by = np.lexsort((start, p))
    return row[by], _ranks(p[by])[1] + 1, start[by], end[by], score[by], r[by] == 0


def multi_span_groups(scores: DataFrame, budget: int = SNIPPET, min_score: float = 0.5, together: bool = False) -> DataFrame:
    """The 2-3 best separated sentence groups per pair when they fit the budget:
    (pair, ord, start, end, score, focus).

    scores: (pair, sent, start, end, score to nine places). Groups are runs of consecutive sentences. With ``together``
    the rows of a pair follow one another in one partition, as the locators give them: then they stay where they are.
    """
    kinds = {f.name: f.dataType for f in scores.schema}
    schema = T.StructType(
        [*(T.StructField(c, kinds[c]) for c in PAIR), T.StructField("ord", _INT), T.StructField("start", kinds["start"]),
         T.StructField("end", kinds["end"]), T.StructField("score", _DOUBLE), T.StructField("focus", T.BooleanType())]
    )
    arrow = to_arrow_schema(schema)
    rows = scores.filter(F.round("score", 9) >= min_score).select(*PAIR, "sent", "start", "end", "score")
    if not together:
        rows = rows.repartition(*PAIR).sortWithinPartitions(*PAIR)

    def groups(table: pa.Table, pair: np.ndarray) -> pa.RecordBatch:
        found = _best_groups(pair, *(table.column(c).to_numpy() for c in ("sent", "start", "end", "score")), budget)
        ids = [table.column(c).take(pa.array(found[0])).combine_chunks() for c in PAIR]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) if i > 1 else x for i, (x, f) in enumerate(zip((*ids, *found[1:]), arrow))], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None  # rows of the last pair: it may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if left is None else pa.concat_tables([left, table])
            here, before = table.slice(1), table.slice(0, table.num_rows - 1)
            new = np.zeros(table.num_rows, bool)
            for c in PAIR:
                new[1:] |= pc.not_equal(here.column(c), before.column(c)).to_numpy()
            pair = np.cumsum(new)
            ends = int(np.searchsorted(pair, pair[-1]))
            if ends:
                yield groups(table.slice(0, ends), pair[:ends])
            left = table.slice(ends)
        if left is not None:
            yield groups(left, np.zeros(left.num_rows, np.int64))

    return rows.mapInArrow(run, schema)


def multi_span_snippet(scores: DataFrame, contents: DataFrame, budget: int = SNIPPET) -> DataFrame:
    """(pair, snippet, focus_start, focus_end): "…A … B…" over the kept groups; contents: (chunk_id, content)."""
    groups = multi_span_groups(scores, budget).join(contents, "chunk_id")
    piece = F.struct("ord", F.substring("content", F.col("start") + 1, F.col("end") - F.col("start")).alias("t"))
    # at most three pieces per pair
    return groups.groupBy(*PAIR).agg(
        F.concat(
            F.lit("…"),
            F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["t"]), " … "),
            F.lit("…"),
        ).alias("snippet"),
        F.max(F.when(F.col("focus"), F.col("start"))).alias("focus_start"),
        F.max(F.when(F.col("focus"), F.col("end"))).alias("focus_end"),
    )


def find_evidence(
    bullets: DataFrame,
    index: SearchIndex,
    chunks: DataFrame,
    mode: str = "hybrid",
    page: int = 1,
    page_size: int = 12,
    embed=stub_embed,
) -> DataFrame:
    """One page of located passages per draft bullet.

    bullets: (query_id, text [, vec]); chunks: (chunk_id, source_file, speaker, content). Only the
    rows of the page are ranked, joined to their text and located. Result: (query_id, rank, chunk_id,
    source_file, speaker, score, score_norm, match, how, focus_start, focus_end, snippet, segments,
    total, page, page_size).
    """
    asked = bullets.filter(trim_ws("text") != "")
    cleaned = asked.withColumn("text", clean_query("text"))
    req = cleaned.select("query_id", F.lit(page).alias("page"), F.lit(page_size).alias("page_size"))
    paged = cut(hybrid_page(cleaned, index, req, mode))  # feeds every locator below; at most 100 rows per bullet
    shown = chunks.select("chunk_id", "source_file", "speaker", "content")
    shown = cut(shown.join(paged.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    rows, pairs, contents = paged.join(shown, "chunk_id"), paged.select(*PAIR), shown.select("chunk_id", "content")
    weights = cut(query_weights(cleaned, index.keyword))
    sent_win, sent_scores = locate_passage(pairs, weights, SNIPPET, contents)
    term_win = locate_window(pairs, weights, SNIPPET, contents)
    # the embedding fallback sees only rows without a query term, and the bullet as typed
    lost = pairs.join(term_win.select(*PAIR), PAIR, "left_anti")
    sem_win, sem_scores = semantic_locate(lost, asked.select("query_id", "text"), embed, max_window=SNIPPET, contents=contents)
    hit_spans = _hits(rows.select(*PAIR, "content"), weights).groupBy(*PAIR).agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hits")
    )

    def named(df: DataFrame, p: str) -> DataFrame:
        return df.select(*PAIR, F.col("win_start").alias(p + "_s"), F.col("win_end").alias(p + "_e"))

    located = (
        rows.join(named(sent_win, "a"), PAIR, "left")
        .join(named(term_win, "b"), PAIR, "left")
        .join(named(sem_win, "c"), PAIR, "left")
        .join(hit_spans, PAIR, "left")
        .withColumn("p_s", F.when(F.col("end") > F.col("start"), F.col("start")))
        .withColumn("p_e", F.when(F.col("end") > F.col("start"), F.col("end")))
        .withColumn(
            "how",
            F.when(F.col("a_s").isNotNull(), "sentence")
            .when(F.col("b_s").isNotNull(), "window")
            .when(F.col("c_s").isNotNull(), "semantic")
            .when(F.col("p_s").isNotNull(), "passage")
            .otherwise("head"),
        )
        .withColumn("ws", F.coalesce("a_s", "b_s", "c_s", "p_s"))
        .withColumn("we", F.coalesce("a_e", "b_e", "c_e", "p_e"))
    )
    clipped = (F.col("ws") > 0) | (F.col("we") < F.char_length("content"))
    many = multi_span_snippet(
        sent_scores.unionByName(sem_scores), rows.select("chunk_id", "content").dropDuplicates(["chunk_id"])
    ).withColumnRenamed("snippet", "m_snippet").withColumnsRenamed({"focus_start": "m_s", "focus_end": "m_e"})
    out = located.join(many, PAIR, "left").withColumn("multi", F.col("m_snippet").isNotNull() & clipped)
    segs = snippet_segments(
        F.col("content"), F.col("ws"), F.col("we"), F.coalesce("hits", F.array().cast("array<struct<start:int,end:int>>"))
    )
    out = out.withColumn("segments", segs)
    return out.select(
        "query_id",
        "rank",
        "chunk_id",
        "source_file",
        "speaker",
        "score",
        "score_norm",
        match_kind(F.col("bm25"), F.col("vector")).alias("match"),
        F.when(F.col("multi"), "multi").otherwise(F.col("how")).alias("how"),
        F.when(F.col("multi"), F.col("m_s")).otherwise(F.col("ws")).alias("focus_start"),
        F.when(F.col("multi"), F.col("m_e")).otherwise(F.col("we")).alias("focus_end"),
        F.when(F.col("multi"), F.col("m_snippet"))
        .when(F.col("ws").isNotNull(), F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .otherwise(trim_runes("content", SNIPPET))
        .alias("snippet"),
        F.when(~F.col("multi"), F.col("segments")).alias("segments"),
        "total",
        "page",
        "page_size",
    )


__all__ = ["find_evidence", "locate_passage", "locate_window", "mark_segments", "multi_span_snippet", "semantic_locate"]
