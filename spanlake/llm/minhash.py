"""Near-duplicate groups by DartMinHash signatures and banded joining.

Darts: the region of an element of weight w is [0, w) x [0, inf), cut into cells of width 1. Each cell
has its own stream of darts, a Poisson process in rank: the ranks are running sums of exponential
steps, every step, place inside the cell and coordinate being a hash of (element, cell, number of the
dart). A dart beyond the weight misses. Of the darts that fall to a coordinate the earliest is kept;
two weighted sets keep the same dart with probability equal to their weighted Jaccard similarity.
Only darts below a rank that fills all coordinates are thrown, about k ln k in all and not k per
element; if one stays empty the rank is doubled. Empty sets have no signature.

Grouping: equal texts are one text. Texts that agree on all rows of a band fall in a bucket; each is
checked against the bucket's first text by exact Jaccard similarity of the shingle sets. Members that
fail that check are checked against all members of their buckets that no link has joined to them yet
and that share one of their rarest shingles, as near texts must, so no class is lost to the choice of
the first text. Classes are connected components, found by joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.scratch import stored
from spanlake.llm.words import U64, mix, shingles, slices, words_of
from spanlake.runtime import shuffle_partitions

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 6
COUNTERS = 1 << 18
_STEP, _PLACE, _COORD = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3)


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform values in (0, 1)."""
    return ((x >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def darts(elements: np.ndarray, weights: np.ndarray, limit: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coordinate, rank, dart) of all darts below rank ``limit`` that hit."""
    cells = np.ceil(weights).astype(np.int64)
    cell = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    left = np.repeat(weights, cells) - cell
    stream = mix(np.repeat(elements, cells) + cell.astype(U64) * _STEP)
    rank = np.zeros(len(stream))
    # enough darts at a time that nearly all cells are done at once
    many = int(limit + 4 * math.sqrt(limit)) + 3
    found: list[tuple[np.ndarray, ...]] = []
    number = 0
    while len(stream):
        step = mix(stream[:, None] + np.arange(number + 1, number + many + 1, dtype=U64)[None, :] * _STEP)
        ranks = rank[:, None] + np.cumsum(-np.log(_unit(step)), axis=1)
        row, col = np.nonzero(ranks < limit)
        dart, at = step[row, col], ranks[row, col]
        hit = _unit(mix(dart ^ _PLACE)) < left[row]
        dart, at = dart[hit], at[hit]
        found.append(((mix(dart ^ _COORD) % U64(k)).astype(np.int64), at, dart))
        alive = ranks[:, -1] < limit
        stream, rank, left, number = stream[alive], ranks[alive, -1], left[alive], number + many
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0), np.empty(0, U64))


def signature(elements: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """Earliest dart of each of ``k`` coordinates; empty for a set of no weight."""
    live = weights > 0
    elements, weights = elements[live], weights[live].astype(float)
    total = float(weights.sum())
    if not total:
        return np.empty(0, U64)
    limit = (k * math.log(k) + 3 * k) / total
    while True:
        coord, rank, dart = darts(elements, weights, limit, k)
        order = np.argsort(rank, kind="stable")
        filled, first = np.unique(coord[order], return_index=True)
        if len(filled) == k:
            return dart[order[first]]
        limit *= 2


def shingle_set(hashes: np.ndarray, words: int = WORDS, counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles with weight 1, or with their number if ``counted``."""
    values, n = np.unique(shingles(hashes, words), return_counts=True)
    return values, n if counted else np.ones(len(values))


def _band_rows(bands: int, rows: int, words: int, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = np.asarray(batch.column("id"))
            texts = [t.lower().encode() for t in batch.column("text").to_pylist()]
            who, keys = [], []
            for lo, hi, hashes, bounds in words_of(texts):
                for i in range(hi - lo):
                    sig = signature(*shingle_set(hashes[bounds[i] : bounds[i + 1]], words, counted), bands * rows)
                    if len(sig):
                        who.append(ids[lo + i])
                        keys.append(sig)
            if not who:
                continue
            grid = np.stack(keys).reshape(len(who), bands, rows)
            one = np.zeros((len(who), bands), U64)
            for r in range(rows):
                one = mix(one + grid[:, :, r] + U64(r))
            flat = one + np.arange(bands, dtype=U64)[None, :] * _COORD
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(who), bands)), pa.array(mix(flat).reshape(-1).view(np.int64))], ["id", "key"])

    return run


def _checked_rows(threshold: float, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b, ta, tb = (batch.column(c) for c in ("a", "b", "text_a", "text_b"))
            keep = np.zeros(batch.num_rows, bool)
            for side in range(0, batch.num_rows, 256):
                part = slice(side, side + 256)
                sets: dict[str, np.ndarray] = {}
                pairs = list(zip(ta[part].to_pylist(), tb[part].to_pylist()))
                texts = list(dict.fromkeys(t for p in pairs for t in p))
                for lo, hi, hashes, bounds in words_of([t.lower().encode() for t in texts]):
                    for i in range(hi - lo):
                        sets[texts[lo + i]] = shingle_set(hashes[bounds[i] : bounds[i + 1]], words)[0]
                for i, (x, y) in enumerate(pairs):
                    u, v = sets[x], sets[y]
                    if min(len(u), len(v)) >= threshold * max(len(u), len(v)):
                        both = len(np.intersect1d(u, v, assume_unique=True))
                        keep[side + i] = both >= threshold * (len(u) + len(v) - both) - 1e-9
            yield pa.RecordBatch.from_arrays([a, b, pa.array(keep)], ["a", "b", "near"])

    return run


def checked(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """Pairs (a, b) of text ids with ``near``: exact Jaccard similarity of the shingle sets of at least ``threshold``."""
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(other, "b").select("a", "b", "text_a", "text_b").mapInArrow(_checked_rows(threshold, words), "a long, b long, near boolean")


def _shingle_counts(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in slices(batches):
            for _, _, hashes, bounds in words_of([t.lower().encode() for t in batch.column("text").to_pylist()]):
                for lo, hi in zip(bounds[:-1], bounds[1:]):
                    np.add.at(total, (shingle_set(hashes[lo:hi], words)[0] % U64(COUNTERS)).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])

    return run


def _prefix_rows(counts: np.ndarray, threshold: float, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            owners, grams, sizes, places, lows, highs = [], [], [], [], [], []
            for lo, hi, hashes, bounds in words_of([t.lower().encode() for t in batch.column("text").to_pylist()]):
                for i in range(hi - lo):
                    own = shingle_set(hashes[bounds[i] : bounds[i + 1]], words)[0]
                    rare = own[np.lexsort((own, counts[(own % U64(COUNTERS)).astype(np.int64)]))]
                    take = len(own) - math.ceil(threshold * len(own) - 1e-9) + 1 if len(own) else 0
                    grams.append(rare[:take])
                    owners.append(np.full(take, lo + i))
                    sizes.append(np.full(take, len(own)))
                    places.append(np.arange(take))
                    for half, held in ((0, lows), (1, highs)):
                        mine = own[(own >> U64(6)) & U64(1) == U64(half)]
                        held.append(np.full(take, np.bitwise_xor.reduce(U64(1) << (mine & U64(63)), initial=U64(0)), U64))
            at = np.concatenate(owners).astype(np.int64)
            cols = [pa.array(np.asarray(batch.column(c))[at]) for c in ("id", "label", "open")]
            own_cols = [np.concatenate(x) for x in (grams, sizes, places, lows, highs)]
            own_cols = [pa.array(x.view(np.int64) if x.dtype == U64 else x.astype(np.int64)) for x in own_cols]
            yield pa.RecordBatch.from_arrays([*own_cols, *cols], ["gram", "n", "pos", "low", "high", "id", "label", "open"])

    return run


def prefix_pairs(asked: DataFrame, texts: DataFrame, threshold: float, words: int) -> DataFrame:
    """All pairs (a, b) of ``asked`` (id, label, open) that may be near, one of them open, of different labels.

    Sets of Jaccard similarity t share one of their rarest ``n - ceil(t n) + 1`` shingles, so texts
    whose rare shingles are their own meet nobody, however many others they share a bucket with. At the
    first shared one enough must be left to share, and of 128 bits, each flipped by some shingles, no
    more may differ than shingles that need not be shared.
    Rarity is counted over the asked texts in ``COUNTERS`` slots; the counts alone reach the driver.
    """
    spark = asked.sparkSession
    rows = stored(texts.join(asked, "id").select("id", "label", "open", "text"), "asked")
    counts = np.zeros(COUNTERS, np.int64)
    got = rows.mapInArrow(_shingle_counts(words), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts[np.asarray(got.column("slot"))] = np.asarray(got.column("n"))
    entries = rows.mapInArrow(_prefix_rows(counts, threshold, words), "gram long, n long, pos long, low long, high long, id long, label long, open int")
    entries = entries.repartition(shuffle_partitions(spark), "gram")
    other = entries.select("gram", *(F.col(c).alias(f"y_{c}") for c in ("n", "pos", "low", "high", "id", "label", "open")))
    # sizes, what is left to share after the shared shingle, and the bits that unshared shingles can flip
    n, m = F.col("n"), F.col("y_n")
    shared = F.ceil((n + m) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    bits = F.bit_count(F.col("low").bitwiseXOR(F.col("y_low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("y_high")))
    sizes = (F.least(n, m) >= F.lit(threshold) * F.greatest(n, m) - F.lit(1e-9)) & (F.least(n - F.col("pos"), m - F.col("y_pos")) >= shared) & (bits <= n + m - 2 * shared)
    met = entries.join(other, "gram").filter((F.col("id") < F.col("y_id")) & (F.col("open") + F.col("y_open") > 0) & (F.col("label") != F.col("y_label")) & sizes)
    return met.select(F.col("id").alias("a"), F.col("y_id").alias("b")).distinct()


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each connected component of ``links`` (a, b).

    Each round takes the smallest label among neighbours and then the label of the label; all tables
    have one row per linked id or link, and each round ends in a written table.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("label")), "labels")
    while True:
        reach = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(reach, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("root"))
        new = stored(
            step.join(jump, "label", "left").select("id", "was", F.coalesce("root", "label").alias("label")), "labels"
        )
        labels = new.select("id", "label")
        if new.filter("was != label").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, counted: bool = False
) -> DataFrame:
    """doc_id, class_id and is_first per input row.

    ``class_id`` is the smallest doc_id of the class; ``is_first`` holds for the rows that have it.
    Texts without words are near nothing but equal texts; a null text is in no class with others, and
    neither is a row with null doc_id (its class_id is null and it counts as first). Rows repeated
    with one doc_id are in one class if their texts are near; all rows of the smallest id are first.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows_in = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("ta"), F.xxhash64(F.lit(1), text).alias("tb")
    )
    whole = rows_in.filter("doc_id is not null and text is not null")
    narrow = whole.select("doc_id", "ta", "tb")
    # texts with copies only; the first stands for all, the others are left out of the search
    firsts = stored(narrow.groupBy("ta", "tb").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "copied")
    standing = stored(narrow.join(firsts, ["ta", "tb"], "left").select("doc_id", F.coalesce("first", "doc_id").alias("id")), "standing")
    copies = standing.filter("doc_id > id").select(F.col("doc_id").alias("id"))
    keyed = stored(
        whole.select(F.col("doc_id").alias("id"), "text")
        .mapInArrow(_band_rows(bands, rows, words, counted), "id long, key long")
        .join(copies, "id", "left_anti"),
        "bands",
    )
    heads = keyed.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("key", "a")
    members = stored(keyed.join(heads, "key").filter("id > a").select("key", "a", F.col("id").alias("b")).distinct(), "members")
    pairs = members.select("a", "b").distinct()
    seen = members.select(F.col("a").alias("doc_id")).union(members.select("b")).distinct()
    texts = stored(whole.join(seen, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text"), "candidates")
    first_round = stored(checked(pairs, texts, threshold, words), "checked")
    near = first_round.filter("near").select("a", "b")
    labels = components(spark, near)
    # what the first round has joined needs no second look, so a group of near copies is not compared pair by pair
    classed = stored(
        members.join(labels.select(F.col("id").alias("b"), "label"), "b", "left").select("key", "a", "b", F.coalesce("label", "b").alias("label")), "classed"
    )
    failed = stored(classed.join(first_round.filter("not near").select("a", "b"), ["a", "b"]).select("key", F.col("b").alias("id")).distinct(), "failed")
    asked = classed.join(failed.select("key").distinct(), "key", "left_semi").select(F.col("b").alias("id"), "label").distinct()
    asked = asked.join(failed.select("id").distinct().withColumn("open", F.lit(1)), "id", "left").select("id", "label", F.coalesce("open", F.lit(0)).alias("open"))
    second = stored(prefix_pairs(asked, texts, threshold, words).join(first_round.select("a", "b"), ["a", "b"], "left_anti"), "second")
    more = stored(checked(second, texts, threshold, words).filter("near").select("a", "b"), "second-checked")
    if not more.isEmpty():
        labels = components(spark, near.union(more))
    found = standing.join(labels, "id", "left").select("doc_id", F.coalesce("label", "id").alias("class_id"))
    alone = rows_in.filter("doc_id is null or text is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return found.union(alone).withColumn("is_first", F.col("class_id").eqNullSafe(F.col("doc_id")))
