"""Removal of passages that an earlier document has too, by prefix-partitioned suffix trees.

Suffixes are sparse: a window of 50 words is found through its anchor, the first place where a run of
``PREFIX`` words has the smallest hash in the window. Equal windows have equal anchors. The words at
an anchor are the prefix of the suffix that begins there; there is one in about twenty words.

1. Count prefixes. Those that only one text has cannot begin a shared window; their suffixes go.
2. Suffixes with the same prefix form a group, sent with the words before and after the anchor. A
   group of at most ``group_rows`` suffixes is built into a suffix tree in one task: sorted suffixes
   and common prefix lengths give the nodes; at the node of ``r`` words to the right, the suffixes
   with the same ``50 - r`` words to the left are one repeated window, and all but those of the
   smallest doc_id are marked.
3. A prefix that more suffixes have is made longer, up to the window itself: its windows are
   compared as hashes, once per text however often it repeats them, with the smallest doc_id taken
   before the shuffle, so a passage that a third of all documents share is no single group.
4. A document that repeats a whole earlier text needs no search: all its windows are repeats.

Words are compared by 64-bit hashes (whole windows of long prefixes by 128 bits). Null texts have no
words. A null doc_id is neither earlier nor later than any other, so such rows are kept whole; rows
with equal doc_id are not earlier than each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.scratch import stored
from spanlake.llm.words import U64, mix, shingles, slices, words_of
from spanlake.runtime import shuffle_partitions

WINDOW, PREFIX, GROUP_ROWS = 50, 10, 20_000
_ID = "doc_id long, ta long, tb long"
_HIT = f"{_ID}, lo long, hi long"


_PLACE = U64((1 << 28) - 1)


def _lowest(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value in every run of ``width`` values, by doubling."""
    out, size = x, 1
    while 2 * size <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(hashes: np.ndarray, bounds: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first, last, prefix hash): the anchors of a block of texts and the windows that each has.

    A window's anchor is the leftmost of its prefixes with the smallest hash, so the windows of an
    anchor begin at consecutive words ``first`` to ``last``, and equal windows have theirs at the same
    word. Windows lie inside one text.
    """
    n = len(hashes)
    if n < window:
        return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, U64))
    grams = shingles(hashes, prefix)
    # upper bits of the hash, then the place: the minimum tells both
    low = _lowest((grams & ~_PLACE) | np.arange(len(grams), dtype=U64), window - prefix + 1)
    inside = np.ones(n + 1, bool)
    for b in bounds[1:-1]:
        inside[max(0, b - window + 1) : b] = False
    begin = np.flatnonzero(inside[: len(low)])
    owner = (low[begin] & _PLACE).astype(np.int64)
    head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    tail = np.concatenate([head[1:] - 1, [len(owner) - 1]]) if len(owner) else head
    place = owner[head]
    return place, begin[head], begin[tail], grams[place]


def window_hashes(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window, as differences of running sums."""
    out = []
    for base in (0xD6E8FEB86659FD93, 0xCA5A826395121157):
        up, down = (np.multiply.accumulate(np.concatenate([[U64(1)], np.full(len(hashes), b, U64)])) for b in (base, pow(base, -1, 1 << 64)))
        sums = np.concatenate([[U64(0)], np.cumsum(hashes * up[:-1])])
        n = len(hashes) - window + 1
        out.append(mix((sums[window:] - sums[:n]) * down[:n]))
    return out[0], out[1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def _anchor_rows(window: int, prefix: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ta, tb = (np.asarray(batch.column(c)) for c in ("ta", "tb"))
            for lo, hi, hashes, bounds in words_of(_texts(batch)):
                place, _, _, grams = anchors(hashes, bounds, window, prefix)
                if not len(place):
                    continue
                doc = lo + np.searchsorted(bounds, place, side="right") - 1
                order = np.lexsort((grams, doc))
                doc, grams = doc[order], grams[order]
                new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])]))
                times = np.diff(np.concatenate([new, [len(doc)]]))
                yield pa.RecordBatch.from_arrays([pa.array(ta[doc[new]]), pa.array(tb[doc[new]]), _signed(grams[new]), pa.array(times)], ["ta", "tb", "gram", "n"])

    return run


def _suffix_rows(window: int, prefix: int):
    """Suffixes with shared prefixes.

    ``before`` and ``after`` are the words around the anchor as far as its windows reach. Long prefixes
    give one row per text: both hashes of all their windows, and where these begin.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = [batch.column(c).to_pylist() for c in ("doc_id", "ta", "tb")]
            shared = [{x["gram"]: x["hot"] for x in g} for g in batch.column("grams").to_pylist()]
            rows: list[tuple] = []
            size = 0
            for lo, hi, hashes, bounds in words_of(_texts(batch)):
                place, first, last, grams = anchors(hashes, bounds, window, prefix)
                doc = lo + np.searchsorted(bounds, place, side="right") - 1
                whole: tuple[np.ndarray, np.ndarray] | None = None
                long: dict[int, list[np.ndarray]] = {}
                for a, s, e, d, g in zip(place.tolist(), first.tolist(), last.tolist(), doc.tolist(), grams.view(np.int64).tolist()):
                    hot = shared[d].get(g)
                    if hot is None:
                        continue
                    begin = int(bounds[d - lo])
                    if hot:
                        whole = whole or window_hashes(hashes, window)
                        starts = np.arange(s, e + 1)
                        long.setdefault(d, []).append(np.stack([whole[0][s : e + 1], whole[1][s : e + 1], (starts - begin).astype(U64)]))
                        continue
                    rows.append((g, False, *(c[d] for c in ids), a - begin, hashes[s:a].tobytes(), hashes[a : e + window].tobytes(), None))
                    size += 100 + len(rows[-1][-2]) + len(rows[-1][-3])
                for d, parts in long.items():
                    views = [x.tobytes() for x in np.concatenate(parts, axis=1)]
                    rows.append((0, True, *(c[d] for c in ids), 0, *views))
                    size += 3 * len(views[0])
                if size > 4 << 20:
                    yield _batch(rows, _CONTEXT)
                    rows, size = [], 0
            if rows:
                yield _batch(rows, _CONTEXT)

    return run


_CONTEXT = [("gram", pa.int64()), ("hot", pa.bool_()), ("doc_id", pa.int64()), ("ta", pa.int64()), ("tb", pa.int64()), ("at", pa.int64()), ("before", pa.binary()), ("after", pa.binary()), ("starts", pa.binary())]
_HITS = [("doc_id", pa.int64()), ("ta", pa.int64()), ("tb", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


class SuffixTree:
    """Tree over a group of suffixes, as sorted suffixes with common prefix lengths."""

    def __init__(self, after: list[np.ndarray], depth: int):
        self.depth = depth
        self.words = np.zeros((len(after), depth), U64)
        self.length = np.array([min(len(a), depth) for a in after])
        for i, a in enumerate(after):
            self.words[i, : self.length[i]] = a[:depth]
        self.order = np.lexsort(self.words.T[::-1])
        ordered, length = self.words[self.order], self.length[self.order]
        same = np.logical_and.accumulate(ordered[1:] == ordered[:-1], axis=1).sum(axis=1)
        #: words that neighbours in sorted order have in common
        self.common = np.minimum(same, np.minimum(length[1:], length[:-1]))

    def nodes(self, depths: np.ndarray) -> np.ndarray:
        """For each of ``depths`` and each suffix the node it passes that many words below the root;
        -1 if it ends before."""
        node = np.zeros((len(depths), len(self.order)), np.int64)
        node[:, self.order[1:]] = np.cumsum(self.common[None, :] < depths[:, None], axis=1)
        node[depths[:, None] > self.length[None, :]] = -1
        return node


def repeats_in_group(docs: np.ndarray, before: list[np.ndarray], after: list[np.ndarray], window: int, prefix: int) -> list[list[int]]:
    """For each suffix the numbers of words to the left at which a window begins that a smaller doc has too.

    A window is a node ``window - l`` words deep in the tree of the words to the right together with
    a node ``l`` words deep in the tree of the words to the left, read backwards.
    """
    n, lefts = len(docs), np.arange(window - prefix + 1)
    right = SuffixTree(after, window).nodes(window - lefts)
    left = SuffixTree([b[::-1] for b in before], window).nodes(lefts)
    l, i = np.nonzero((right >= 0) & (left >= 0))
    key = (l * n + left[l, i]) * n + right[l, i]
    order = np.lexsort((docs[i], key))
    ordered, doc = key[order], docs[i][order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    later = order[doc > doc[head][np.cumsum(head) - 1]] if len(order) else order
    out: list[list[int]] = [[] for _ in range(n)]
    for x in np.sort(later).tolist():
        out[i[x]].append(int(l[x]))
    return out


def _runs(at: int, lefts: list[int], window: int) -> Iterator[tuple[int, int]]:
    """Word ranges covered by the windows that begin ``lefts`` words before ``at``."""
    i = 0
    while i < len(lefts):
        j = i
        while j + 1 < len(lefts) and lefts[j + 1] == lefts[j] + 1:
            j += 1
        yield at - lefts[j], at - lefts[i] + window
        i = j + 1


def _tree_rows(window: int, prefix: int):
    def solved(rows: list[tuple]) -> Iterator[tuple]:
        if len({r[2] for r in rows}) < 2:
            return
        views = [[np.frombuffer(r[k], U64) for r in rows] for k in (6, 7)]
        for row, lefts in zip(rows, repeats_in_group(np.array([r[2] for r in rows]), *views, window, prefix)):
            for lo, hi in _runs(row[5], lefts, window):
                yield (*row[2:5], lo, hi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in slices(batches):
            hits: list[tuple] = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                if group and group[0][0] != row[0]:
                    hits.extend(solved(group))
                    group = []
                group.append(row)
            if hits:
                yield _batch(hits, _HITS)
        hits = list(solved(group)) if group else []
        if hits:
            yield _batch(hits, _HITS)

    return run


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per text and distinct window of a long prefix, with the places where it begins."""
    names = ["w1", "w2", "doc_id", "ta", "tb", "starts"]
    for batch in slices(batches, 256):
        cols: list[list] = [[] for _ in names]
        for row in zip(*(batch.column(c).to_pylist() for c in ("before", "after", "starts", "doc_id", "ta", "tb"))):
            w1, w2, at = (np.frombuffer(x, np.int64) for x in row[:3])
            order = np.lexsort((at, w2, w1))
            w1, w2, at = w1[order], w2[order], at[order]
            head = np.flatnonzero(np.concatenate([[True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]))
            cols[0].append(w1[head])
            cols[1].append(w2[head])
            for i in (2, 3, 4):
                cols[i].append(np.full(len(head), row[i + 1], np.int64))
            cols[5].extend(np.split(at, head[1:]))
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cols[5])]), pa.int32()), pa.array(np.concatenate(cols[5])))
        yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in cols[:5]), lists], names)


def _kept_rows(window: int):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, size = [], 0
            for doc_id, text, whole, gone in zip(batch.column("doc_id").to_pylist(), _texts(batch), batch.column("whole").to_pylist(), batch.column("gone").to_pylist()):
                words = text.split()
                keep = words
                if whole and len(words) >= window:
                    keep = []
                elif gone:
                    stay = np.ones(len(words), bool)
                    for x in gone:
                        stay[x["lo"] : x["hi"]] = False
                    keep = [w for w, s in zip(words, stay.tolist()) if s]
                joined = b" ".join(keep)
                rows.append((doc_id, len(words), len(words) - len(keep), hashlib.sha256(joined).hexdigest(), joined.decode()))
                size += len(joined)
                if size > 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def repeated_passages(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Word ranges to remove: doc_id, ta, tb (hashes of the text), whole, gone array<struct<lo, hi>>.

    ``docs`` has doc_id (not null), text, ta, tb. Rows of documents without a repeat are absent.
    """
    found = stored(docs.select("text", "ta", "tb").mapInArrow(_anchor_rows(window, prefix), "ta long, tb long, gram long, n long"), "anchors")
    shared = (
        found.groupBy("gram")
        .agg(F.min("ta").alias("one"), F.max("ta").alias("other"), F.sum("n").alias("n"))
        .filter("one != other")
        .select("gram", (F.col("n") > group_rows).alias("hot"))
    )
    firsts = docs.groupBy("ta", "tb").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    wanted = (
        found.join(shared, "gram")
        .select("ta", "tb", "gram", "hot")
        .distinct()
        .groupBy("ta", "tb")
        .agg(F.collect_list(F.struct("gram", "hot")).alias("grams"))
        .join(firsts.select("ta", "tb", "doc_id"), ["ta", "tb"])
    )
    context = stored(
        docs.join(wanted, ["doc_id", "ta", "tb"])
        .select("doc_id", "ta", "tb", "text", "grams")
        .mapInArrow(_suffix_rows(window, prefix), f"gram long, hot boolean, {_ID}, at long, before binary, after binary, starts binary"),
        "suffixes",
    )
    n = shuffle_partitions(docs.sparkSession)
    cold = context.filter(~F.col("hot")).repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(_tree_rows(window, prefix), _HIT)
    deep = context.filter("hot").mapInArrow(_window_rows, f"w1 long, w2 long, {_ID}, starts array<long>")
    heads = deep.groupBy("w1", "w2").agg(F.min("doc_id").alias("head"), F.max("doc_id").alias("tail")).filter("head < tail")
    ranges = F.transform("starts", lambda lo: F.struct(lo.alias("lo"), (lo + window).alias("hi")))
    long = deep.join(heads, ["w1", "w2"]).filter("doc_id > head").select("doc_id", "ta", "tb", ranges.alias("gone"))
    short = cold.select("doc_id", "ta", "tb", F.array(F.struct("lo", "hi")).alias("gone"))
    parts = short.union(long).groupBy("doc_id", "ta", "tb").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    copies = (
        docs.select("doc_id", "ta", "tb")
        .join(firsts.filter("n > 1").select("ta", "tb", F.col("doc_id").alias("first")), ["ta", "tb"])
        .filter("doc_id > first")
        .select("doc_id", "ta", "tb")
        .distinct()
    )
    return parts.select("doc_id", "ta", "tb", F.lit(False).alias("whole"), "gone").unionByName(
        copies.select("*", F.lit(True).alias("whole"), F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>").alias("gone"))
    )


def without_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by one space) per input row."""
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("ta"), F.xxhash64(F.lit(1), text).alias("tb")
    )
    gone = repeated_passages(rows.filter("doc_id is not null and text is not null"), window, prefix, group_rows)
    return (
        rows.join(gone, ["doc_id", "ta", "tb"], "left")
        .select("doc_id", "text", "whole", "gone")
        .mapInArrow(_kept_rows(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    )
