"""Exact Jaccard join of word n-gram sets through prefix trees, and the classes that its links make.

A link needs ``least(n)`` = ceil(0.85 n) common n-grams from a set of n, and more from a pair (``shared``).

1. Equal sets are one set. Of every set the n-grams of lowest hash are written: so many that a partner
   must share several of them. Sets of which too few occur a second time have no partner and are left out,
   which leaves about those that have one. Counts cover all documents.
2. The n-grams of the sets that are left are counted exactly and put in one global order, rare ones
   first. Those that occur once are never shared: they count in n, but are not kept.
3. An n-gram of a prefix is the root of a tree of the sets that have it there. Only the shorter set of a
   pair needs to have it in its short (index) prefix, and from a shared n-gram on both must have enough
   left. Sets are first held against the shortest of each tree; a few such rounds join most classes, and
   only sets of different classes are paired in the last one, so a large class is never paired with itself.
4. The candidates of one set form a trie: sorted by their ordered n-grams, they arrive as a depth-first walk.
   The overlap up to a branch is shared by all below it, and a branch whose overlap and remaining lengths
   can't reach what is needed is left with all that hangs on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.minhash import components
from spanlake.llm.scratch import stored
from spanlake.llm.words import U64, mix, shingles, slices, words_of
from spanlake.runtime import has_at_most, shuffle_partitions

WORDS, PERCENT = 4, 85
#: rounds in which a set meets one other, before the rest is paired
ROUNDS = 4
#: ids that are sent to every task; more are joined by a shuffle
SMALL = 1_000_000
#: partners of one set in a trie; more are dealt to several
TRIE = 4096
#: 64 bits each
BITS = ("b0", "b1", "b2", "b3")
_ENDLESS = 1 << 62


def _least(n, percent: int):
    """Fewest common n-grams of a set of ``n`` with a partner."""
    return (n * percent + 99) // 100


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, np.ndarray]]:
    texts = [(t or "").encode().lower() for t in batch.column("text").to_pylist()]  # bytes: A-Z only
    for lo, hi, hashes, bounds in words_of(texts):
        for i in range(hi - lo):
            yield lo + i, np.unique(shingles(hashes[bounds[i] : bounds[i + 1]], words))


def _digest(own: np.ndarray) -> tuple[int, int]:
    """Two sums over scrambled n-grams, which equal sets have in common."""
    with np.errstate(over="ignore"):
        return tuple(int(mix(own ^ U64(seed)).sum(dtype=U64).view(np.int64)) for seed in (1, 2))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, U64)]).view(np.int64)))


def _low_rows(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            sizes, digests, low = np.zeros(batch.num_rows, np.int64), np.zeros((2, batch.num_rows), np.int64), [np.empty(0, U64)] * batch.num_rows
            for i, own in _sets(batch, words):
                n = len(own)
                if n:
                    sizes[i], digests[:, i] = n, _digest(own)
                    low[i] = own[: n - _least(n, percent) + n // 10 + 1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), *map(pa.array, digests), _lists(low)], ["doc_id", "n", "ka", "kb", "low"])

    return run


def _whole_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            keys = [batch.column(c).to_pylist() for c in ("ka", "kb")]
            at, rows = [], []
            for i, own in _sets(batch, words):
                if len(own) and _digest(own) == (keys[0][i], keys[1][i]):  # another row may have the id
                    at.append(i)
                    rows.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("sid").take(pa.array(at, pa.int64())), _lists(rows)], ["sid", "grams"])

    return run


def ordered_sets(sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """sid, n, ``path``: the n-grams that occur in another set, rare ones first, and ``core``: in how many sets they
    occur on average. Sets that have too few are left out."""
    occurs = sets.select("sid", F.explode("grams").alias("g"))
    again = occurs.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    path = occurs.join(again, "g").groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("c", "g"))).alias("p"), F.avg("c").alias("core"))
    path = path.select("sid", "core", F.transform("p", lambda x: x.g).alias("path"))
    kept = path.join(sizes, "sid").filter(F.size("path") >= F.expr(f"(n * {percent} + 99) div 100")).select("sid", F.col("n").cast("int").alias("n"), "core", "path")
    return kept.mapInArrow(_with_parity, "sid long, n int, core double, path array<long>, own int, " + ", ".join(f"{b} long" for b in BITS))


def _with_parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds how many n-grams no other set has, and bits of which each is flipped by the others that fall to it."""
    wide = 64 * len(BITS)
    for batch in batches:
        lists, n = batch.column("path"), batch.num_rows
        size = np.diff(lists.offsets.to_numpy())
        grams = lists.flatten().to_numpy(zero_copy_only=False).view(U64)
        cell = np.repeat(np.arange(n), size) * wide + (mix(grams) % U64(wide)).astype(np.int64)
        odd = (np.bincount(cell, minlength=n * wide).reshape(n, wide) & 1).astype(np.uint8)
        words = np.packbits(odd, axis=1, bitorder="little").view("<i8")
        own = batch.column("n").to_numpy(zero_copy_only=False) - size
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), *(pa.array(np.ascontiguousarray(words[:, i])) for i in range(len(BITS)))], [*batch.schema.names, "own", *BITS])


def _shared(n: Column, m: Column, percent: int) -> Column:
    """Fewest common n-grams of linked sets of sizes ``n`` and ``m``."""
    return F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def prefix_entries(paths: DataFrame, percent: int) -> DataFrame:
    """g, sid, n, core, own, bits, left (n-grams from this one on) and ``short`` (in the index prefix), for each prefix n-gram."""
    size, n = F.size("path"), F.col("n")
    probe = size - F.expr(f"(n * {percent} + 99) div 100") + 1
    index = size - _shared(n, n, percent) + 1
    rows = paths.select("sid", "n", "core", "own", *BITS, size.alias("size"), index.alias("index"), F.posexplode(F.slice("path", F.lit(1), probe.cast("int"))).alias("pos", "g"))
    return rows.select("g", "sid", "n", "core", "own", *BITS, (F.col("size") - F.col("pos")).cast("int").alias("left"), (F.col("pos") < F.col("index")).alias("short"))


def _fits(percent: int) -> Column:
    """Sizes and remaining lengths from the shared n-gram on allow a link, the sets don't differ in more n-grams than linked
    ones may, and the shorter set has the n-gram in its index prefix.

    Sets differ in the n-grams that are their own, and in at least as many others as their bits differ.
    """
    n, m = F.col("n"), F.col("y_n")
    first = (n < m) | ((n == m) & (F.col("sid") < F.col("y_sid")))
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    shared = _shared(n, m, percent)
    differ = F.col("own") + F.col("y_own") + sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"y_{b}"))) for b in BITS), F.lit(0))
    return sizes & (F.least("left", "y_left") >= shared) & (differ <= n + m - 2 * shared) & F.when(first, F.col("short")).otherwise(F.col("y_short"))


class Walk:
    """Overlaps of one set with sets that arrive in the order of a depth-first walk of their trie.

    ``path`` is the branch looked at last and ``overlap[d]`` what its first d n-grams share with the set.
    """

    def __init__(self, own: np.ndarray, n: int, percent: int):
        self.place = np.argsort(own, kind="stable")
        self.own, self.n, self.percent = own[self.place], n, percent
        self.path, self.overlap, self.reached = np.empty(0, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.dead = _ENDLESS

    def linked(self, path: np.ndarray, m: int) -> bool:
        """True if the set of ``m`` n-grams, of which ``path`` may be shared, is linked with this one."""
        common = min(len(path), len(self.path))
        differ = np.flatnonzero(path[:common] != self.path[:common])
        fork = int(differ[0]) if len(differ) else common
        if fork >= self.dead:
            return False  # it hangs on a branch that was left
        at = np.minimum(np.searchsorted(self.own, path[fork:]), len(self.own) - 1)
        hit = self.own[at] == path[fork:]
        self.overlap = np.concatenate([self.overlap[: fork + 1], self.overlap[fork] + np.cumsum(hit)])
        # both sides are in one order, so what lies before the last shared n-gram can't be shared below it
        passed = np.maximum.accumulate(np.concatenate([self.reached[fork : fork + 1], np.where(hit, self.place[at] + 1, 0)]))
        self.reached = np.concatenate([self.reached[:fork], passed])
        self.path = path
        lost = np.flatnonzero(self._hopeless())
        self.dead = int(lost[0]) if len(lost) else _ENDLESS
        return bool(self.overlap[-1] >= -(-self.percent * (self.n + m) // (100 + self.percent)))

    def _hopeless(self) -> np.ndarray:
        """Depths below which no set is linked: the n-grams that a branch has missed leave too few to the largest
        set that may be linked, or those that it has passed leave too few of this one."""
        most = self.n * 100 // self.percent
        missed = np.arange(len(self.overlap)) - self.overlap
        few = most - missed < -(-self.percent * (self.n + most) // (100 + self.percent))
        return few | (self.overlap + len(self.own) - self.reached < _least(self.n, self.percent))


def _checked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, key = None, None
        for batch in batches:
            a, b, part, n = (np.asarray(batch.column(c)) for c in ("a", "b", "part", "n"))
            lists = batch.column("path")
            flat, ends = np.asarray(lists.flatten()), np.asarray(lists.offsets)
            ends = ends - ends[0]
            near = np.zeros(len(a), bool)
            for i in range(len(a)):
                path = flat[ends[i] : ends[i + 1]]
                if b[i] < 0:  # the set itself comes before its partners
                    walk, key = Walk(path, int(n[i]), percent), (a[i], part[i])
                else:
                    assert key == (a[i], part[i])
                    near[i] = walk.linked(path, int(n[i]))
            yield pa.RecordBatch.from_arrays([pa.array(a[b >= 0]), pa.array(b[b >= 0]), pa.array(near[b >= 0])], ["a", "b", "near"])

    return run


def checked(pairs: DataFrame, paths: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with ``near``, by a walk of the trie of each a's partners."""
    spark = pairs.sparkSession
    many = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c"))
    parts = F.ceil(F.col("c") / F.lit(TRIE)).cast("int")
    dealt = pairs.join(many.filter(F.col("c") > TRIE).select("a", parts.alias("parts")), "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    partners = dealt.join(paths.select(F.col("sid").alias("b"), "n", "path"), "b").select("a", "part", "b", "n", "path")
    owners = dealt.select("a", "part").distinct().join(paths.select(F.col("sid").alias("a"), "n", "path"), "a")
    owners = owners.select("a", "part", F.lit(-1).cast("long").alias("b"), "n", "path")
    walked = owners.union(partners).repartition(shuffle_partitions(spark), "a", "part").sortWithinPartitions("a", "part", F.col("b") >= 0, "path", "b")
    return walked.mapInArrow(_checked(percent), "a long, b long, near boolean")


def _classed(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Entries with the class of their set, of n-grams that sets of several classes have."""
    if labels is None:
        return entries.withColumn("label", F.col("sid"))
    both = entries.join(labels.select(F.col("id").alias("sid"), "label"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    mixed = both.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("g")
    return both.join(mixed, "g", "left_semi")


def linked_sets(paths: DataFrame, percent: int) -> DataFrame | None:
    """(id, label) of the sets that have a link: the classes; None without links."""
    spark = paths.sparkSession
    entries = stored(prefix_entries(paths, percent), "entries")
    repeated = entries.groupBy("g").agg(F.count(F.lit(1)).alias("c"), F.max("short").alias("s")).filter("c > 1 and s").select("g")
    entries = stored(entries.join(repeated, "g", "left_semi"), "shared-entries")
    links = seen = labels = None
    for number in range(ROUNDS + 1):
        live = stored(_classed(entries, labels), "classed")
        mine = live.select("g", *(F.col(c).alias(f"y_{c}") for c in ("sid", "n", "core", "own", *BITS, "left", "label", "short")))
        after = (F.col("n") > F.col("y_n")) | ((F.col("n") == F.col("y_n")) & (F.col("sid") > F.col("y_sid")))
        if number < ROUNDS:  # of each tree the set whose n-grams most others have; later that of a class that chance picks
            order = [-F.col("y_core"), F.col("y_sid")]
            pick = F.struct(*order) if not number else F.struct(F.xxhash64(F.lit(number), "y_label"), *order)
            mine = mine.groupBy("g").agg(F.min_by(F.struct(*(c for c in mine.columns if c != "g")), pick).alias("y")).select("g", "y.*")
            after = F.lit(True)
        met = live.join(mine, "g").filter(after & (F.col("label") != F.col("y_label")) & _fits(percent))
        pairs = met.select(F.col("y_sid").alias("a"), F.col("sid").alias("b"), F.col("y_core").alias("core"))
        pairs = pairs.distinct()
        if seen is not None:
            pairs = pairs.join(seen.union(seen.select("b", "a")), ["a", "b"], "left_anti")
        if number < ROUNDS:  # a set is held against one other set a round, so that a class costs a pair a member
            choice = F.struct(-F.col("core"), "a") if not number else F.struct(F.xxhash64(F.lit(number), "a"), "a")
            pairs = pairs.groupBy("b").agg(F.min(choice).alias("one")).select(F.col("one.a").alias("a"), "b")
        pairs = stored(pairs.select("a", "b"), "pairs")
        if pairs.isEmpty():
            if number < ROUNDS:
                continue
            break
        found = stored(checked(pairs, paths, percent), "checked")
        near = found.filter("near").select("a", "b")
        seen = found.select("a", "b") if seen is None else seen.union(found.select("a", "b"))
        if not near.isEmpty():
            links = near if links is None else links.union(near)
            labels = components(spark, links)
    return labels


def linked_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id per input row.

    ``component_id`` is the smallest doc_id that links reach. Documents without words or with a null text
    have no n-grams and are their own component. A row with a null doc_id is linked with nothing and
    has a null component. Rows that share a doc_id are one document with several texts: what one of them links is
    linked for all. Very long texts are one row of n-grams; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    low = stored(given.mapInArrow(_low_rows(words, percent), "doc_id long, n long, ka long, kb long, low array<long>"), "low")
    named = low.filter("doc_id is not null and n > 0")
    # equal sets are one set, named by a number that the written table keeps
    first = named.groupBy("ka", "kb").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.min_by("low", "doc_id").alias("low"))
    reps = stored(first.withColumn("sid", F.monotonically_increasing_id()), "sets")
    entries = reps.select("sid", F.explode("low").alias("g"))
    again = entries.groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("g")
    hits = entries.join(again, "g", "left_semi").groupBy("sid").agg(F.count(F.lit(1)).alias("c"))
    live = reps.drop("low").join(hits, "sid").filter(F.expr(f"c >= (n * {percent} + 99) div 100 div 10 + 1"))
    live = stored(live.select("sid", "n", F.col("first").alias("doc_id"), "ka", "kb"), "live")
    small = F.broadcast(live) if has_at_most(live, SMALL) else live
    whole = given.join(small, "doc_id").select("sid", "ka", "kb", "text").mapInArrow(_whole_rows(words), "sid long, grams array<long>")
    sets = stored(whole, "grams")
    if sets.count() > live.count():  # rows repeated with one id
        sets = stored(sets.dropDuplicates(["sid"]), "grams")
    paths = stored(ordered_sets(sets, live.select("sid", "n"), percent), "paths")
    labels = linked_sets(paths, percent)
    node = named.select("doc_id", "ka", "kb").join(reps.select("ka", "kb", "sid", "first"), ["ka", "kb"])
    if labels is None:
        joined = node.select("doc_id", F.col("first").alias("other"))
    else:
        least = reps.select(F.col("sid").alias("id"), "first").join(labels, "id").groupBy("label").agg(F.min("first").alias("least"))
        joined = node.join(labels.select(F.col("id").alias("sid"), "label"), "sid", "left").join(least, "label", "left").select("doc_id", F.coalesce("least", "first").alias("other"))
    # ids that several texts have tie their classes together
    found = joined.groupBy("doc_id").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    found = stored(found, "found")
    tied = found.filter("lo < hi")
    result = found.select("doc_id", F.col("lo").alias("component_id"))
    if not tied.isEmpty():
        pairs = tied.select(F.col("lo").alias("a"), F.col("hi").alias("b")).union(joined.join(tied, "doc_id").select(F.col("lo"), F.col("other")))
        roots = components(spark, pairs.filter("a <> b"))
        result = result.join(roots.select(F.col("id").alias("component_id"), "label"), "component_id", "left").select("doc_id", F.coalesce("label", "component_id").alias("component_id"))
    return low.select("doc_id", F.col("n").alias("n_shingles")).join(result, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
