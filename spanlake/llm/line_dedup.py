"""Removal of lines that an earlier line is similar to: an exact set-similarity join in DataFrame operations.

A line is the set of its words (runs of non-space characters, as they are). A line goes if a line at an
earlier place (doc_id, then line number) has the same set or one of Jaccard similarity of at least
``threshold``; lines are judged on the input, so the result doesn't depend on the order of work.
Lines without words stay.

1. Rarity: words are counted over all lines in 65,536 hash buckets; buckets get one of 64 levels, a
   quarter of a binary order of magnitude each, and rarer levels come first. Any total order is
   correct, and buckets keep what every task needs to a fixed size. A word becomes a number whose
   upper six bits are its level and whose others are 58 bits of its hash.
2. Equal sets are one class with its first place.
3. Prefix filter: sets that are similar share one of their rarest ``n - ceil(t n) + 1`` words.
   Length and position filter: at the first word two sets share they must still be able to overlap
   by ``o = ceil(t / (1 + t) (n + m))``. Parity filter: of 64 bits (128 for long lines) each is flipped
   by some words; two sets can differ in no more bits than the ``n + m - 2 o`` words they may not share.
4. Hubs: each class is first held against the earliest one that shares one of its two rarest words.
   Those that prove similar to an earlier class are decided, so a large group of near copies gives a
   few pairs a line, not all pairs. Only the undecided are then held against all classes that share
   a prefix word with them.
5. Verification by the sets themselves, fetched from the texts.

Words of a prefix are compared by 31 bits of their hash, which can only add candidates; verification
compares 58. Sets of up to three words can only be similar if they are equal, for thresholds
above 3/4.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.scratch import stored, unused
from spanlake.runtime import shuffle_partitions

THRESHOLD = 0.8
BUCKETS, BITS, HUB_WORDS, WIDE = 1 << 16, 1 << 19, 2, 48
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"
_EPS = 1e-9


def _numbers(values: list[int]) -> Column:
    """A constant array, folded by the optimiser."""
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def _words(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), _SPACE)


def _levels(texts: DataFrame) -> Column:
    """Level of every bucket by the number of words that fall to it, eight levels in a number.

    Collects at most ``BUCKETS`` rows.
    """
    counted = texts.select(F.explode(_words(F.col("text"))).alias("w")).groupBy(F.shiftrightunsigned(F.xxhash64("w"), 48).alias("bucket")).count()
    packed = [0] * (BUCKETS // 8)
    for r in counted.collect():
        level = min(63, int(4 * math.log2(r["count"] + 1)))
        packed[r["bucket"] // 8] |= level << (6 * (r["bucket"] % 8))
    return _numbers(packed)


def _token_set(line: Column, levels: Column) -> Column:
    """Distinct words of a line as numbers, rarest first."""
    rest = (1 << 58) - 1

    def number(word: Column) -> Column:
        h = F.xxhash64(word)
        bucket = F.shiftrightunsigned(h, 48).cast("int")
        eight = F.coalesce(F.get(levels, F.shiftright(bucket, 3)), F.lit(0).cast("long"))
        level = F.call_function("shiftright", eight, bucket.bitwiseAND(F.lit(7)) * 6).bitwiseAND(F.lit(63)) - 32
        return F.shiftleft(level, 58).bitwiseOR(h.bitwiseAND(F.lit(rest)))

    return F.array_distinct(F.sort_array(F.transform(_words(line), number)))


def _member(keys: DataFrame, *columns: str) -> Column:
    """A test that holds for all keys in ``keys`` and few others, as a bitmap of fixed size.

    It spares most rows of a large table a shuffle; an exact join has to follow.
    """
    place = F.pmod(F.xxhash64(*columns), F.lit(BITS))
    bits = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("m"))
    cells = [0] * (BITS // 64)
    for r in bits.collect():
        cells[r["cell"]] = r["m"]
    cell = F.element_at(_numbers(cells), (F.shiftright(place, 6) + 1).cast("int"))
    bit = place.bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftrightunsigned", cell, bit).bitwiseAND(F.lit(1)) == 1


def _lines(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _floor_size(n: Column, t: float) -> Column:
    """Smallest size of a set that can be similar to one of size ``n``."""
    return F.ceil(n * F.lit(t) - F.lit(_EPS)).cast("int")


def _parity(words: Column, half: int | None = None) -> Column:
    """64 bits, each flipped by the words that fall to it; with ``half`` only by the words of that half."""
    one = F.lit(1).cast("long")

    def flip(x: Column, w: Column) -> Column:
        bit = F.call_function("shiftleft", one, w.bitwiseAND(F.lit(63)).cast("int"))
        return x.bitwiseXOR(bit) if half is None else F.when(w.bitwiseAND(F.lit(64)) == 64 * half, x.bitwiseXOR(bit)).otherwise(x)

    return F.aggregate(words, F.lit(0).cast("long"), flip)


def _fits(t: float) -> Column:
    """Whether sets x and y whose first shared word is at ``pos`` and ``y_pos`` may be similar."""
    n, m = F.col("n"), F.col("y_n")
    shared = F.ceil((n + m) * F.lit(t / (1 + t)) - F.lit(_EPS))
    fold = F.col("bits").bitwiseXOR(F.col("y_bits"))
    half = F.col("half").bitwiseXOR(F.col("y_half"))
    bits = F.when((n > WIDE) & (m > WIDE), F.bit_count(fold.bitwiseXOR(half)) + F.bit_count(half)).otherwise(F.bit_count(fold))
    return (F.least(n - F.col("pos"), m - F.col("y_pos")) >= shared) & (bits <= n + m - 2 * shared)


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, levels: Column, t: float) -> DataFrame:
    """(a, b) of the classes that are similar to an earlier partner in ``pairs`` (a, y_a).

    Either side of a pair may be the later one. Classes are known by ``a`` and looked up in ``classes``.
    """
    both = pairs.distinct()
    ids = stored(both, "pairs")
    wanted = ids.select("a").union(ids.select("y_a")).distinct()
    places = stored(classes.join(wanted, "a").select("a", "b", "at.doc_id", "at.line_no"), "places")
    lines = _lines(texts).filter(_member(places, "doc_id", "line_no")).join(places, ["doc_id", "line_no"])
    sets = lines.select("a", "b", F.struct("doc_id", "line_no").alias("at"), _token_set(F.col("line"), levels).alias("words"))
    # rows that share a doc_id have several lines at a place
    sets = stored(sets.filter(F.col("a") == F.xxhash64("words")), "sets")
    other = sets.select(*(F.col(c).alias(f"y_{c}") for c in sets.columns))
    shared = F.size(F.array_intersect("words", "y_words"))
    near_pairs = ids.join(sets, "a").join(other, "y_a").filter(shared >= F.lit(t) * (F.size("words") + F.size("y_words") - shared) - F.lit(_EPS))
    later = F.when(F.col("at") > F.col("y_at"), F.struct("a", "b")).when(F.col("at") < F.col("y_at"), F.struct(F.col("y_a").alias("a"), F.col("y_b").alias("b")))
    return near_pairs.select(later.alias("x")).filter("x is not null").select("x.a", "x.b").distinct()


def similar_lines(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, th, line_no) of the lines to remove from ``texts`` (doc_id, th, text)."""
    if not 0.75 < threshold <= 1:
        raise ValueError("threshold must be above 0.75 and at most 1")
    t = threshold
    levels = _levels(texts)
    full = _lines(texts).filter(F.btrim("line", F.lit(" \t\n\x0b\f\r")) != "")
    n = F.size("words")
    length = F.when(n > 3, n - _floor_size(n, t) + 1).otherwise(0)
    lines = stored(
        full.select("doc_id", "th", "line_no", _token_set(F.col("line"), levels).alias("words")).select(
            "doc_id", "th", "line_no", F.xxhash64("words").alias("a"), F.xxhash64(F.lit(1), "words").alias("b"), n.alias("n"),
            F.when(n > 3, _parity(F.col("words"))).otherwise(0).alias("bits"), F.when(n > WIDE, _parity(F.col("words"), 1)).otherwise(0).alias("half"), F.transform(F.slice("words", F.lit(1), length), lambda w: w.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")).alias("prefix"),
        ),
        "lines",
    )
    classes = stored(
        lines.groupBy("a", "b").agg(
            F.min(F.struct("doc_id", "line_no")).alias("at"), F.count(F.lit(1)).alias("many"),
            *(F.first(c).alias(c) for c in ("n", "bits", "half", "prefix")),
        ),
        "classes",
    )
    shape = ["a", "n", "bits", "half", "pos"]
    long = classes.filter("n > 3")
    parts = shuffle_partitions(texts.sparkSession)
    rarest = long.select("at", *shape[:4], F.posexplode(F.slice("prefix", 1, HUB_WORDS)).alias("pos", "word")).repartition(parts, "word")
    hub = rarest.groupBy("word").agg(F.min(F.struct("at", *shape)).alias("y"), F.count(F.lit(1)).alias("many")).filter("many > 1")
    met = rarest.join(hub.select("word", *(F.col(f"y.{c}").alias(f"y_{c}") for c in shape)), "word")
    decided = stored(_verified(met.filter("a != y_a").filter(_fits(t)).select("a", "y_a"), classes, texts, levels, t), "decided")
    entries = (
        long.join(decided.withColumn("gone", F.lit(1)), ["a", "b"], "left")
        .select(*shape[:4], F.coalesce("gone", F.lit(0)).alias("gone"), F.posexplode("prefix").alias("pos", "word"))
        .repartition(parts, "word")
    )
    partner = entries.select("word", *(F.col(c).alias(f"y_{c}") for c in (*shape, "gone")))
    # an undecided class against a decided one, or two undecided ones once; one expression, so that
    # both sides of the join stay the same table and are dealt once
    asks = F.col("gone") * 2 - F.col("y_gone") + (F.col("a") >= F.col("y_a")).cast("int") <= 0
    second = entries.join(partner, "word").filter(asks & (F.col("a") != F.col("y_a")) & _fits(t)).select("a", "y_a")
    gone = decided.union(_verified(second, classes, texts, levels, t)).distinct()
    # every line of a class with an earlier partner, and all but the first place of the other classes
    heads = classes.select("a", "b", "at", "many").join(gone.withColumn("gone", F.lit(True)), ["a", "b"], "left").filter("many > 1 or gone")
    found = lines.select("doc_id", "th", "line_no", "a", "b").join(heads, ["a", "b"])
    return found.filter(F.col("gone") | (F.struct("doc_id", "line_no") > F.col("at"))).select("doc_id", "th", "line_no")


def without_similar_lines(docs: DataFrame, threshold: float = THRESHOLD, n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """All columns of ``docs`` with the lines left in ``text``, and the numbers of lines and of lines removed.

    The two numbers take the place of columns of the same names.

    A line feed ends a line; the lines left are joined by one. Null texts stay null (no line), empty
    texts have one line without words. Rows with null doc_id stay as they are: they are at no place,
    neither earlier nor later. Rows repeated with one doc_id are at the same place.
    """
    columns = [c for c in docs.columns if c not in (n_lines, n_removed)]
    doc, th, lost, split = unused(docs, "_doc", "_th", "_gone", "_parts")
    rows = docs.withColumns({doc: F.col("doc_id").cast("long"), th: F.xxhash64("text")})
    known = rows.filter("doc_id is not null and text is not null")
    texts = known.select(F.col(doc).alias("doc_id"), F.col(th).alias("th"), F.col("text").cast("string").alias("text"))
    gone = similar_lines(texts, threshold).groupBy(F.col("doc_id").alias(doc), F.col("th").alias(th)).agg(F.collect_set("line_no").alias(lost))
    gone = stored(gone, "gone-lines")
    parts = F.split("text", "\n")
    touched = F.coalesce(_member(gone, doc), F.lit(False)) & F.col("text").isNotNull()
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("int")
    same = rows.filter(~touched).select(*columns, size.alias(n_lines), F.lit(0).alias(n_removed))
    # split once, not in the function over line numbers
    met = rows.filter(touched).join(gone, [doc, th], "left").withColumn(split, parts)
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.coalesce(lost, F.array().cast("array<int>")))
    kept = F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n")
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(kept)
    changed = met.select(
        *(text.alias("text") if c == "text" else F.col(c) for c in columns), F.size(split).alias(n_lines), F.coalesce(F.size(lost), F.lit(0)).alias(n_removed)
    )
    return same.unionByName(changed)
