"""Bottom-k sketches of five-word shingles.

A sketch is the ``k`` smallest distinct 64-bit shingle hashes of a text, ascending. The sketch of a
union is the ``k`` smallest of the united sketches, so parts are sketched apart and merged in any
order. Words are lower-cased runs of non-space bytes; a text of one to four words is one shingle; a
text without words has the empty sketch, which is like itself (1) and unlike any other (0).

Texts are fingerprinted whole. Null texts count as empty.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.words import U64, shingles, slices, words_of
from spanlake.runtime import shuffle_partitions

K, WORDS = 128, 5
FINE = 4


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The ``k`` smallest distinct values, ascending."""
    if len(hashes) > 8 * k:
        # repeats may leave fewer than k distinct values among the smallest, so widen until enough
        take = 4 * k
        while take < len(hashes):
            found = np.unique(np.partition(hashes, take)[:take])
            if len(found) >= k:
                return found[:k]
            take *= 4
    return np.unique(hashes)[:k]


def sketches(texts: Sequence[str], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for lo, hi, hashes, bounds in words_of([t.lower().encode() for t in texts]):
        out.extend(bottom(shingles(hashes[bounds[i] : bounds[i + 1]], words), k) for i in range(hi - lo))
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return bottom(np.concatenate([a, b]), k)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; exact while the union has at most ``k`` shingles."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, union, assume_unique=True).sum()) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below ``k``."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the shingles of ``a`` that ``b`` has too."""
    if not len(a):
        return 1.0
    r = resemblance(a, b, k)
    return min(1.0, r / (1 + r) * (distinct(a, k) + distinct(b, k)) / distinct(a, k))


def packed(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def unpacked(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(U64)


def fingerprint(text: str | Column, k: int = K, words: int = WORDS) -> Column:
    """Packed sketch of a text column."""

    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([packed(s) for s in sketches([t or "" for t in col.to_pylist()], k, words)], pa.string())

    return run(F.col(text) if isinstance(text, str) else text)


def merged(df: DataFrame, keys: Sequence[str], sketch: str, k: int = K) -> DataFrame:
    """One packed sketch per group: the sketch of all the group's parts together.

    Each task first keeps the ``k`` smallest hashes it has of a group, so a group of any size is
    merged from a few rows per task. A null sketch adds nothing.
    """

    @F.arrow_udf("array<long>")
    def values(col: pa.Array) -> pa.Array:
        # order-preserving map of unsigned to signed values
        out = [(unpacked(s or "") ^ U64(1 << 63)).view(np.int64).tolist() for s in col.to_pylist()]
        return pa.array(out, pa.list_(pa.int64()))

    @F.arrow_udf("string")
    def pack(col: pa.Array) -> pa.Array:
        out = [packed(np.sort(np.array(v, np.int64).view(U64) ^ U64(1 << 63))) for v in col.to_pylist()]
        return pa.array(out, pa.string())

    flat = df.select(*keys, F.explode_outer(values(F.col(sketch))).alias("_h")).distinct()
    first = Window.partitionBy(*keys).orderBy(F.col("_h").asc_nulls_last())
    kept = flat.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= k)
    return kept.groupBy(*keys).agg(F.collect_list("_h").alias("_v")).select(*keys, pack(F.col("_v")).alias(sketch))


def compare(a: str, b: str, k: int = K) -> Column:
    """struct<resemblance, containment, distinct_a, distinct_b> of two packed sketch columns."""

    @F.arrow_udf("resemblance double, containment double, distinct_a double, distinct_b double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        rows = []
        for s, t in zip(x.to_pylist(), y.to_pylist()):
            u, v = unpacked(s or ""), unpacked(t or "")
            rows.append({"resemblance": resemblance(u, v, k), "containment": containment(u, v, k), "distinct_a": distinct(u, k), "distinct_b": distinct(v, k)})
        return pa.array(rows, pa.struct([(n, pa.float64()) for n in ("resemblance", "containment", "distinct_a", "distinct_b")]))

    return run(F.col(a), F.col(b))


def _above(value: Column, bounds: list[int]) -> Column:
    """How many of the descending ``bounds`` are above ``value``, by bisection."""
    if not bounds:
        return F.lit(0)
    table = F.expr(f"split('{','.join(map(str, bounds))}', ',')").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))])
    fits = lambda acc, s: (acc + s <= len(bounds)) & (F.try_element_at(table, acc + s) > value)
    return F.aggregate(steps, F.lit(0), lambda acc, s: F.when(fits(acc, s), acc + s).otherwise(acc))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows dealt so that a task sees documents in descending doc_id order, each followed by its next.

    Adds ``_part`` (a range of ids) and ``_extra`` (1 for the copy of the first row of the following
    range, sent along so that the last row of a range finds its successor; the last range gets the
    first row of all). Ids are cut at approximate quantiles, the text moves once. Null ids come last.
    """
    parts = FINE * shuffle_partitions(docs.sparkSession)
    probs = [i / parts for i in range(1, parts)]
    found = docs.select(F.percentile_approx("doc_id", probs, 10 * parts)).first()[0] or []
    bounds = sorted(set(found), reverse=True)
    part = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(_above(F.col("doc_id"), bounds)).cast("int")
    placed = docs.withColumn("_part", part)
    # one row per range, at most `parts`
    heads = sorted((r["_part"], r["head"]) for r in placed.groupBy("_part").agg(F.max("doc_id").alias("head")).collect())
    before = {p: heads[i - 1][0] for i, (p, _) in enumerate(heads)}
    by_part = lambda d, kind: F.element_at(
        F.expr(f"split('{','.join('' if d.get(p) is None else str(d[p]) for p in range(len(bounds) + 1))}', ',')"), F.col("_part") + 1
    ).try_cast(kind)
    own = F.struct(F.col("_part"), F.lit(0).alias("_extra"))
    sent = F.struct(by_part(before, "int").alias("_part"), F.lit(1).alias("_extra"))
    is_head = F.col("doc_id").eqNullSafe(by_part(dict(heads), "bigint"))
    dealt = placed.select(*docs.columns, F.explode(F.when(is_head, F.array(own, sent)).otherwise(F.array(own))).alias("_to"))
    return (
        dealt.select(*docs.columns, "_to._part", "_to._extra")
        .repartition(shuffle_partitions(docs.sparkSession), "_part")
        .sortWithinPartitions("_part", "_extra", F.col("doc_id").desc_nulls_last(), "text")
    )


EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, distinct_shingles double"
)


def _edited(k: int, words: int):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in EDITED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (part, doc_id, text, sketch) still waiting for its next document
        for batch in slices(batches):
            cols = [batch.column(n).to_pylist() for n in ("_part", "_extra", "doc_id", "text")]
            mine = sketches(cols[3], k, words)
            pairs = []
            for part, extra, doc_id, text, sketch in zip(*cols, mine):
                if last is not None and last[0] == part:
                    pairs.append((last, text, sketch))
                # an extra row only completes its range; rows that repeat it are passed over
                last = None if extra else (part, doc_id, text, sketch)
            texts = []
            for (_, _, text, _), following, _ in pairs:
                m = len(text) // 3
                texts.append(text[: len(text) - m] + following[:m])
            rows = []
            for ((_, doc_id, text, own), _, nxt), edited, other in zip(pairs, texts, sketches(texts, k, words)):
                rows.append(
                    (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), packed(own), packed(other),
                     resemblance(own, other, k), resemblance(own, nxt, k), distinct(own, k))
                )
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def edited_fingerprints(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last third of the code points replaced by as many from the start of the
    next document in descending doc_id order (rows of one id by text; null ids last; after the last
    row comes the first; a lone document follows itself). One row per input row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return with_next(rows).mapInArrow(_edited(k, words), EDITED)
