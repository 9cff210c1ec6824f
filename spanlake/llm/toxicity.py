"""Severity of toxic texts by cumulative-link ordinal regression on sparse word features.

One weight per word is shared by all thresholds: P(grade > j) = 1 / (1 + exp(theta_j - w . x)), with
theta ascending. The output is the expected grade, the sum of P(grade > j) over the thresholds.

Features are the words of a text and their beginnings of ``HEADS`` bytes, so that inflected forms meet
(lower-cased, ASCII punctuation parts words), by 64-bit hash, each as "at least once", "twice" and
"three times". The fit reads at most ``max_rows`` labelled rows (those with the smallest hash of their
id). Of their features those that go with the grade by at least ``least_z`` standard deviations are
kept, the ``max_features`` strongest at most; they are counted by Spark, and the sample reaches the driver
as the kept features only. Prediction reads every whole text. Null and empty texts have no feature and
get the grade that the thresholds alone give.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.scratch import stored
from spanlake.llm.words import U64, slices, words_of

MAX_ROWS, MIN_ROWS, MAX_FEATURES, LEAST_Z, L2, STEPS = 12_000, 3, 20_000, 2.5, 1.0, 300
HEADS, LEVELS, FOLDS = (5, 6, 7, 8), 3, 4
_PARTED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def feature_bytes(text: str | None) -> bytes:
    return (text or "").lower().encode().translate(_PARTED)


def features(texts: Sequence[str | None], wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of texts: text number, feature, and how often the text has it.

    With ``wanted`` (ascending) only those, as their places in it.
    """
    for lo, hi, hashes, bounds in words_of([feature_bytes(t) for t in texts], HEADS):
        doc = np.repeat(np.arange(lo, hi), np.diff(bounds))
        flat, owner = hashes.reshape(-1), np.tile(doc, len(hashes))
        if wanted is None:
            live = flat != 0
            flat, owner = flat[live], owner[live]
            order = np.lexsort((flat, owner))
            flat, owner = flat[order], owner[order]
        else:
            at = np.minimum(np.searchsorted(wanted, flat), len(wanted) - 1)
            hit = np.flatnonzero(wanted[at] == flat)
            key = np.sort(owner[hit] * len(wanted) + at[hit])
            flat, owner = key % len(wanted), key // len(wanted)
        if len(flat):
            head = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])]))
            yield owner[head], flat[head], np.diff(np.concatenate([head, [len(flat)]]))


@dataclass(frozen=True)
class Severity:
    """Features (ascending hashes) with the shared weights of their levels, and a threshold below each grade from 1 on."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    #: P(grade > 0) from which a text is flagged
    flag: float = 0.5

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        if not len(self.features):
            return out
        upto = np.concatenate([np.zeros((len(self.weights), 1)), np.cumsum(self.weights, axis=1)], axis=1)
        for doc, at, n in features(texts, self.features):
            out += np.bincount(doc, upto[at, np.minimum(n, LEVELS)], minlength=len(texts))
        return out

    def above(self, texts: Sequence[str | None]) -> np.ndarray:
        """P(grade > j) for each text and threshold."""
        return _sigmoid(self.scores(texts)[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_cumulative_link(
    rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_cols: int, n_grades: int, l2: float = L2, steps: int = STEPS
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised likelihood of ``grades``.

    (rows, cols) are the ones of a sparse 0/1 matrix. Thresholds are the first one plus exponentials,
    so they stay in order. Adam on the whole sample with a falling step.
    """
    n, m = len(grades), n_grades - 1
    w = np.zeros(n_cols)
    share = np.clip(np.array([(grades <= j).mean() for j in range(m)]), 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    start = np.maximum.accumulate(start + 0.01 * np.arange(m))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.01))])
    state = [np.zeros(n_cols + m), np.zeros(n_cols + m)]
    for t in range(1, steps + 1):
        gaps = np.exp(free[1:])
        theta = free[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, w[cols], minlength=n)
        below = np.concatenate([np.zeros((n, 1)), _sigmoid(theta[None, :] - score[:, None]), np.ones((n, 1))], axis=1)
        upper, lower = below[np.arange(n), grades + 1], below[np.arange(n), grades]
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        by_score = du - dl  # of the negative log-likelihood
        by_theta = np.zeros(m + 2)
        np.add.at(by_theta, grades + 1, -du)
        np.add.at(by_theta, grades, dl)
        by_theta = by_theta[1 : m + 1]
        by_free = np.concatenate([[by_theta.sum()], gaps * np.cumsum(by_theta[::-1])[::-1][1:]])
        grad = np.concatenate([np.bincount(cols, by_score[rows], minlength=n_cols) + l2 * w, by_free])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        step = 0.1 * (1 - (t - 1) / steps) * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        w = w - step[:n_cols]
        free = free - step[n_cols:]
    return w, free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def flag_threshold(p: np.ndarray, toxic: np.ndarray) -> float:
    """The P(grade > 0) from which flags have the best F1 on a sample; half way to the next lower value."""
    if not toxic.any() or toxic.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, hit = p[order], np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + toxic.sum())
    f1[:-1][p[1:] == p[:-1]] = -1  # equal values go together
    best = int(np.argmax(f1))
    return float(p[best] + p[best + 1]) / 2 if best + 1 < len(p) else float(p[best])


def _out_of_fold(rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, folds: np.ndarray, n_cols: int, n_grades: int, l2: float, steps: int) -> np.ndarray:
    """P(grade > 0) of every row by a fit on the rows of the other folds."""
    p = np.zeros(len(grades))
    for fold in np.unique(folds):
        mine = folds == fold
        number = np.cumsum(~mine) - 1
        others = ~mine[rows]
        w, theta = fit_cumulative_link(number[rows[others]], cols[others], grades[~mine], n_cols, n_grades, l2, steps)
        score = np.bincount(rows[~others], w[cols[~others]], minlength=len(grades))
        p[mine] = _sigmoid(score[mine] - theta[0])
    return p


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and sum of grades of every feature and level in a batch."""
    for batch in slices(batches):
        grade = np.asarray(batch.column("grade")).astype(float)
        for doc, feature, n in features(batch.column("text").to_pylist()):
            for level in range(1, LEVELS + 1):
                doc, feature, n = (x[n >= level] for x in (doc, feature, n))
                values, place = np.unique(feature, return_inverse=True)
                rows, total = np.bincount(place, minlength=len(values)), np.bincount(place, grade[doc], minlength=len(values))
                names = ["feature", "level", "n", "total"]
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.full(len(values), level, np.int32)), pa.array(rows.astype(np.int64)), pa.array(total)], names)


def _kept(wanted: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at: list[list[int]] = [[] for _ in range(batch.num_rows)]
            times: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for doc, feature, n in features(batch.column("text").to_pylist(), wanted):
                for d, f, k in zip(doc.tolist(), feature.tolist(), n.tolist()):
                    at[d].append(f)
                    times[d].append(min(k, LEVELS))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("grade"), batch.column("fold"), pa.array(at, kind), pa.array(times, kind)], ["grade", "fold", "at", "times"])

    return run


def train(
    docs: DataFrame, grades: DataFrame, max_rows: int = MAX_ROWS, min_rows: int = MIN_ROWS, max_features: int = MAX_FEATURES,
    least_z: float = LEAST_Z, l2: float = L2, steps: int = STEPS,
) -> Severity:
    """Fit on the labelled rows: ``docs`` (doc_id, text) and ``grades`` (doc_id, grade from 0 up).

    Several grades of one id count as their largest; null ids and grades are passed over. At most
    ``max_features`` features and ``max_rows`` rows reach the driver. Without two grades the severity is
    the only grade, or 0.
    """
    one = grades.filter("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    # a bounded sample: at most max_rows pairs of numbers are broadcast
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("grade", "text")
    texts = stored(texts, "sample")
    told = texts.agg(F.count(F.lit(1)).alias("n"), F.avg("grade").alias("mean"), F.var_pop("grade").alias("var"), F.max("grade").alias("most")).first()
    if not told["n"] or not told["var"]:
        return Severity(np.empty(0, U64), np.empty((0, LEVELS)), np.full(told["most"] or 0, -40.0))
    n, mean, var = told["n"], told["mean"], told["var"]
    spread = F.sqrt(F.greatest(F.col("n") * (1 - F.col("n") / n), F.lit(1e-9)) * F.lit(var))
    counts = texts.mapInArrow(_counted, "feature long, level int, n long, total double").groupBy("feature", "level").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    strong = counts.withColumn("z", F.abs(F.col("total") - F.col("n") * mean) / spread).filter((F.col("n") >= min_rows) & (F.col("z") >= least_z))
    found = strong.groupBy("feature").agg(F.max("z").alias("z")).orderBy(F.desc("z"), "feature").limit(max_features).toArrow()
    wanted = np.sort(np.asarray(found.column("feature").combine_chunks()).view(U64))
    if not len(wanted):
        wanted = np.zeros(1, U64)
    # copies of a text are in one fold
    dealt = texts.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int"))
    got = dealt.mapInArrow(_kept(wanted), "grade int, fold int, at array<int>, times array<int>").limit(max_rows).collect()
    y = np.array([r["grade"] for r in got])
    rows, cols = [], []
    for i, r in enumerate(got):
        for at, times in zip(r["at"], r["times"]):
            rows.extend([i] * times)
            cols.extend(at * LEVELS + level for level in range(times))
    at, size = (np.array(rows, np.int64), np.array(cols, np.int64)), (len(wanted) * LEVELS, int(told["most"]) + 1)
    w, theta = fit_cumulative_link(*at, y, *size, l2, steps)
    p = _out_of_fold(*at, y, np.array([r["fold"] for r in got]), *size, l2, steps)
    return Severity(wanted, w.reshape(-1, LEVELS), theta, flag_threshold(p, y > 0))


def severity(text: str | Column, model: Severity) -> Column:
    """struct<severity, grade, p_toxic>: expected grade, most likely grade and P(grade > 0)."""
    sent = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.arrow_udf("severity double, grade int, p_toxic double")
    def run(col: pa.Array) -> pa.Array:
        above = sent.value.above(col.to_pylist())
        if not above.shape[1]:
            above = np.zeros((len(col), 1))
        steps = np.concatenate([np.ones((len(col), 1)), above, np.zeros((len(col), 1))], axis=1)
        likely = np.argmax(steps[:, :-1] - steps[:, 1:], axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(above.sum(axis=1)), pa.array(likely.astype(np.int32)), pa.array(above[:, 0])], ["severity", "grade", "p_toxic"]
        )

    return run(F.col(text) if isinstance(text, str) else text)


def label_grades(labels: DataFrame) -> DataFrame:
    """Ordered grades from 0/1 labels: 0 not toxic, 1 toxic in a text of quality, 2 toxic and of none; null without ``toxic``."""
    grade = F.when(F.col("toxic") == 0, 0).when((F.col("toxic") == 1) & (F.col("quality") == 0), 2).when(F.col("toxic") == 1, 1)
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))


def graded(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, severity, grade, p_toxic and toxic of every row of ``docs``: p_toxic is at least the flag's
    threshold, which has the best F1 on the labelled sample by fits that have not seen the row."""
    model = train(docs, label_grades(labels), **options)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), severity(F.col("text").cast("string"), model).alias("_found"))
    return found.select("doc_id", "_found.severity", "_found.grade", "_found.p_toxic", (F.col("_found.p_toxic") >= model.flag).alias("toxic"))
