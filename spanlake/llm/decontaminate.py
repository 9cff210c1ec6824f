"""Benchmark items in training documents: BM25 with block-max WAND, then overlap of question and answer.

Items are cut into parts of at most ``PART`` words and indexed: postings by word, in blocks with the
largest impact of each block of parts. BM25 impacts are divided by the part's score for itself, so a score is
the share of a part that a passage covers, in any order of words, and one threshold suits all.
Documents are queried whole, as passages of ``2 * PART`` words that overlap by half, so every run of
``PART`` words lies in one passage. A passage whose words cannot reach the threshold even with their
largest impacts in any block is left at once; the others run block-max WAND, which visits every part
that can reach the threshold and skips blocks that cannot. Nothing is cut at a number of results.

A retrieved item counts if its word trigrams are in the passages that found it: at least
``question`` of those of its question and ``answer`` of those of its answer. Without an answer column
the answer is the last sentence of an item of several, and an item of one sentence is all question.

Items beyond ``INDEX_BYTES`` of text are dealt to several indexes, each broadcast by itself; document
frequencies are those of all items. Words are lower-cased, ASCII punctuation parts them. Items without
words are never found; null and empty documents hold none.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.llm.scratch import stored
from spanlake.llm.toxicity import feature_bytes
from spanlake.llm.words import U64, hashed_words, shingles, words_of
from spanlake.ordered import with_running

PART, BLOCK, INDEX_BYTES = 64, 2, 8 << 20
K1, B = 1.2, 0.75
THRESHOLD, QUESTION, ANSWER, RUN = 0.5, 0.7, 0.5, 3


def question_answer(text: str) -> tuple[str, str]:
    """Text before the last sentence, and that sentence; an only sentence has no answer."""
    ends = [m.end() for m in re.finditer(r"[.?!](?=\s)|\n", text.rstrip())]
    return (text[: ends[-1]], text[ends[-1] :]) if ends and text[: ends[-1]].strip() else (text, "")


def _hashes(text: str | None) -> np.ndarray:
    return hashed_words(feature_bytes(text))[2]


def _runs(hashes: np.ndarray) -> np.ndarray:
    return np.unique(shingles(hashes, RUN))


@dataclass
class Postings:
    """Parts that have a word, ascending, with their impacts, and the largest impact in each block of parts."""

    parts: list[int]
    impacts: list[float]
    tops: dict[int, float]
    most: float


@dataclass
class Index:
    """Parts are numbered by length, so that the impacts in a block are alike and its maxima are tight."""

    item_ids: list[int]
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    part_item: list[int]
    words: np.ndarray
    postings: list[Postings]
    bounds: np.ndarray = field(init=False)
    #: the blocks of word w and their maxima are at ``ends[w]:ends[w + 1]``
    ends: np.ndarray = field(init=False)
    blocks: np.ndarray = field(init=False)
    tops: np.ndarray = field(init=False)

    def __post_init__(self):
        self.bounds = np.array([p.most for p in self.postings])
        self.ends = np.cumsum([0, *(len(p.tops) for p in self.postings)])
        self.blocks = np.array([b for p in self.postings for b in p.tops], np.int64)
        self.tops = np.array([t for p in self.postings for t in p.tops.values()])

    def reachable(self, words: np.ndarray, threshold: float) -> bool:
        """Whether the maxima of ``words`` add up to ``threshold`` in any block."""
        size = self.ends[words + 1] - self.ends[words]
        at = np.repeat(self.ends[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return bool((np.bincount(self.blocks[at], self.tops[at]) >= threshold).any()) if len(at) else False


def build(items: Sequence[dict], n_parts: int, mean_length: float) -> Index:
    """``items``: item_id, question, answer (word hashes), and df: parts of the whole collection that
    have each of the item's distinct words, in ascending order of the words."""
    parts: list[tuple[int, int, list[int], list[float]]] = []
    for i, item in enumerate(items):
        whole = np.concatenate([item["question"], item["answer"]])
        df = dict(zip(np.unique(whole).tolist(), item["df"]))
        for lo in range(0, len(whole), PART):
            part = whole[lo : lo + PART]
            words, tf = np.unique(part, return_counts=True)
            n = np.array([df[w] for w in words.tolist()], float)
            idf = np.log1p((n_parts - n + 0.5) / (n + 0.5))
            impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(part) / mean_length))
            parts.append((len(part), i, words.tolist(), (impact / impact.sum()).tolist()))
    parts.sort(key=lambda x: x[:2])
    found: dict[int, list[tuple[int, float]]] = {}
    for k, (_, _, words, impacts) in enumerate(parts):
        for w, x in zip(words, impacts):
            found.setdefault(w, []).append((k, x))
    vocabulary = sorted(found)
    lists = []
    for w in vocabulary:
        numbers, impacts = zip(*found[w])
        tops: dict[int, float] = {}
        for k, x in found[w]:
            tops[k // BLOCK] = max(x, tops.get(k // BLOCK, 0.0))
        lists.append(Postings(list(numbers), list(impacts), tops, max(impacts)))
    runs = [[_runs(x[side]) for x in items] for side in ("question", "answer")]
    return Index([x["item_id"] for x in items], *runs, [i for _, i, _, _ in parts], np.array(vocabulary, U64), lists)


def block_max_wand(lists: Sequence[Postings], threshold: float) -> dict[int, float]:
    """Parts whose impacts in ``lists`` add up to ``threshold`` or more, with their scores."""
    out: dict[int, float] = {}
    # [current part, position, list]
    cursors = [[p.parts[0], 0, p] for p in lists]
    while cursors:
        cursors.sort(key=lambda c: c[0])
        total, pivot = 0.0, -1
        for k, c in enumerate(cursors):
            total += c[2].most
            if total >= threshold:
                pivot = k
                break
        if pivot < 0:
            break
        part = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == part:
            pivot += 1
        moved = cursors[: pivot + 1]
        block = part // BLOCK
        if sum(c[2].tops.get(block, 0.0) for c in moved) < threshold:
            # nothing before the end of the block or the next list's part can reach it
            goal = (block + 1) * BLOCK
            if pivot + 1 < len(cursors):
                goal = min(goal, cursors[pivot + 1][0])
        else:
            score = 0.0
            for c in moved:
                at = bisect.bisect_left(c[2].parts, part, c[1])
                if at < len(c[2].parts) and c[2].parts[at] == part:
                    score += c[2].impacts[at]
            if score >= threshold:
                out[part] = score
            goal = part + 1
        for c in moved:
            c[1] = bisect.bisect_left(c[2].parts, goal, c[1])
            c[0] = c[2].parts[c[1]] if c[1] < len(c[2].parts) else -1
        cursors = [c for c in cursors if c[0] >= 0]
    return out


def passages(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first and last word bound of the passages of a block of documents."""
    n = np.diff(bounds)
    count = np.maximum(1, -(-(n - PART) // PART))
    doc = np.repeat(np.arange(len(n)), count)
    lo = bounds[:-1][doc] + PART * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
    return doc, lo, np.minimum(lo + 2 * PART, bounds[1:][doc])


def find(texts: Sequence[str | None], index: Index, threshold: float, question: float, answer: float) -> Iterator[list[dict]]:
    """For each text the items that it holds."""
    for lo, hi, hashes, bounds in words_of([feature_bytes(t) for t in texts]):
        out: list[list[dict]] = [[] for _ in range(hi - lo)]
        if len(index.words) and len(hashes):
            at = np.minimum(np.searchsorted(index.words, hashes), len(index.words) - 1)
            known = index.words[at] == hashes
            most = np.concatenate([[0.0], np.cumsum(np.where(known, index.bounds[at], 0.0))])
            doc, first, last = passages(bounds)
            met: dict[tuple[int, int], list] = {}
            for k in np.flatnonzero(most[last] - most[first] >= threshold - 1e-9).tolist():
                a, b = int(first[k]), int(last[k])
                mine = np.unique(at[a:b][known[a:b]])
                if not index.reachable(mine, threshold):
                    continue
                for part, score in block_max_wand([index.postings[w] for w in mine.tolist()], threshold).items():
                    met.setdefault((int(doc[k]), index.part_item[part]), []).append((score, a, b))
            for (d, i), places in sorted(met.items()):
                have = np.unique(np.concatenate([shingles(hashes[a:b], n) for _, a, b in places for n in range(1, RUN + 1)]))
                q, r = (float(np.isin(x, have).mean()) if len(x) else 1.0 for x in (index.questions[i], index.answers[i]))
                if q >= question and r >= answer:
                    out[d].append({"item_id": index.item_ids[i], "score": max(p[0] for p in places), "question_overlap": q, "answer_overlap": r})
        yield from out


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int64())
    for batch in batches:
        q, r, distinct = [], [], []
        for text, answer in zip(batch.column("text").to_pylist(), batch.column("answer").to_pylist()):
            text, answer = (text or "", answer) if answer is not None else question_answer(text or "")
            x, y = _hashes(text), _hashes(answer)
            q.append(x.view(np.int64))
            r.append(y.view(np.int64))
            whole = np.concatenate([x, y])
            parts = [np.unique(whole[k : k + PART]) for k in range(0, len(whole), PART)]
            distinct.append(np.concatenate(parts).view(np.int64) if parts else whole.view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), *(pa.array(c, kind) for c in (q, r, distinct))], ["item_id", "question", "answer", "words"])


def indexes(items: DataFrame, index_bytes: int = INDEX_BYTES) -> list[Index]:
    """Indexes of all ``items`` (item_id, text, and answer if there is one), each over a bounded share of them.

    Repeated items are indexed once per row; null ids are kept as null.
    """
    answer = F.col("answer").cast("string") if "answer" in items.columns else F.lit(None).cast("string")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    words = stored(rows.mapInArrow(_item_words, "item_id long, question array<long>, answer array<long>, words array<long>"), "items").filter(F.size("words") > 0)
    # one entry per part and distinct word, so counts are document frequencies over parts
    df = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    size = F.size("question") + F.size("answer")
    stats = words.agg(F.sum(F.ceil(size / PART)).alias("parts"), F.sum(size).alias("words")).first()
    if not stats["parts"]:
        return []
    keyed = with_running(words.withColumn("all", F.lit(0)), ["all"], ["item_id", F.xxhash64("question", "answer")], sums={"bytes": size * 8})
    keyed = keyed.withColumn("row", F.monotonically_increasing_id())
    keyed = stored(keyed.withColumn("index", F.floor(F.col("bytes") / index_bytes)), "item-words")
    counted = (
        keyed.select("row", F.explode(F.array_distinct("words")).alias("word"))
        .join(df, "word")
        .groupBy("row")
        .agg(F.collect_list(F.struct("word", "df")).alias("counts"))
    )
    ready = stored(keyed.join(counted, "row").select("index", "item_id", "question", "answer", "counts"), "item-counts")
    out = []
    for r in ready.select("index").distinct().orderBy("index").toLocalIterator():
        got = []
        for x in ready.filter(F.col("index") == r["index"]).orderBy("item_id").collect():
            q, a = (np.array(x[c], np.int64).view(U64) for c in ("question", "answer"))
            pairs = sorted((int(np.int64(c["word"]).view(U64)), c["df"]) for c in x["counts"])
            got.append({"item_id": x["item_id"], "question": q, "answer": a, "df": [n for _, n in pairs]})
        out.append(build(got, stats["parts"], stats["words"] / stats["parts"]))
    return out


_HITS = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"
_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))


def held_items(docs: DataFrame, text: Column, items: DataFrame, threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> Column:
    """array<struct<item_id, score, question_overlap, answer_overlap>>: the items that a text holds."""
    spark = docs.sparkSession

    def column(index: Index) -> Column:
        sent = spark.sparkContext.broadcast(index)

        @F.arrow_udf(_HITS)
        def run(col: pa.Array) -> pa.Array:
            return pa.array(list(find(col.to_pylist(), sent.value, threshold, question, answer)), _ARROW)

        return run(text)

    found = [column(x) for x in indexes(items)]
    return F.concat(*found) if found else F.expr(f"cast(array() as {_HITS})")


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated and items (what ``held_items`` gives) of every row of ``docs``."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_items(docs, F.col("text").cast("string"), items, **options).alias("items"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), "items")
