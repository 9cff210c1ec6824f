"""Language identification by bit-sliced Bloom filters of character n-grams.

One array of cells serves all languages: a cell holds one bit per language, so it is a Bloom filter
per language stored side by side. An n-gram sets its language's bit in ``HASHES`` cells; the bitwise
AND of an n-gram's cells is the mask of all languages that (may) contain it. A text's n-grams are
counted per language by the bits of their masks. A filter of fill ``f`` answers yes by chance for
``f ** HASHES`` of the n-grams it doesn't hold; counts are corrected by that share before the largest
decides.

Texts are lower-cased, everything but letters is a space, and an n-gram holds spaces only at its ends.

Training reads at most ``per_language`` rows of each language (those with the smallest hash of doc_id
and text, a bound that keeps the filters small); an n-gram enters a language's filter if it makes up
at least ``least_share`` of that language's n-grams in the sample and a tenth of its share in the
language where it is most frequent. Prediction reads every whole text, and nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.llm.scratch import unused
from spanlake.llm.words import U64, mix, slices

GRAM, HASHES, CELLS = 4, 3, 1 << 20
PER_LANGUAGE, LEAST_SHARE, RELATIVE = 3000, 2e-6, 0.1
UNKNOWN = "und"
MAX_LANGUAGES = 64
_BLOCK = 1 << 19
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def grams(text: str, size: int = GRAM) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of ``text``, with repeats, in blocks; none if it has no letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    for lo in range(0, max(1, len(points) - size + 1), _BLOCK):
        part = points[lo : lo + _BLOCK + size - 1]
        letter = _is_letter()[part]
        n = len(part) - size + 1
        if n <= 0:
            return
        ok = letter[0:n] | letter[size - 1 : size - 1 + n]
        for i in range(1, size - 1):
            ok = ok & letter[i : i + n]
        part = np.where(letter, part, 32).astype(U64)
        code = np.zeros(n, U64)
        for i in range(size):
            code = code * U64(0x110000 + 1) + part[i : i + n]
        yield mix(code[ok] + U64(size))


def places(hashes: np.ndarray, cells: int, k: int = HASHES) -> list[np.ndarray]:
    """The ``k`` cells of each n-gram."""
    step = (mix(hashes ^ U64(0xA24BAED4963EE407)) | U64(1))
    return [((hashes + U64(i) * step) % U64(cells)).astype(np.int64) for i in range(k)]


@dataclass(frozen=True)
class Filters:
    """Cells with a bit per language; ``languages[i]`` has bit ``i``, in order of training rows."""

    languages: tuple[str, ...]
    cells: np.ndarray
    hashes: int = HASHES
    size: int = GRAM

    def chance(self) -> np.ndarray:
        """Share of foreign n-grams that each language's filter answers yes to."""
        fill = np.array([np.count_nonzero(self.cells & U64(1 << i)) / len(self.cells) for i in range(len(self.languages))])
        return fill**self.hashes

    def counts(self, text: str) -> tuple[int, np.ndarray]:
        """Number of n-grams and, per language, how many of them its filter has."""
        n, per = 0, np.zeros(len(self.languages))
        for hashes in grams(text, self.size):
            masks = None
            for cell in places(hashes, len(self.cells), self.hashes):
                masks = self.cells[cell] if masks is None else masks & self.cells[cell]
            n += len(hashes)
            per += [np.count_nonzero(masks & U64(1 << i)) for i in range(len(self.languages))]
        return n, per

    def decide(self, text: str | None, chance: np.ndarray) -> tuple[str, float, float, int]:
        """(language, score, coverage, n-grams): score is the language's part of all corrected counts, coverage
        the corrected share of the text's n-grams that it has. Ties go to the language with more
        training rows."""
        n, per = self.counts(text) if text else (0, None)
        if not self.languages or (not n and not (text and any(c.isalpha() for c in text))):
            return UNKNOWN, 0.0, 0.0, n
        if not n:
            return self.languages[0], 0.0, 0.0, 0
        share = np.clip((per - n * chance) / np.maximum(1 - chance, 1e-9) / n, 0, 1)
        best = int(np.argmax(share))
        total = float(share.sum())
        return self.languages[best], float(share[best]) / total if total else 0.0, float(share[best]), n


def _counted(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            held: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(texts, langs):
                held.setdefault(lang, []).extend(grams(text, size))
            for lang, parts in held.items():
                values, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, U64), np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    return run


def _placed(cells: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes = np.asarray(batch.column("gram")).view(U64)
            for cell in places(hashes, cells, k):
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("bit")], ["cell", "bit"])

    return run


def train(
    rows: DataFrame, per_language: int = PER_LANGUAGE, cells: int = CELLS, k: int = HASHES, size: int = GRAM,
    least_share: float = LEAST_SHARE, relative: float = RELATIVE,
) -> Filters:
    """Filters learned from (doc_id, text, lang); rows without text or language are passed over.

    Collects one row per language and one per cell that is set, at most ``cells``.
    """
    known = rows.filter("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"), "doc_id")
    found = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = tuple(r["lang"] for r in found)
    if not languages:
        return Filters((), np.zeros(cells, U64), k, size)
    by_hash = F.xxhash64("doc_id", "length")
    first = Window.partitionBy("lang").orderBy(by_hash, "doc_id")
    # a language of many rows is cut by the hash before the window, to about twice the rows that are picked
    shares = F.create_map(*[x for r in found for x in (F.lit(r["lang"]), F.lit(min(1.0, 2.0 * per_language / r["count"])))])
    low = (F.shiftrightunsigned(by_hash.bitwiseXOR(F.lit(-(1 << 63))), 32) < F.element_at(shares, F.col("lang")) * F.lit(float(1 << 32)))
    # the sample is chosen on narrow rows, with a group limit before the shuffle, then fetched
    keys = known.select("lang", "doc_id", F.length("text").alias("length")).filter(low)
    picked = keys.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= per_language)
    sample = known.withColumn("length", F.length("text")).join(F.broadcast(picked.select("lang", "doc_id", "length").distinct()), ["lang", "doc_id", "length"])
    counted = sample.select("text", "lang").mapInArrow(_counted(size), "lang string, gram long, n long")
    counts = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    most = Window.partitionBy("gram")  # one row per language
    kept = share.withColumn("most", F.max("share").over(most)).filter((F.col("share") >= least_share) & (F.col("share") >= relative * F.col("most")))
    bit = F.element_at(F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(1 << i if i < 63 else -(1 << 63)))]), F.col("lang"))
    masks = (
        kept.groupBy("gram").agg(F.bit_or(bit.cast("long")).alias("bit"))
        .mapInArrow(_placed(cells, k), "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bit"))
    )
    table = np.zeros(cells, np.int64)
    got = masks.toArrow()
    table[np.asarray(got.column("cell"))] = np.asarray(got.column("bit"))
    return Filters(languages, table.view(U64), k, size)


_OUT = "lang_pred string, score double, coverage double, n_grams long"


def language(text: str | Column, filters: Filters) -> Column:
    """struct<lang_pred, score, coverage, n_grams> of a text column; the filters go along as a broadcast of fixed size."""
    sent = SparkSession.getActiveSession().sparkContext.broadcast(filters)

    @F.arrow_udf(_OUT)
    def run(col: pa.Array) -> pa.Array:
        f = sent.value
        chance = f.chance()
        rows = [f.decide(t.as_py(), chance) for t in col]
        langs, scores, cover, n = zip(*rows) if rows else ((), (), (), ())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(cover, pa.float64()), pa.array(n, pa.int64())], ["lang_pred", "score", "coverage", "n_grams"])

    return run(F.col(text) if isinstance(text, str) else text)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the quarter of the ids that nothing is learned from; false for null ids."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, columns: Sequence[str] = ("doc_id",), **options) -> DataFrame:
    """``columns``, held_out, lang_pred, score, coverage and n_grams of every row of ``docs`` (doc_id, text, lang).

    Filters are learned from the rows that are not held out. ``und`` with score 0 stands for null
    texts and texts without a letter, and for all if nothing could be learned.
    """
    filters = train(docs.filter(~held_out()).select("doc_id", "text", "lang"), **options)
    found, held = unused(docs, "_found", "_held")
    rows = docs.withColumn(found, language(F.col("text").cast("string"), filters)).withColumn(held, held_out())
    return rows.select(*columns, F.col(held).alias("held_out"), *(f"{found}.{c}" for c in ("lang_pred", "score", "coverage", "n_grams")))
