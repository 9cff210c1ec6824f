"""Word hashing for texts inside Arrow batches, with numpy over whole blocks of text.

A word is a maximal run of bytes other than 0x20 and 0x09 to 0x0D. Words get 64-bit hashes; the
functions are pure, so every task, replay and query computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * _MIX1
    x = (x ^ (x >> U64(27))) * _MIX2
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_tables.get("up", ())) <= n:
        size = max(n + 1, BLOCK + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, U64)
            table[0] = 1
            _tables[name] = np.multiply.accumulate(table)
    return _tables["up"], _tables["down"]


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words in an array of bytes."""
    word = np.empty(len(data) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not((data == 32) | ((data >= 9) & (data <= 13)), out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def _hashed(data: np.ndarray, heads: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = spans(data)
    up, down = _powers(len(data))
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    rows = []
    for n in (None, *heads):
        stops = ends if n is None else np.minimum(starts + n, ends)
        raw = (sums[stops] - sums[starts]) * down[starts]
        row = mix(raw ^ ((stops - starts).astype(U64) << U64(40)))
        rows.append(row if n is None else np.where(stops < ends, row ^ U64(n), U64(0)))
    return starts, ends, np.stack(rows) if heads else rows[0]


def hashed_words(data: bytes, heads: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of ``data``; works in blocks cut between words, so its
    extra memory doesn't grow with the length of a text.

    With ``heads`` the hashes are a row for the words and one for their first n bytes, for each n; 0
    for words of no more bytes.
    """
    arr = np.frombuffer(data, np.uint8)
    if len(arr) <= BLOCK:
        return _hashed(arr, heads)
    parts, lo = [], 0
    while lo < len(arr):
        hi = lo + BLOCK
        while hi < len(arr):
            tail = arr[lo:hi]
            gaps = np.flatnonzero((tail == 32) | ((tail >= 9) & (tail <= 13)))
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
                break
            hi += BLOCK
        s, e, h = _hashed(arr[lo:hi], heads)
        parts.append((s + lo, e + lo, h))
        lo = hi
    return tuple(np.concatenate(p, axis=-1) for p in zip(*parts))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in smaller pieces, so that few texts at a time are Python objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def blocks(texts: Sequence[bytes], limit: int = BLOCK) -> Iterator[tuple[int, int, bytes]]:
    """Consecutive texts joined by a line feed, ``limit`` bytes a block unless one text is longer:
    (first, end, bytes)."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > limit:
            yield lo, i, b"\n".join(texts[lo:i])
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts), b"\n".join(texts[lo:])


def words_of(texts: Sequence[bytes], heads: Sequence[int] = ()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per block of texts: (first, end, word hashes, bounds); the words of text ``first + i`` are
    ``bounds[i]:bounds[i + 1]``."""
    for lo, hi, data in blocks(texts):
        starts, _, hashes = hashed_words(data, heads)
        cuts = np.cumsum([0, *(len(t) + 1 for t in texts[lo:hi])])
        yield lo, hi, hashes, np.searchsorted(starts, cuts)


def shingles(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes; a shorter input is one shingle."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.full(n, seed, U64)
    for i in range(size):
        out = (out + hashes[i : i + n]) * _MIX1
        out ^= out >> U64(29)
    return mix(out)
