"""Inverted index in blocks, and exact top-k ranking that reads only the blocks that can matter.

Documents that one task reads one after the other form a range of some thousand; a block holds the postings
of one term in one range, packed, with what bounds any document's share: the shortest document for each
term frequency. Building is one pass over the texts without a shuffle; document frequencies are sums over
block sizes. Ranges keep the documents' ids and lengths in a block of their own, under the empty term.

A search adds up, per query and range, the highest shares of the query's terms: no document of the range
scores more. The two most promising ranges of a query are ranked first; the k-th score found there
leaves out all ranges that can't reach it, and the rest is ranked in a second wave. Scores are added up in
the task that has the range, which passes on k rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.text import chunk_passages, tokenize
from spanlake.ordered import top_k
from spanlake.runtime import has_at_most, shared_path, stored

K1 = 1.2
B = 0.75
#: documents of a range; a chunk's passages are never divided
RANGE = 4096
PASSAGE_RANGE = 8192
#: tokens of a range, for long documents
TOKENS = 1 << 22
#: query terms that are sent to every task
SMALL_TERMS = 200_000
#: queries that one task ranks at a time over a range, and of these how many in one matrix
SHARE, ROWS = 1024, 128
#: ranges of a query in the first wave
FIRST = 2
#: scores are equal if they are so to nine places
_TIE = 1e-8
_MEMBERS = ""  # the term of the block with ids and lengths; no token is empty


@dataclass(frozen=True)
class BlockIndex:
    """blocks(range, term, n, tf, pos, top_tf, top_dl, ids), terms(term, df), stats(n_docs, avg_dl: one row)."""

    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame
    ids: tuple[str, ...]

    def frequencies(self, asked: DataFrame) -> DataFrame:
        """(term, df) of the asked terms that occur."""
        return self.terms.join(asked, "term", "left_semi")


def _packed(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Slices of ``values`` between ``cuts`` as bytes, in the least width that holds all of them."""
    top = int(values.max(initial=0))
    kind = "<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4"
    data = values.astype(kind)
    offsets = (cuts * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}" if n else "<u1").astype(np.int64)


def _ordered(batch: pa.Table, ids: Sequence[str]) -> pa.Table:
    return batch.take(pc.sort_indices(batch.select(list(ids)), [(c, "ascending") for c in ids]))


def _range_blocks(rows: pa.Table, ids: Sequence[str], number: int, schema: pa.Schema) -> pa.RecordBatch:
    """All blocks of a range of documents (ids, toks), the members' block first."""
    rows = _ordered(rows, ids)
    n = rows.num_rows
    toks = rows.column("toks").combine_chunks()
    dl = pc.list_value_length(toks).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = toks.flatten().dictionary_encode()
    narrow = np.int32 if len(coded.dictionary) * n < 1 << 31 else np.int64
    key = coded.indices.to_numpy(zero_copy_only=False).astype(narrow)
    key *= narrow(n)
    key += np.repeat(np.arange(n, dtype=narrow), dl)
    key.sort()
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    tf = np.diff(np.append(head, len(key))).astype(np.int32)
    key = key[head]
    term, pos = key // narrow(n), key % narrow(n)
    del key, head, toks
    cuts = np.concatenate([np.searchsorted(term, np.arange(len(coded.dictionary), dtype=narrow)), [len(term)]])
    # for each term and frequency the shortest document
    order = np.lexsort((dl[pos].astype(np.int32), tf, term)).astype(np.int32)
    t, f = term[order], tf[order]
    head = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (f[1:] != f[:-1])])) if len(t) else np.empty(0, np.int64)
    tops = np.concatenate([np.searchsorted(t[head], np.arange(len(coded.dictionary))), [len(head)]]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(tops), pa.array(v, pa.int32())) for v in (f[head], dl[pos[order]][head])]
    members = pa.StructArray.from_arrays([rows.column(c).combine_chunks() for c in ids], names=list(ids))
    terms = pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(cuts) - 1, number)), coded.dictionary.cast(pa.string()), pa.array(np.diff(cuts), pa.int32()),
            _packed(tf, cuts), _packed(pos, cuts), *lists, pa.nulls(len(cuts) - 1, pa.list_(members.type)),
        ],
        names=schema.names,
    )
    whole = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), members)
    nothing = pa.array([[]], pa.list_(pa.int32()))
    own = pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.array([_MEMBERS]), pa.array([n], pa.int32()), _packed(dl, np.array([0, n])), pa.array([b""], pa.binary()), nothing, nothing, whole],
        names=schema.names,
    )
    return pa.Table.from_batches([own.cast(schema), terms.cast(schema)]).combine_chunks().to_batches()[0]


def _blocks(ids: Sequence[str], size: int, schema: pa.Schema):
    """Ranges of ``size`` documents, or of fewer that have ``TOKENS`` tokens; a chunk's passages stay together."""

    def ranges(table: pa.Table, last: bool) -> Iterator[tuple[int, int]]:
        rows, first = table.num_rows, table.column(ids[0]).combine_chunks()
        upto = np.cumsum(pc.list_value_length(table.column("toks")).to_numpy().astype(np.int64))
        lo = 0
        while lo < rows:
            before = int(upto[lo - 1]) if lo else 0
            hi = min(lo + size, int(np.searchsorted(upto, before + TOKENS)) + 1)
            while hi < rows and first[hi].as_py() == first[hi - 1].as_py():
                hi += 1
            if hi >= rows and not last:  # its last chunk may go on
                return
            yield lo, min(hi, rows)
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, rows, tokens = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows, tokens = rows + batch.num_rows, tokens + len(batch.column("toks").flatten())
            if rows <= size and tokens <= TOKENS:
                continue
            table, end = pa.Table.from_batches(held), 0  # a range is copied alone
            for lo, end in ranges(table, False):
                yield _range_blocks(table.slice(lo, end - lo), ids, number, schema)
                number += 1
            held = table.slice(end).to_batches()
            rows, tokens = sum(b.num_rows for b in held), sum(len(b.column("toks").flatten()) for b in held)
        if rows:
            table = pa.Table.from_batches(held)
            for lo, end in ranges(table, True):
                yield _range_blocks(table.slice(lo, end - lo), ids, number, schema)
                number += 1

    return run


def build_blocks(docs: DataFrame, ids: Sequence[str] = ("chunk_id",), text: str = "content", path: str | None = None, size: int = RANGE) -> BlockIndex:
    """Write the index of ``docs`` to ``path``, else to the shared folder, and open it.

    A null text is a document without tokens. In each file blocks are sorted by term, so a search reads the
    row groups of its terms.
    """
    spark = docs.sparkSession
    path = path or shared_path(spark, "index")
    toks = docs.select(*ids, F.coalesce(tokenize(text), F.array().cast("array<string>")).alias("toks"))
    id_type = T.StructType([toks.schema[c] for c in ids])
    out = T.StructType(
        [
            T.StructField("range", T.LongType()), T.StructField("term", T.StringType()), T.StructField("n", T.IntegerType()),
            T.StructField("tf", T.BinaryType()), T.StructField("pos", T.BinaryType()),
            T.StructField("top_tf", T.ArrayType(T.IntegerType())), T.StructField("top_dl", T.ArrayType(T.IntegerType())),
            T.StructField("ids", T.ArrayType(id_type)),
        ]
    )
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    members = pa.list_(pa.struct([(c, kinds[toks.schema[c].dataType.simpleString()]) for c in ids]))
    numbers = pa.list_(pa.int32())
    schema = pa.schema([("range", pa.int64()), ("term", pa.string()), ("n", pa.int32()), ("tf", pa.binary()), ("pos", pa.binary()), ("top_tf", numbers), ("top_dl", numbers), ("ids", members)])
    blocks = stored(toks.mapInArrow(_blocks(ids, size, schema), out).sortWithinPartitions("term", "range"), "blocks", f"{path}/blocks")
    stored(blocks.filter(F.col("term") != _MEMBERS).groupBy("term").agg(F.sum("n").alias("df")).sortWithinPartitions("term"), "terms", f"{path}/terms")
    counted = blocks.filter(F.col("term") == _MEMBERS).select("n", "tf").mapInArrow(_lengths, "n long, dl long")
    stats = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("dl") / F.sum("n"), F.lit(0.0)).alias("avg_dl"))
    stored(stats, "stats", f"{path}/stats")
    return open_blocks(spark, path, ids)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.column("n").to_pylist()
        dl = [int(_unpacked(data, k).sum()) for data, k in zip(batch.column("tf").to_pylist(), n)]
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(dl, pa.int64())], names=["n", "dl"])


def build_passage_blocks(docs: DataFrame, path: str | None = None, size: int = PASSAGE_RANGE) -> BlockIndex:
    """Index of the passages of ``docs`` (chunk_id, content)."""
    cut_up = docs.select("chunk_id", F.explode_outer(chunk_passages("content")).alias("p")).filter(F.col("p").isNotNull())
    return build_blocks(cut_up.select("chunk_id", "p.start", "p.end", "p.text"), ("chunk_id", "start", "end"), "text", path, size)


def write_blocks(index: BlockIndex, path: str) -> None:
    """Copy an index to another folder."""
    stored(index.blocks.sortWithinPartitions("term", "range"), "blocks", f"{path}/blocks")
    stored(index.terms, "terms", f"{path}/terms")
    stored(index.stats, "stats", f"{path}/stats")


def open_blocks(spark: SparkSession, path: str, ids: Sequence[str]) -> BlockIndex:
    read = spark.read.parquet
    return BlockIndex(read(f"{path}/blocks"), read(f"{path}/terms"), read(f"{path}/stats"), tuple(ids))


def postings(index: BlockIndex) -> DataFrame:
    """(term, *ids, tf, dl), unpacked in place: a range is one group of blocks."""
    members = index.blocks.filter(F.col("term") == _MEMBERS).select("range", F.col("ids").alias("members"), F.col("tf").alias("lengths"))
    blocks = index.blocks.filter(F.col("term") != _MEMBERS).select("range", "term", "n", "tf", "pos")
    flat = blocks.mapInArrow(_flat, "range long, term string, tf int, at int")
    docs = members.mapInArrow(_lengths_of, T.StructType([T.StructField("range", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("dl", T.IntegerType()), T.StructField("id", index.blocks.schema["ids"].dataType.elementType)]))
    return flat.join(docs, ["range", "at"]).select("term", *(F.col(f"id.{c}").alias(c) for c in index.ids), "tf", "dl")


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.column("n").to_numpy(zero_copy_only=False)
        tf, at = (np.concatenate([_unpacked(d, k) for d, k in zip(batch.column(c).to_pylist(), n)] or [np.empty(0, np.int64)]) for c in ("tf", "pos"))
        row = pa.array(np.repeat(np.arange(len(n)), n))
        yield pa.RecordBatch.from_arrays([batch.column("range").take(row), batch.column("term").take(row), pa.array(tf, pa.int32()), pa.array(at, pa.int32())], names=["range", "term", "tf", "at"])


def _lengths_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column("members").slice(i, 1).flatten()
            n = len(ids)
            dl = _unpacked(batch.column("lengths")[i].as_py(), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, batch.column("range")[i].as_py())), pa.array(np.arange(n), pa.int32()), pa.array(dl, pa.int32()), ids], names=["range", "at", "dl", "id"])


# search


def share(tf, dl, avg):
    """Part of a score that does not depend on the query: of columns or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg))


def _reach(blocks: DataFrame, weights: DataFrame, small: bool) -> DataFrame:
    """(query_id, range, most): what a document of the range can score at most."""
    meta = blocks.select("range", "term", "top_tf", "top_dl")
    top = F.array_max(F.zip_with("top_tf", "top_dl", lambda tf, dl: share(tf.cast("double"), dl.cast("double"), F.col("avg_dl"))))
    asked = F.broadcast(weights) if small else weights
    return meta.join(asked, "term").groupBy("query_id", "range").agg(F.sum(F.col("w") * top).alias("most"))


def _first_of_chunks(scores: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Per query (row) and chunk the column of its best document, of equal ones the first."""
    rounded = np.round(scores, 9)
    best = np.maximum.reduceat(rounded, heads, axis=1)
    size = np.diff(np.append(heads, scores.shape[1]))
    at = np.where(rounded == np.repeat(best, size, axis=1), np.arange(scores.shape[1]), scores.shape[1])
    return np.minimum.reduceat(at, heads, axis=1)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best columns per row, of equal ones the first; all that score for k <= 0."""
    if k <= 0 or k >= scores.shape[1]:
        return np.nonzero(scores > 0)
    rounded = np.round(scores, 9)
    bound = np.maximum(-np.partition(-rounded, k - 1, axis=1)[:, k - 1], 0)
    row, col = np.nonzero((rounded >= bound[:, None]) & (scores > 0))
    order = np.lexsort((col, -rounded[row, col], row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], col[keep]


def _ranked(ids: Sequence[str], k: int, per_chunk: bool):
    def run(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        terms = blocks.column("term").to_pylist()
        own = terms.index(_MEMBERS)
        members = blocks.column("ids").combine_chunks().slice(own, 1).flatten()
        n = len(members)
        dl = _unpacked(blocks.column("tf")[own].as_py(), n).astype(float)
        fields = [pc.struct_field(members, [i]) for i in range(len(ids))]
        heads = np.flatnonzero(np.concatenate([[True], fields[0].to_numpy(zero_copy_only=False)[1:] != fields[0].to_numpy(zero_copy_only=False)[:-1]]))
        avg = asked.column("avg_dl")[0].as_py()
        place = {t: i for i, t in enumerate(terms)}
        names = asked.column("query_id").combine_chunks().dictionary_encode()
        who = names.indices.to_numpy(zero_copy_only=False)
        block = np.array([place.get(t, -1) for t in asked.column("term").to_pylist()])
        weight = asked.column("w").to_numpy()
        sizes, tfs, poss = (blocks.column(c) for c in ("n", "tf", "pos"))
        found = []
        for lo in range(0, len(names.dictionary), ROWS):
            count = min(ROWS, len(names.dictionary) - lo)
            scores = np.zeros((count, n))
            mine = np.flatnonzero((who >= lo) & (who < lo + count) & (block >= 0))
            mine = mine[np.argsort(block[mine], kind="stable")]
            edges = np.flatnonzero(np.diff(block[mine], prepend=-1, append=-1)) if len(mine) else np.empty(0, int)
            for a, b in zip(edges[:-1], edges[1:]):
                at = int(block[mine[a]])
                size = sizes[at].as_py()
                pos, tf = _unpacked(poss[at].as_py(), size), _unpacked(tfs[at].as_py(), size).astype(float)
                part = share(tf, dl[pos], avg)
                scores[np.ix_(who[mine[a:b]] - lo, pos)] += weight[mine[a:b], None] * part[None, :]
            if per_chunk:
                column = _first_of_chunks(scores, heads)
                row, col = _best(np.take_along_axis(scores, column, axis=1), k)
                col = column[row, col]
            else:
                row, col = _best(scores, k)
            found.append((row + lo, col, scores[row, col]))
        row, col, score = (np.concatenate(x) for x in zip(*found))
        col = pa.array(col)
        return pa.table([names.dictionary.take(pa.array(row)), *(f.take(col) for f in fields), pa.array(score)], names=["query_id", *ids, "score"])

    return run


def _ranges_ranked(index: BlockIndex, pairs: DataFrame, weights: DataFrame, small: bool, shares: int, k: int, per_chunk: bool) -> DataFrame:
    """Best documents of each (query_id, range) of ``pairs``."""
    asked = pairs.join(F.broadcast(weights) if small else weights, "query_id")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int"))
    wanted = asked.select(F.col("range").alias("r"), F.col("part").alias("p"), "term")
    rows = wanted.select("r", "p", F.lit(_MEMBERS).alias("term")).union(wanted).distinct()
    blocks = index.blocks.withColumnRenamed("range", "r").select("r", "term", "n", "tf", "pos", "ids")
    if small:  # before any shuffle, only the blocks of the terms
        terms = weights.select("term").distinct().union(weights.sparkSession.createDataFrame([(_MEMBERS,)], "term string"))
        blocks = blocks.join(F.broadcast(terms), "term", "left_semi")
    met = blocks.join(rows, ["r", "term"]).groupBy("r", "p")
    asked = asked.select("query_id", "range", "part", "term", "w", "avg_dl")
    schema = T.StructType([asked.schema["query_id"], *index.blocks.schema["ids"].dataType.elementType.fields, T.StructField("score", T.DoubleType())])
    return met.cogroup(asked.groupBy("range", "part")).applyInArrow(_ranked(index.ids, k, per_chunk), schema)


def block_search(queries: DataFrame, index: BlockIndex, weights: DataFrame, k: int, per_chunk: bool = False) -> DataFrame:
    """(query_id, *ids, score): at least the ``k`` best documents of each query, all that share a term for k <= 0.

    weights: (query_id, term, w, avg_dl). With ``per_chunk`` the best document of each first id counts.
    Equal scores, to nine places, go by ids.
    """
    weights = stored(weights, "weights")
    small = has_at_most(weights, SMALL_TERMS)
    shares = max(1, -(-queries.count() // SHARE))
    reach = stored(_reach(index.blocks, weights, small), "reach")
    if k <= 0:
        return _ranges_ranked(index, reach.select("query_id", "range"), weights, small, shares, 0, per_chunk)
    order = [F.col("most").desc(), F.col("range").asc()]
    first = stored(top_k(reach, ["query_id"], order, FIRST, "wave").drop("wave"), "first-wave")
    hits = stored(_ranges_ranked(index, first.select("query_id", "range"), weights, small, shares, k, per_chunk), "first-hits")
    kept = top_k(hits, ["query_id"], [F.round("score", 9).desc(), *(F.col(c).asc() for c in index.ids)], k)
    floor = kept.filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    rest = reach.join(first.select("query_id", "range"), ["query_id", "range"], "left_anti").join(floor, "query_id", "left")
    rest = stored(rest.filter(F.col("floor").isNull() | (F.col("most") >= F.col("floor") - F.lit(_TIE))).select("query_id", "range"), "second-wave")
    if rest.isEmpty():
        return hits
    return hits.unionByName(_ranges_ranked(index, rest, weights, small, shares, k, per_chunk))

