"""Nearest neighbours: exact blocked products and a banded approximate variant."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.ordered import top_k
from spanlake.runtime import has_at_most

SMALL_LEFT = 1024  # rows of queries that may be shipped to every task
BLOCK_ROWS = 2048
#: rows of the largest block that travels to a task, and columns of one product
TRAVEL_ROWS = 32_768
TILE = 4096


def travelling_blocks(rows: int, block_rows: int, cores: int) -> int:
    """Blocks of ``rows`` rows when all pairs of blocks are met: as few as tasks can hold, since a row travels once for
    each, but of at least ``block_rows`` rows enough for pairs to keep ``cores`` busy."""
    return max(1, -(-rows // TRAVEL_ROWS), min(-(-rows // block_rows), math.isqrt(3 * cores) + 1))


def _slack(d: int) -> float:
    """More than a product of unit vectors in single precision can be off."""
    return (d + 8) * 2.0**-23


def lowest_pair(x: np.ndarray, y: np.ndarray, x_at: np.ndarray, y_at: np.ndarray, same: bool) -> tuple[float, int, int]:
    """(cosine to nine places, lower, higher place) of the least similar of unit rows x and y, of equal pairs the first.

    Places ascend on either side; with ``same`` both sides are one, and a row isn't met with itself. Products are
    made in single precision, and again in double where they come within its error of the lowest so far.
    """
    x4, y4, slack = x.astype(np.float32), y.astype(np.float32), _slack(x.shape[1])
    best = (np.inf, 0, 0)
    for lo in range(0, len(x), 512):
        for at in range(lo // TILE * TILE if same else 0, len(y), TILE):
            part = x4[lo : lo + 512] @ y4[at : at + TILE].T
            met = None
            if same and at < lo + 512:
                met = np.arange(at, at + part.shape[1])[None, :] <= np.arange(lo, lo + len(part))[:, None]
                part[met] = np.inf
            rows = np.flatnonzero(part.min(axis=1) <= best[0] + slack)
            if not len(rows):
                continue
            sims = np.round(x[lo + rows] @ y[at : at + TILE].T, 9)
            if met is not None:
                sims[met[rows]] = np.inf
            low = float(sims.min())
            if low > best[0] or low == np.inf:
                continue
            equal = sims == low
            r = np.flatnonzero(equal.any(axis=1))
            # the first of a row's equal columns makes its first pair
            a, b = x_at[lo + rows[r]], y_at[at + equal[r].argmax(axis=1)]
            best = min(best, (low, *min(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))))
    return best


def _by_dim(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(row numbers, unit rows)] per vector length; zero vectors stay zero."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(sizes):
        if d == 0:
            continue
        rows = np.flatnonzero(sizes == d)
        m = col.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        norm = np.sqrt(np.einsum("ij,ij->i", m, m))
        norm[norm == 0] = np.inf
        out.append((rows, m / norm[:, None]))
    return out


def similarity(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Cosine matrix; 0 where lengths differ or a vector is empty."""
    sims = np.zeros((len(left), len(right)))
    rights = {m.shape[1]: (rows, m) for rows, m in _by_dim(right)}
    for rows, m in _by_dim(left):
        if m.shape[1] in rights:
            r_rows, rm = rights[m.shape[1]]
            sims[np.ix_(rows, r_rows)] = m @ rm.T
    return sims


def best_per_row(sims: np.ndarray, right_ids: np.ndarray, k: int, skip: np.ndarray | None, floor: float | None):
    """Row and column numbers of the k best columns per row by (similarity to 9 places, id)."""
    rounded = np.round(sims, 9)
    if skip is not None:
        rounded[skip] = -np.inf
    if floor is not None:
        rounded[sims < floor] = -np.inf
    order = np.argsort(right_ids, kind="stable")
    ranked = rounded[:, order]
    k = min(k, ranked.shape[1])
    rows, cols = [], []
    if k == 0:
        return np.array([], dtype=int), np.array([], dtype=int)
    kth = -np.partition(-ranked, k - 1, axis=1)[:, k - 1]
    for i in range(ranked.shape[0]):
        cand = np.flatnonzero((ranked[i] >= kth[i]) & (ranked[i] > -np.inf))
        cand = cand[np.argsort(-ranked[i, cand], kind="stable")][:k]
        rows.append(np.full(len(cand), i))
        cols.append(order[cand])
    return np.concatenate(rows), np.concatenate(cols)


def _nearest(left, right, left_ids: np.ndarray, right_ids: np.ndarray, k: int, floor: float | None, others: bool, step: int):
    """Row numbers, column numbers and cosines of the k best right rows of each left row; with ``others`` of another id.

    Vectors of one length are multiplied in single precision, ``step`` by ``TILE`` rows at a time; pairs that come within
    its error of a row's k-th best so far are made again in double. Rows for which these are many, like those
    of a large group of copies, are made in double as a whole.
    """
    lefts, rights = _by_dim(left), _by_dim(right)
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    if len(lefts) != 1 or len(rights) != 1 or len(lefts[0][0]) < len(left) or len(rights[0][0]) < len(right) or lefts[0][1].shape[1] != rights[0][1].shape[1]:
        left = left.combine_chunks() if isinstance(left, pa.ChunkedArray) else left
        for lo in range(0, len(left), step):  # pairs of unlike lengths are 0
            sims = similarity(left.slice(lo, step), right)
            skip = (left_ids[lo : lo + step, None] == right_ids[None, :]) if others else None
            r, c = best_per_row(sims, right_ids, k, skip, floor)
            found.append((r + lo, c, sims[r, c]))
        return tuple(np.concatenate(x) for x in zip(*found))
    u, v = lefts[0][1], rights[0][1]
    slack = _slack(u.shape[1])
    # columns in order of id, so of equal ones the first; rows that aren't numbers are near to none
    order = np.argsort(right_ids, kind="stable")
    order = order[np.isfinite(v[order]).all(axis=1)]
    v, v_ids = v[order], right_ids[order]
    rows_of = np.flatnonzero(np.isfinite(u).all(axis=1))
    u4, v4 = u.astype(np.float32), v.astype(np.float32)
    for lo in range(0, len(rows_of) if k > 0 else 0, step):
        rows = rows_of[lo : lo + step]
        bound = np.full(len(rows), -np.inf if floor is None else floor - slack)
        row, col, sim = np.empty(0, int), np.empty(0, int), np.empty(0)
        for at in range(0, len(v), TILE):
            part = u4[rows] @ v4[at : at + TILE].T
            over = part >= bound[:, None]
            if np.count_nonzero(over) > 4 * (k + 1) * len(rows) and part.shape[1] > k + 1:  # one may be the row itself
                kth = -np.partition(-part, k, axis=1)[:, k]
                bound = np.maximum(bound, kth - 2 * slack)
                over = part >= bound[:, None]
            many = np.flatnonzero(over.sum(axis=1) > max(64, 8 * k))
            for i in range(0, len(many), 256):
                some = many[i : i + 256]
                sims = u[rows[some]] @ v[at : at + TILE].T
                skip = (left_ids[rows[some], None] == v_ids[None, at : at + TILE]) if others else None
                r, c = best_per_row(sims, np.arange(sims.shape[1]), k, skip, floor)
                row, col, sim = np.append(row, some[r]), np.append(col, c + at), np.append(sim, sims[r, c])
            over[many] = False
            r, c = np.nonzero(over)
            if others:
                away = left_ids[rows[r]] != v_ids[at + c]
                r, c = r[away], c[away]
            sims = np.einsum("ij,ij->i", u[rows[r]], v[at + c])
            if floor is not None:
                r, c, sims = (x[sims >= floor] for x in (r, c, sims))
            row, col, sim = np.append(row, r), np.append(col, c + at), np.append(sim, sims)
            best = np.lexsort((col, -np.round(sim, 9), row))
            row, col, sim = row[best], col[best], sim[best]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col, sim = row[keep], col[keep], sim[keep]
            full = np.flatnonzero(np.bincount(row, minlength=len(rows)) >= k)
            last = np.searchsorted(row, full, side="right") - 1
            bound[full] = np.maximum(bound[full], np.round(sim[last], 9) - slack)
        found.append((rows[row], order[col], sim))
    return tuple(np.concatenate(x) for x in zip(*found))


def block_topk(
    left: DataFrame,
    right: DataFrame,
    k: int,
    keys: Sequence[str] = (),
    min_sim: float | None = None,
    exclude_self: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The k most similar right rows of each left row, within equal ``keys``: exact.

    left: (*keys, left_id, left_vec), right: (*keys, right_id, right_vec). Both sides are cut into
    blocks, however many rows a key holds; a task multiplies one pair of blocks, ``block_rows`` left rows at a
    time, and passes on at most k rows per left row, so pairs are never shuffled. With keys a block has about
    ``block_rows`` rows, without as many as ``travelling_blocks`` says.
    """
    keys = list(keys)
    if keys:
        nl = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_nl"))
        nr = right.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_nr"))
        grid = nl.join(nr, keys)
        lhs, rhs = left.join(grid, keys), right.join(grid, keys)
    else:
        cores = left.sparkSession.sparkContext.defaultParallelism
        n_left, n_right = (travelling_blocks(side.count(), block_rows, cores) for side in (left, right))
        lhs = left.withColumns({"_nl": F.lit(n_left), "_nr": F.lit(n_right)})
        rhs = right.withColumns({"_nl": F.lit(n_left), "_nr": F.lit(n_right)})
    lhs = lhs.select(
        *keys,
        F.pmod(F.xxhash64("left_id"), F.col("_nl")).cast("int").alias("_lb"),
        F.explode(F.sequence(F.lit(0), F.col("_nr") - 1)).alias("_rb"),
        F.lit(0).alias("_side"),
        F.col("left_id").alias("_id"),
        F.col("left_vec").alias("_vec"),
    )
    rhs = rhs.select(
        *keys,
        F.explode(F.sequence(F.lit(0), F.col("_nl") - 1)).alias("_lb"),
        F.pmod(F.xxhash64("right_id"), F.col("_nr")).cast("int").alias("_rb"),
        F.lit(1).alias("_side"),
        F.col("right_id").alias("_id"),
        F.col("right_vec").alias("_vec"),
    )
    id_type = left.schema["left_id"].dataType
    schema = T.StructType(
        [
            T.StructField("left_id", id_type),
            T.StructField("right_id", id_type),
            T.StructField("sim", T.DoubleType()),
        ]
    )

    def multiply(table: pa.Table) -> pa.Table:
        side = table["_side"].to_numpy()
        lt, rt = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        lids, rids = lt["_id"].to_pandas().to_numpy(), rt["_id"].to_pandas().to_numpy()
        r, c, sims = _nearest(lt["_vec"], rt["_vec"], lids, rids, k, min_sim, exclude_self, min(block_rows, BLOCK_ROWS))
        kind = table.schema.field("_id").type
        return pa.table({"left_id": pa.array(lids[r], kind), "right_id": pa.array(rids[c], kind), "sim": pa.array(sims, pa.float64())})

    found = lhs.unionByName(rhs).groupBy(*keys, "_lb", "_rb").applyInArrow(multiply, schema)
    if keys:
        found = found.groupBy("left_id", "right_id").agg(F.max("sim").alias("sim"))
    return top_k(found, ["left_id"], [F.round("sim", 9).desc(), F.col("right_id").asc()], k)


def vector_search(queries: DataFrame, chunks: DataFrame, k: int = 10, small_left: int = SMALL_LEFT) -> DataFrame:
    """Exact k nearest chunks by cosine: (query_id, chunk_id, score, rank).

    A query table of at most ``small_left`` rows goes to every task as one matrix and the chunk table
    is read in place, no shuffle; a larger one uses the blocked product.
    """
    q = queries.filter(F.size("vec") > 0).select("query_id", "vec")
    c = chunks.filter(F.size("vec") > 0).select("chunk_id", "vec")
    if not has_at_most(q, small_left):
        # ids of both sides travel in one column, as text
        left = q.select(F.col("query_id").cast("string").alias("left_id"), F.col("vec").alias("left_vec"))
        right = c.select(F.col("chunk_id").cast("string").alias("right_id"), F.col("vec").alias("right_vec"))
        return block_topk(left, right, k).select(
            F.col("left_id").cast(queries.schema["query_id"].dataType).alias("query_id"),
            F.col("right_id").alias("chunk_id"),
            F.col("sim").alias("score"),
            "rank",
        )
    local = q.toArrow()  # at most `small_left` rows, checked above
    qids, qvecs = local["query_id"].to_pylist(), local["vec"].combine_chunks()
    qtype = local.schema.field("query_id").type
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("chunk_id", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_q = np.array([], dtype=int)
        keep_id = np.array([], dtype=object)
        keep_s = np.array([], dtype=float)
        for batch in batches:
            ids = batch.column("chunk_id").to_pandas().to_numpy()
            sims = similarity(qvecs, batch.column("vec"))
            r, c_ = best_per_row(sims, ids, k, None, None)
            q_all = np.concatenate([keep_q, r])
            id_all = np.concatenate([keep_id, ids[c_]])
            s_all = np.concatenate([keep_s, sims[r, c_]])
            order = np.lexsort((id_all.astype(str), -np.round(s_all, 9), q_all))
            q_all, id_all, s_all = q_all[order], id_all[order], s_all[order]
            first = np.r_[True, q_all[1:] != q_all[:-1]] if len(q_all) else np.array([], dtype=bool)
            start = np.maximum.accumulate(np.where(first, np.arange(len(q_all)), 0)) if len(q_all) else q_all
            mine = np.arange(len(q_all)) - start < k
            keep_q, keep_id, keep_s = q_all[mine], id_all[mine], s_all[mine]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([qids[i] for i in keep_q], qtype),
                pa.array(keep_id, pa.string()),
                pa.array(keep_s, pa.float64()),
            ],
            names=["query_id", "chunk_id", "score"],
        )

    found = c.mapInArrow(scan, schema)
    return top_k(found, ["query_id"], [F.round("score", 9).desc(), F.col("chunk_id").asc()], k)


def all_similarities(queries: DataFrame, chunks: DataFrame, small_left: int = SMALL_LEFT) -> DataFrame:
    """(query_id, chunk_id, score) of every query with a vector and every embedded chunk, in no order.

    At most ``small_left`` queries go to every task as one matrix; more are met in blocks.
    """
    q = queries.filter(F.size("vec") > 0).select("query_id", "vec")
    c = chunks.filter(F.size("vec") > 0).select("chunk_id", "vec")
    if not has_at_most(q, small_left):
        return vector_search(queries, chunks, max(1, c.count()), small_left).drop("rank")
    local = q.toArrow()  # at most `small_left` rows, checked above
    names, qvecs = local["query_id"].combine_chunks(), local["vec"].combine_chunks()
    schema = T.StructType([queries.schema["query_id"], T.StructField("chunk_id", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows if len(names) else 0, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                sims = similarity(qvecs, part.column("vec"))
                row, col = (x.reshape(-1) for x in np.indices(sims.shape))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), part.column("chunk_id").take(pa.array(col)), pa.array(sims.reshape(-1))], names=["query_id", "chunk_id", "score"])

    return c.mapInArrow(run, schema)


def _bands(vec, tables: int, bits: int, seed: int):
    """Bucket number per table: the signs of ``bits`` seeded random projections."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def band(col: pa.Array) -> pa.Array:
        out: list = [None] * len(col)
        for rows, m in _by_dim(col):
            d = m.shape[1]
            planes = np.random.default_rng([seed, d]).standard_normal((tables * bits, d))
            signs = (m @ planes.T >= 0).reshape(-1, tables, bits)
            codes = signs @ (1 << np.arange(bits, dtype=np.int64))
            for i, r in enumerate(rows):
                out[r] = codes[i].tolist()
        return pa.array(out, pa.list_(pa.int64()))

    return band(vec)


def vector_search_ann(
    queries: DataFrame, chunks: DataFrame, k: int = 10, tables: int = 12, bits: int = 6, seed: int = 7
) -> DataFrame:
    """Approximate variant: candidates share a sign-projection bucket in some table, scores are exact.

    A crowded bucket (near copies) is cut into blocks by ``block_topk``; none of its rows is dropped.
    """

    def banded(df: DataFrame, id_col: str, side: str) -> DataFrame:
        return df.filter(F.size("vec") > 0).select(
            F.col(id_col).cast("string").alias(f"{side}_id"),
            F.col("vec").alias(f"{side}_vec"),
            F.posexplode(_bands(F.col("vec"), tables, bits, seed)).alias("band", "bucket"),
        )

    found = block_topk(
        banded(queries, "query_id", "left"), banded(chunks, "chunk_id", "right"), k, keys=["band", "bucket"]
    )
    return found.select(
        F.col("left_id").cast(queries.schema["query_id"].dataType).alias("query_id"),
        F.col("right_id").alias("chunk_id"),
        F.col("sim").alias("score"),
        "rank",
    )


def rank_regions(queries: DataFrame, regions: DataFrame, k: int = 10, positive_only: bool = False) -> DataFrame:
    """Regions by cosine of the query vector against the digest vector: (query_id, region_id, score, rank)."""
    found = vector_search(
        queries, regions.select(F.col("region_id").alias("chunk_id"), F.col("digest_vec").alias("vec")), k
    ).withColumnRenamed("chunk_id", "region_id")
    return found.filter(F.col("score") > 0) if positive_only else found
