"""Size-bounded regions by bisecting spherical 2-means, and per-query sub-themes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions.wordlists import PAGE_SIZES, THEME_NAMES
from spanlake.operators.vectors import BLOCK_ROWS, lowest_pair, travelling_blocks
from spanlake.runtime import cut, stored

LOCAL_ROWS = 4096  # a cluster of at most this many rows is split to the end inside one task


@dataclass(frozen=True)
class ClusterParams:
    max_region_size: int = 15
    min_region_size: int = 4
    max_regions: int = 400
    max_iters: int = 25
    local_rows: int = LOCAL_ROWS
    seeds: str = "exact"  # "two_hop" trades the exact farthest pair of very large clusters for two scans


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=-1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _matrix(col) -> np.ndarray:
    return _unit(np.stack([np.asarray(v, dtype=np.float64) for v in col]))


def _raw(col) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in col])


def _rows_of(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column as rows, without a Python object for each number."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = pc.list_value_length(col)
    if len(col) == 0 or sizes.null_count or len(pc.unique(sizes)) > 1:
        return _raw(col.to_pylist())
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)


def _added(m: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of each group; every group has a row."""
    order = np.argsort(group, kind="stable")
    return np.add.reduceat(m[order], np.searchsorted(group[order], np.arange(n)), axis=0)


# ---- sums per cluster ----------------------------------------------------------------------------


def vector_sums(df: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, n, sum array<double>): tasks add up their own rows per key before anything is shuffled."""
    kind = df.schema[key].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[Any, list] = {}

        def flush():
            return pa.RecordBatch.from_pydict(
                {
                    key: pa.array(list(acc), in_type),
                    "n": pa.array([a[0] for a in acc.values()], pa.int64()),
                    "sum": pa.array([a[1].tolist() for a in acc.values()], pa.list_(pa.float64())),
                }
            )

        in_type = None
        for b in batches:
            in_type = b.schema.field(key).type
            keys = b.column(key).to_pandas().to_numpy()
            if len(keys) == 0:
                continue
            m = _rows_of(b.column(vec))
            uniq, inv = np.unique(keys, return_inverse=True)
            sums = _added(m, inv, len(uniq))
            for k, n, s in zip(uniq, np.bincount(inv), sums):
                if k in acc:
                    acc[k][0] += int(n)
                    acc[k][1] = acc[k][1] + s
                else:
                    acc[k] = [int(n), s]
            if len(acc) > 20000:
                yield flush()
                acc.clear()
        if acc:
            yield flush()

    parts = df.select(key, vec).mapInArrow(partial, f"{key} {kind}, n long, sum array<double>")
    dims = parts.select(key, "n", F.posexplode("sum").alias("dim", "x"))
    per_dim = dims.groupBy(key, "dim").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    # one row per dimension of a vector
    return per_dim.groupBy(key).agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("sum"),
    )


def centroids(df: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """(key, centroid unit array<double>, n)."""
    norm = F.sqrt(F.aggregate("sum", F.lit(0.0), lambda s, x: s + x * x))
    return vector_sums(df, key, vec).select(
        key, F.when(norm > 0, F.transform("sum", lambda x: x / norm)).otherwise(F.col("sum")).alias("centroid"), "n"
    )


def with_distance(members: DataFrame, cents: DataFrame, key: str) -> DataFrame:
    """members plus distance = 1 - cosine to their centroid."""
    from spanlake.functions.vectors import cosine

    return members.join(cents.select(key, "centroid"), key).withColumn(
        "distance", F.lit(1.0) - cosine("vec", "centroid")
    ).drop("centroid")


# ---- splitting -----------------------------------------------------------------------------------


def farthest_pair(u: np.ndarray) -> tuple[int, int]:
    """Rows (i < j) of lowest cosine; equal pairs go to the smallest row numbers."""
    best = (np.inf, 0, 0)
    for lo in range(0, len(u) - 1, 1024):
        sims = np.round(u[lo : lo + 1024] @ u.T, 9)
        rows = np.arange(lo, lo + len(sims))
        sims[np.arange(len(u))[None, :] <= rows[:, None]] = np.inf
        at = int(np.argmin(sims))
        i, j = divmod(at, len(u))
        if sims[i, j] < best[0]:
            best = (float(sims[i, j]), lo + i, j)
    return best[1], best[2]


def two_means(u: np.ndarray, raw: np.ndarray, max_iters: int) -> np.ndarray:
    """Right-side mask of spherical 2-means seeded with the farthest pair; rows are in id order."""
    a, b = farthest_pair(u)
    c0, c1 = u[a], u[b]
    right = np.zeros(len(u), dtype=bool)
    for _ in range(max_iters):
        right = np.round(u @ c0, 12) < np.round(u @ c1, 12)
        if right.all() or not right.any():
            break
        n0, n1 = _unit(raw[~right].sum(axis=0)), _unit(raw[right].sum(axis=0))
        if np.abs(n0 - c0).max() <= 1e-6 and np.abs(n1 - c1).max() <= 1e-6:
            break
        c0, c1 = n0, n1
    return right


def bisect(df: DataFrame, key: str, max_iters: int = 25, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, chunk_id, side): one split of every cluster, however large.

    Farthest pairs come from products of block pairs, assignment and centroids from scans; two centroids
    per cluster reach the driver. A cluster of one row is all left.
    """
    kind = df.schema[key].dataType
    node = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n"))
    rows = cut(df.select("chunk_id", "vec", node.alias("node")))
    sizes = {r["node"]: r["count"] for r in rows.groupBy("node").count().collect()}
    large = {k: n for k, n in sizes.items() if n > 1}
    split = rows.filter(F.col("node").isin(list(large)))
    halves = _bisect_large(split, large, ClusterParams(max_iters=max_iters), block_rows) if large else split
    alone = rows.filter(~F.col("node").isin(list(large))).withColumn("node", F.concat("node", F.lit("0")))
    of = F.when(F.col("node").startswith("k"), F.expr("substring(node, 2, length(node) - 2)")).cast(kind)
    return halves.unionByName(alone).select(of.alias(key), "chunk_id", F.expr("right(node, 1)").cast("int").alias("side"))


def _split_to_end(df: DataFrame, p: ClusterParams) -> DataFrame:
    """Append the path of every split below each (bounded) cluster until no part is over size."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk_id").reset_index(drop=True)
        raw = _raw(pdf["vec"])
        u = _unit(raw)
        path = np.array(pdf["node"], dtype=object)
        todo = [np.arange(len(pdf))]
        while todo:
            rows = todo.pop()
            if len(rows) <= p.max_region_size:
                continue
            right = two_means(u[rows], raw[rows], p.max_iters)
            if right.all() or not right.any():
                path[rows] = path[rows] + "x"  # cannot be split
                continue
            path[rows[~right]] = path[rows[~right]] + "0"
            path[rows[right]] = path[rows[right]] + "1"
            todo += [rows[~right], rows[right]]
        return pdf.assign(node=path)

    return df.groupBy("node").applyInPandas(run, df.schema)


def _seeds_exact(big: DataFrame, blocks: dict[str, int]) -> DataFrame:
    """(node, a, b, va, vb): farthest pair per large cluster with its unit vectors, from products of block pairs;
    a task returns one row."""
    count = big.sparkSession.createDataFrame(list(blocks.items()), "node string, nb int")  # at most max_regions rows
    rows = big.join(F.broadcast(count), "node").withColumn("blk", F.pmod(F.xxhash64("chunk_id"), F.col("nb")).cast("int"))
    seq = F.sequence(F.lit(0), F.col("nb") - 1)
    grid = rows.withColumn("other", F.explode(seq)).select(
        "node", "chunk_id", "vec", "blk", F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj")
    )

    def lowest(table: pa.Table) -> pa.Table:
        ids = table["chunk_id"].to_pandas().to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, u, blk = ids[order], _unit(_rows_of(table["vec"]))[order], table["blk"].to_numpy()[order]
        first, last = table["bi"][0].as_py(), table["bj"][0].as_py()
        at = [np.flatnonzero(blk == first), np.flatnonzero(blk == last)]
        found = [lowest_pair(u[at[0]], u[at[1]], at[0], at[1], first == last)]
        found = [f for f in found if np.isfinite(f[0])]
        return pa.table(
            [
                pa.array([table["node"][0].as_py() for _ in found], pa.string()), pa.array([f[0] for f in found], pa.float64()),
                *(pa.array([ids[f[i]] for f in found], pa.string()) for i in (1, 2)),
                *(pa.array([u[f[i]].tolist() for f in found], pa.list_(pa.float64())) for i in (1, 2)),
            ],
            names=["node", "sim", "a", "b", "va", "vb"],
        )

    schema = "node string, sim double, a string, b string, va array<double>, vb array<double>"
    found = grid.groupBy("node", "bi", "bj").applyInArrow(lowest, schema)
    return found.groupBy("node").agg(F.min(F.struct("sim", "a", "b", "va", "vb")).alias("m")).select("node", "m.a", "m.b", "m.va", "m.vb")


def _fetch(df: DataFrame, ids: dict[str, str]) -> dict[str, np.ndarray]:
    """Unit vectors of one id per cluster (bounded by max_regions)."""
    if not ids:
        return {}
    m = F.create_map(*[x for k, v in ids.items() for x in (F.lit(k), F.lit(v))])
    rows = df.filter(F.col("chunk_id") == m[F.col("node")]).select("node", "vec").collect()
    return {r["node"]: _unit(np.asarray(r["vec"], dtype=np.float64)) for r in rows}


def _farthest_from(df: DataFrame, cents: dict[str, np.ndarray]) -> dict[str, str]:
    """Id of the row least similar to each cluster's reference vector, two-level."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                ref = np.stack([cents[x] for x in pdf["node"]])
                sim = np.round(np.einsum("ij,ij->i", _matrix(pdf["vec"]), ref), 9)
                yield pdf.assign(sim=sim)[["node", "chunk_id", "sim"]]

    got = df.select("node", "chunk_id", "vec").mapInPandas(scan, "node string, chunk_id string, sim double")
    rows = got.groupBy("node").agg(F.min(F.struct("sim", "chunk_id")).alias("m")).collect()
    return {r["node"]: r["m"]["chunk_id"] for r in rows}


Centroids = dict[str, tuple[np.ndarray, np.ndarray]]


def _sided(batch: pa.RecordBatch, cents: Centroids) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Clusters of a batch, and per row the number of its cluster, its vector and whether it goes right."""
    coded = batch.column("node").dictionary_encode()
    names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    raw = _rows_of(batch.column("vec"))
    u = _unit(raw)
    c0, c1 = (np.stack([cents[x][i] for x in names])[code] for i in (0, 1))
    right = np.round(np.einsum("ij,ij->i", u, c0), 12) < np.round(np.einsum("ij,ij->i", u, c1), 12)
    return names, code, raw, right


def _with_side(df: DataFrame, cents: Centroids) -> DataFrame:
    """``df`` with the side of every row appended to its cluster's path."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names, code, _, right = _sided(batch, cents)
                path = np.array([x + side for x in names for side in "01"], dtype=object)[code * 2 + right]
                at = batch.schema.get_field_index("node")
                yield batch.set_column(at, batch.schema.field(at), pa.array(path, pa.string()))

    return df.mapInArrow(assign, df.schema)


def _side_sums(df: DataFrame, cents: Centroids) -> dict[str, np.ndarray]:
    """Sum of the vectors of each side that has rows. Tasks add up their rows, a task has few clusters when
    ``df`` is ordered by them, and the driver adds up what tasks found: two rows per cluster and task."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                names, code, raw, right = _sided(batch, cents)
                sides, inv = np.unique(code * 2 + right, return_inverse=True)
                for side, s in zip(sides, _added(raw, inv, len(sides))):
                    path = names[side // 2] + "01"[side % 2]
                    acc[path] = acc[path] + s if path in acc else s
        yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.string()), pa.array([x.tolist() for x in acc.values()], pa.list_(pa.float64()))], names=["path", "sum"])

    out: dict[str, np.ndarray] = {}
    for r in df.select("node", "vec").mapInArrow(partial, "path string, sum array<double>").collect():
        out[r["path"]] = out.get(r["path"], 0) + np.asarray(r["sum"])
    return out


def _bisect_large(big: DataFrame, sizes: dict[str, int], p: ClusterParams, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One split of every large cluster at once; only centroids (two per cluster) reach the driver."""
    if p.seeds == "two_hop":
        first = {r["node"]: r["c"] for r in big.groupBy("node").agg(F.min("chunk_id").alias("c")).collect()}
        a_ids = _farthest_from(big, _fetch(big, first))
        a, b = _fetch(big, a_ids), _fetch(big, _farthest_from(big, _fetch(big, a_ids)))
    else:
        cores = big.sparkSession.sparkContext.defaultParallelism
        blocks = {k: travelling_blocks(n, block_rows, -(-cores // len(sizes))) for k, n in sizes.items()}
        rows = _seeds_exact(big, blocks).collect()
        a, b = ({r["node"]: np.asarray(r[v]) for r in rows} for v in ("va", "vb"))
    cents = {k: (a[k], b[k]) for k in sizes}
    moving = set(sizes)
    for _ in range(p.max_iters - 1):
        sums = _side_sums(big.filter(F.col("node").isin(sorted(moving))), {k: cents[k] for k in moving})
        for k in sorted(moving):
            if k + "0" not in sums or k + "1" not in sums:
                moving.discard(k)
                continue
            n0, n1 = _unit(sums[k + "0"]), _unit(sums[k + "1"])
            if np.abs(n0 - cents[k][0]).max() <= 1e-6 and np.abs(n1 - cents[k][1]).max() <= 1e-6:
                moving.discard(k)
            else:
                cents[k] = (n0, n1)
        if not moving:
            break
    return _with_side(big, cents)


@dataclass
class _Tree:
    """Split tree: sizes and smallest ids of the parts. Its size follows max_regions, not the data."""

    size: dict[str, int] = field(default_factory=dict)
    low: dict[str, str] = field(default_factory=dict)
    stuck: set[str] = field(default_factory=set)

    def learn(self, rows) -> None:
        for r in rows:
            node = r["node"].rstrip("x")
            if r["node"].endswith("x"):
                self.stuck.add(node)
            while True:
                prev = self.low.get(node)
                self.size[node] = self.size.get(node, 0) + r["n"]
                self.low[node] = r["lo"] if prev is None or r["lo"] < prev else prev
                if node == "":
                    break
                node = node[:-1]

    def replay(self, p: ClusterParams) -> tuple[set[str], list[str]]:
        """Leaves after splitting largest first, and the leaves whose split is still unknown."""
        leaves, unknown = {""}, []
        while len(leaves) < p.max_regions:
            over = [x for x in leaves if self.size[x] > p.max_region_size and x not in self.stuck]
            if not over:
                break
            pick = min(over, key=lambda x: (-self.size[x], self.low[x]))
            if pick + "0" not in self.size:
                budget = p.max_regions - len(leaves)
                ranked = sorted(over, key=lambda x: (-self.size[x], self.low[x]))[:budget]
                unknown = [x for x in ranked if x + "0" not in self.size]
                break
            leaves.remove(pick)
            leaves |= {pick + "0", pick + "1"}
        return leaves, unknown


def _parts(rows: DataFrame) -> DataFrame:
    """Written ordered by part, so that a task reads few parts and a part's rows are found without the others."""
    return stored(rows.repartitionByRange("node", "chunk_id").sortWithinPartitions("node"), "parts")


def cluster_chunks(chunks: DataFrame, params: ClusterParams | None = None) -> tuple[DataFrame, DataFrame]:
    """Regions (region_id, centroid, chunk_count) and members (region_id, chunk_id, distance).

    Splits the largest part over ``max_region_size`` until none is left or ``max_regions`` is
    reached, then merges parts below ``min_region_size``. A split depends only on its own rows, so
    all parts that may be split next are split in one pass; "largest first" is then replayed on the
    sizes. Small parts finish inside one task, larger ones are split by distributed scans.
    """
    p = params or ClusterParams()
    rows = _parts(chunks.filter(F.size("vec") > 0).select("chunk_id", "vec", F.lit("").alias("node")))

    def stats(df: DataFrame):
        return df.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("lo")).collect()

    tree = _Tree()
    tree.learn(stats(rows))
    if not tree.size:
        empty = rows.select(F.lit("").alias("region_id"), F.lit(None).cast("array<double>").alias("centroid"), F.lit(0).cast("long").alias("chunk_count"))
        return empty, rows.select(F.lit("").alias("region_id"), "chunk_id", F.lit(0.0).alias("distance"))
    while True:
        leaves, unknown = tree.replay(p)
        if not unknown:
            break
        large = {x: tree.size[x] for x in unknown if tree.size[x] > p.local_rows}
        small = [x for x in unknown if x not in large]
        done = rows.filter(~F.col("node").isin(unknown))
        if small:
            done = done.unionByName(_split_to_end(rows.filter(F.col("node").isin(small)), p))
        if large:
            done = done.unionByName(_bisect_large(rows.filter(F.col("node").isin(list(large))), large, p))
        rows = _parts(done)
        seen = stats(rows)
        tree = _Tree()
        tree.learn(seen)
        for x in large:  # an empty side: the part cannot be split
            if x + "0" not in tree.size or x + "1" not in tree.size:
                tree.stuck.add(x)
                for child in (x + "0", x + "1"):
                    tree.size.pop(child, None)
        if any(x in tree.stuck for x in large):
            bad = [x for x in large if x in tree.stuck]
            fix = F.col("node")
            for x in bad:
                fix = F.when(F.col("node").isin(x + "0", x + "1"), F.lit(x + "x")).otherwise(fix)
            rows = _parts(rows.withColumn("node", fix))
    # map every row to its kept ancestor; at most max_regions of them
    kept = sorted(leaves)
    leaf = F.coalesce(*[F.when(F.col("node").startswith(x), F.lit(x)) for x in kept])
    assigned = rows.withColumn("leaf", leaf)
    final = merge_undersized(assigned, "leaf", p.min_region_size)
    return _finish(final)


def merge_undersized(assigned: DataFrame, key: str, min_size: int) -> DataFrame:
    """(chunk_id, vec, part): the smallest part below ``min_size`` joins the nearest centroid, repeatedly.

    Works on one (sum, count, smallest id) per part, at most max_regions of them.
    """
    low = {r[key]: r["lo"] for r in assigned.groupBy(key).agg(F.min("chunk_id").alias("lo")).collect()}
    parts = {
        r[key]: [np.asarray(r["sum"]), r["n"], low[r[key]]] for r in vector_sums(assigned, key).collect()
    }
    target = {k: k for k in parts}
    while len(parts) > 1:
        under = [k for k, v in parts.items() if v[1] < min_size]
        if not under:
            break
        s = min(under, key=lambda k: (parts[k][1], parts[k][2]))
        total, n, lo = parts.pop(s)
        c = _unit(total)
        best = min(parts, key=lambda k: (-round(float(c @ _unit(parts[k][0])), 9), parts[k][2]))
        parts[best] = [parts[best][0] + total, parts[best][1] + n, min(parts[best][2], lo)]
        target = {k: (best if v == s else v) for k, v in target.items()}
    m = F.create_map(*[x for k, v in sorted(target.items()) for x in (F.lit(k), F.lit(v))])
    return assigned.select("chunk_id", "vec", m[F.col(key)].alias("part"))


def _finish(final: DataFrame) -> tuple[DataFrame, DataFrame]:
    final = cut(final)
    cents = centroids(final, "part")
    mem = cut(with_distance(final, cents, "part"))
    head = mem.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(F.round("distance", 9).alias("d"), "chunk_id")).alias("nearest"),
    )
    # at most max_regions rows are ranked here
    from pyspark.sql import Window

    w = Window.orderBy(F.col("n").desc(), F.col("nearest.chunk_id"))
    named = head.select("part", F.concat(F.lit("region-"), F.lpad(F.row_number().over(w).cast("string"), 5, "0")).alias("region_id"))
    regions = cents.join(named, "part").select("region_id", "centroid", F.col("n").alias("chunk_count"))
    members = mem.join(named, "part").select("region_id", "chunk_id", "distance")
    return cut(regions), members


# ---- query-time grouping -------------------------------------------------------------------------


def cluster_per_query(hits: DataFrame, max_clusters: int = 4, min_similarity: float = 0.3) -> DataFrame:
    """Greedy sub-themes of each query's page of hits in rank order:
    (query_id, cluster, label, chunk_id, confidence).

    hits: (query_id, title, chunk_id, rank, score, vec), a page per query; a rank beyond the largest page is an
    error, so a query's rows fit in one task.
    """
    most = PAGE_SIZES[-1]
    beyond = F.raise_error(F.lit(f"a page has at most {most} hits"))
    hits = hits.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")).otherwise(beyond.cast("int")))

    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        cents: list[np.ndarray] = []
        counts: list[int] = []
        pick = []
        for v in pdf["vec"]:
            v = np.asarray(v, dtype=np.float64)
            sims = [float(_unit(v) @ _unit(c)) for c in cents]
            best = int(np.argmax(sims)) if sims else -1
            if best < 0 or (sims[best] < min_similarity and len(cents) < max_clusters):
                cents.append(v)
                counts.append(1)
                pick.append(len(cents) - 1)
            else:
                cents[best] = (cents[best] * counts[best] + v) / (counts[best] + 1)
                counts[best] += 1
                pick.append(best)
        out = pd.DataFrame({"query_id": key[0], "cluster": np.array(pick, dtype="int32"), "chunk_id": pdf["chunk_id"].to_numpy(), "score": pdf["score"].to_numpy()})
        # a single hit keeps its own score as confidence
        conf = out.groupby("cluster")["score"].transform("mean")
        out["confidence"] = conf if len(out) == 1 else conf.clip(upper=1.0)
        title = pdf["title"].iloc[0]
        out["label"] = [
            f"{title} — {THEME_NAMES[c]}" if c < len(THEME_NAMES) else f"{title} — theme {c + 1}" for c in out["cluster"]
        ]
        return out[["query_id", "cluster", "label", "chunk_id", "confidence"]]

    kind = hits.schema["query_id"].dataType.simpleString()
    return hits.groupBy("query_id").applyInPandas(
        run, f"query_id {kind}, cluster int, label string, chunk_id string, confidence double"
    )


def query_themes(queries: DataFrame, hits: DataFrame, vectors: DataFrame, clusterer: Callable[[DataFrame], DataFrame] = cluster_per_query) -> DataFrame:
    """Sub-themes of each query's page of hits by any ``clusterer``: (query_id, cluster, label, chunk_id, confidence).

    queries: (query_id, text), hits: (query_id, chunk_id, rank, score), vectors: (chunk_id, vec). The clusterer gets
    (query_id, title, chunk_id, rank, score, vec); hits without a vector are in no theme.
    """
    rows = hits.select("query_id", "chunk_id", "rank", "score").join(vectors.select("chunk_id", "vec"), "chunk_id")
    return clusterer(rows.join(queries.select("query_id", F.col("text").alias("title")), "query_id"))


def sub_themes_by_region(hits: DataFrame, members: DataFrame, regions: DataFrame) -> DataFrame:
    """(query_id, region_id, label, n, score): a query's hits grouped by the region they fall in."""
    return (
        hits.join(members.select("chunk_id", "region_id"), "chunk_id")
        .groupBy("query_id", "region_id")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("score"))
        .join(regions.select("region_id", F.col("title").alias("label")), "region_id")
        .select("query_id", "region_id", "label", "n", "score")
    )
