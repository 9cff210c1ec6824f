"""Exact maximum inner product search in score windows, over cover trees of norm-augmented vectors.

A candidate x gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, a query q a zero.
Then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so a ball around a centre bounds the inner products inside it.

Index: the first level are pivots, taken farthest first from a bounded sample; every row goes to its
nearest pivot, whose covering radius Spark measures over all rows. Below a pivot rows fall into blocks of
bounded size (a crowded pivot, such as one vector with many copies, has many), and each block is a cover
tree of its own, built in one task: a node's children are centres taken farthest first until they
cover it within its radius over ``BASE``, or until ``FANOUT``; each keeps the radius that it really covers.

Search: anchors go to the pivots whose balls reach their window, then down the trees of those pivots. On each
level all pairs of anchor and node outside the window are dropped; the leaves that are left are read best
first, in rounds of one, two, four and so on, and an anchor stops at a leaf that can't better its worst hit. Scores are integers.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.scratch import stored
from spanlake.llm.vectors import integer_rows, packed, unpacked

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: a negative's score is at least this percentage of the positive's
LEAST_PERCENT = 80
#: rows of a block, rows of a leaf, children of a node, and how much smaller a child's radius should be
BLOCK, LEAF, FANOUT, BASE = 1024, 48, 16, 1.3
#: sample that pivots are taken from, and the most pivots; both bound what the driver holds
SAMPLE, PIVOTS = 8192, 512
#: anchors that meet a block at a time
SHARE = 4096
#: integers are held to this size, so that scores of up to 2,000 dimensions fit a long
LIMIT = 1 << 26
_MANY = np.iinfo(np.int64).max
NO_LABEL = -(1 << 62)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of rows: by doubles where their sums are exact, else by integers."""
    top = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, x.shape[1])
    if top < 1 << 53:
        return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
    return q @ x.T


def augmented(x: np.ndarray, square: float) -> np.ndarray:
    """Rows with the coordinate that gives all of them the norm sqrt(square)."""
    x = x.astype(float)
    return np.column_stack([x, np.sqrt(np.maximum(square - (x * x).sum(axis=1), 0))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def farthest_first(points: np.ndarray, most: int, within: float = 0.0) -> np.ndarray:
    """Positions of centres: the first point, then again and again the point farthest from all of them,
    until every point is ``within`` reach of one or there are ``most``."""
    chosen = [0]
    reach = distances(points, points[:1])[:, 0]
    while len(chosen) < most:
        far = int(reach.argmax())
        if reach[far] <= within or reach[far] == 0:
            break
        chosen.append(far)
        reach = np.minimum(reach, distances(points, points[far : far + 1])[:, 0])
    return np.array(chosen)


def bounds(dist: np.ndarray, radius: np.ndarray, q_square: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest inner product of a query with points ``radius`` around a centre at ``dist``.

    Widened by what rounding can take, so no exact score lies outside.
    """
    slack = 1e-6 * (q_square + square) + 1e-6
    near = np.maximum(dist - radius, 0)
    high = (q_square + square - near * near) / 2 + slack
    low = (q_square + square - (dist + radius) ** 2) / 2 - slack
    return low, high


def _with(df: DataFrame, more: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(more).fields])


class Tree:
    """Cover tree of one block in flat arrays; rows of a leaf lie next to each other."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, square: float):
        points = augmented(x, square)
        order: list[np.ndarray] = []
        nodes: list[list] = []  # centre, radius, first child, end of children, first row, end of rows, only label
        todo = [(-1, np.arange(len(x)), 0)]
        count = 0
        # level by level, so that children of a node are next to each other
        while todo:
            level = []
            for _, members, centre in todo:
                own = points[members]
                radius = float(distances(own, own[centre : centre + 1]).max())
                only = int(labels[members[0]]) if (labels[members] == labels[members[0]]).all() else NO_LABEL
                at = len(nodes)
                nodes.append([members[centre], radius, 0, 0, 0, 0, only])
                picked = np.empty(0, int)
                if len(members) > LEAF and radius > 0:
                    most = min(FANOUT, -(-len(members) // LEAF))  # no more than fill their leaves
                    picked = farthest_first(np.roll(own, -centre, axis=0), most, radius / BASE)
                    picked = (picked + centre) % len(members)
                if len(picked) < 2:
                    nodes[at][4:6] = [count, count + len(members)]
                    order.append(members)
                    count += len(members)
                    continue
                nearest = distances(own, own[picked]).argmin(axis=1)
                nearest[picked] = np.arange(len(picked))  # a centre stays with itself
                for c in range(len(picked)):
                    mine = np.flatnonzero(nearest == c)
                    level.append((at, members[mine], int(np.searchsorted(mine, picked[c]))))
            base = len(nodes)
            for i, child in enumerate(level):
                node = nodes[child[0]]
                if not node[3]:
                    node[2] = base + i
                node[3] = base + i + 1
            todo = level
        rows = np.concatenate(order)
        self.ids, self.labels, self.x = ids[rows], labels[rows], x[rows]
        where = np.empty(len(rows), np.int64)
        where[rows] = np.arange(len(rows))
        self.centre = where[np.array([n[0] for n in nodes])]
        self.radius = np.array([n[1] for n in nodes])
        self.children = np.array([n[2:4] for n in nodes])
        self.rows = np.array([n[4:6] for n in nodes])
        self.only = np.array([n[6] for n in nodes])
        self.square = square

    _PARTS = ("ids", "labels", "x", "centre", "radius", "children", "rows", "only")

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        x = self.x.astype(np.int32)
        np.savez(out, square=np.array(self.square), **{p: x if p == "x" else getattr(self, p) for p in self._PARTS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as parts:
            for p in cls._PARTS:
                setattr(tree, p, parts[p])
            tree.square = float(parts["square"])
        tree.x = tree.x.astype(np.int64)
        return tree

    def leaves(self, q: np.ndarray, q_square: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, leaf, highest score) of all leaves that can hold a score in a query's window."""
        who, node = np.arange(len(q)), np.zeros(len(q), np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        # the nodes of a block are few, and windows of one query follow each other: one product gives all distances
        new = np.concatenate([[True], (q[1:] != q[:-1]).any(axis=1)]) if len(q) else np.empty(0, bool)
        which = np.cumsum(new) - 1
        far = distances(np.column_stack([q[new].astype(float), np.zeros(int(new.sum()))]), augmented(self.x[self.centre], self.square))
        while len(who):
            below, above = bounds(far[which[who], node], self.radius[node], q_square[who], self.square)
            alone = self.only[node] == label[who]
            keep = (above >= low[who]) & (below <= high[who])
            # a node of one label: the anchor's own is all that counts, or nothing that counts
            keep &= (alone | (self.only[node] == NO_LABEL)) if same else ~alone
            who, node, above = who[keep], node[keep], above[keep]
            first, end = self.children[node].T
            leaf = end == 0
            found.append((who[leaf], node[leaf], above[leaf]))
            who, first, end = who[~leaf], first[~leaf], end[~leaf]
            many = end - first
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            who, node = np.repeat(who, many), np.repeat(first, many) + at
        return tuple(np.concatenate(f) for f in zip(*found)) if found else (np.empty(0, np.int64),) * 3

    def best(self, q_ids: np.ndarray, q: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row id, score) of the ``k`` first rows of each query's window, of its label or of others.

        Higher scores come first, of equal ones the smaller id; a row with the query's id and label is
        the query itself and not its own neighbour.
        """
        q_square = (q.astype(float) ** 2).sum(axis=1)
        who, leaf, above = self.leaves(q, q_square, label, low, high, same)
        order = np.lexsort((leaf, -above, who))
        who, leaf, above = who[order], leaf[order], above[order]
        cursor, end = np.searchsorted(who, np.arange(len(q))), np.searchsorted(who, np.arange(1, len(q) + 1))
        worst = np.full(len(q), -_MANY)  # score of the last of a query's k hits
        hits = tuple(np.empty(0, np.int64) for _ in range(3))
        active, step = np.arange(len(q)), 1
        while True:
            # best first: what is left of a query's leaves reaches no higher than the next one
            active = active[cursor[active] < end[active]]
            active = active[above[cursor[active]] >= worst[active]]
            if not len(active):
                return hits
            many = np.minimum(step, end[active] - cursor[active])
            at = np.repeat(cursor[active], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            cursor[active] += many
            step *= 2
            at = at[above[at] >= worst[who[at]]]
            at = at[np.argsort(leaf[at], kind="stable")]
            cuts = np.flatnonzero(np.diff(leaf[at], prepend=-1, append=-1))
            found = [hits]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                mine, (first, last) = who[at[lo:hi]], self.rows[leaf[at[lo]]]
                score = exact(q[mine], self.x[first:last])
                own = self.labels[None, first:last] == label[mine, None]
                good = (own if same else ~own) & (score >= np.maximum(low, worst)[mine, None]) & (score <= high[mine, None])
                if same:
                    good &= self.ids[None, first:last] != q_ids[mine, None]
                row, col = np.nonzero(good)
                found.append((mine[row], self.ids[first + col], score[row, col]))
            row, ids, score = (np.concatenate(f) for f in zip(*found))
            order = np.lexsort((ids, -score, row))
            row, ids, score = row[order], ids[order], score[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, ids, score = hits = row[keep], ids[keep], score[keep]
            full = np.flatnonzero(np.bincount(row, minlength=len(q)) == k)
            worst[full] = score[np.searchsorted(row, full, "right") - 1]


# index


def _assigned(pivots: np.ndarray, square: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                dist = distances(augmented(unpacked(part.column("x")), square), pivots)
                near = dist.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(near.astype(np.int32)), pa.array(dist[np.arange(len(near)), near])], [*part.schema.names, "pivot", "dist"]
                )

    return run


def _built(square: float):
    def run(table: pa.Table) -> pa.Table:
        tree = Tree(np.asarray(table.column("vec_id")), np.asarray(table.column("label")), unpacked(table.column("x")), square)
        return pa.table({"pivot": table.column("pivot")[:1], "slot": table.column("slot")[:1], "tree": pa.array([tree.to_bytes()], pa.binary())})

    return run


class Index:
    """The trees of all rows, written in the shared folder, and the bounded table of pivots."""

    def __init__(self, rows: DataFrame, n: int, square: float, block: int = BLOCK):
        spark = rows.sparkSession
        self.square = square
        sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("x").limit(SAMPLE).toArrow()
        points = augmented(unpacked(sample.column("x")), square)
        self.pivots = points[farthest_first(points, max(1, min(PIVOTS, n // block)))]
        placed = stored(rows.mapInArrow(_assigned(self.pivots, square), _with(rows, "pivot int, dist double")), "placed")
        sizes = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius")).toArrow().to_pydict()
        self.radius, self.slots = np.zeros(len(self.pivots)), np.zeros(len(self.pivots), int)
        at = np.array(sizes["pivot"], int)
        self.radius[at], self.slots[at] = sizes["radius"], [-(-c // block) for c in sizes["n"]]
        slots = F.array(*(F.lit(int(s)) for s in self.slots))
        keyed = placed.withColumn("slot", F.pmod(F.xxhash64("vec_id"), slots[F.col("pivot")]).cast("int"))
        self.trees = stored(keyed.groupBy("pivot", "slot").applyInArrow(_built(square), "pivot int, slot int, tree binary"), "trees")
        self.spark = spark

    def routed(self, anchors: DataFrame) -> DataFrame:
        """Anchors once for each block whose pivot's ball reaches the window low..high."""
        slots, route = self.slots, _routes(self.pivots, self.radius, self.slots, self.square)
        pairs = anchors.mapInArrow(route, _with(anchors, "pivot int"))
        return pairs.withColumn("slot", F.explode(F.sequence(F.lit(0), F.array(*(F.lit(int(s)) for s in slots))[F.col("pivot")] - 1)))

    def search(self, anchors: DataFrame, k: int, same: bool, routed: DataFrame | None = None) -> DataFrame:
        """(anchor_id, tag, vec_id, score): the ``k`` first rows of each block for each anchor row.

        ``anchors`` has anchor_id, tag, label, x, low and high.
        """
        routed = self.routed(anchors) if routed is None else routed
        total = anchors.count()
        routed = routed.withColumn("share", F.pmod(F.xxhash64("anchor_id"), F.lit(max(1, -(-total // SHARE)))).cast("int"))
        keys = ["pivot", "slot", "share"]
        met = routed.select(*(F.col(c).alias(f"t_{c}") for c in keys)).distinct()
        trees = self.trees.select(F.col("pivot").alias("t_pivot"), F.col("slot").alias("t_slot"), "tree")
        met = met.join(trees, ["t_pivot", "t_slot"]).groupBy(*(f"t_{c}" for c in keys))
        return routed.groupBy(*keys).cogroup(met).applyInArrow(_searched(k, same), "anchor_id long, tag long, vec_id long, score long")


def _routes(pivots: np.ndarray, radius: np.ndarray, slots: np.ndarray, square: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                q = unpacked(part.column("x")).astype(float)
                if not len(q):
                    continue
                dist = distances(np.column_stack([q, np.zeros(len(q))]), pivots)
                below, above = bounds(dist, radius[None, :], (q * q).sum(axis=1)[:, None], square)
                low, high = (np.asarray(part.column(c))[:, None] for c in ("low", "high"))
                row, pivot = np.nonzero((above >= low) & (below <= high) & (slots > 0)[None, :])
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(row)).columns, pa.array(pivot.astype(np.int32))], [*part.schema.names, "pivot"])

    return run


def _searched(k: int, same: bool):
    def run(anchors: pa.Table, trees: pa.Table) -> pa.Table:
        if not trees.num_rows:  # a slot that no row was dealt to
            return pa.table({c: pa.array([], pa.int64()) for c in ("anchor_id", "tag", "vec_id", "score")})
        tree = Tree.from_bytes(trees.column("tree")[0].as_py())
        anchors = anchors.sort_by([("anchor_id", "ascending"), ("tag", "ascending")])
        ids, tags, label, low, high = (np.asarray(anchors.column(c)) for c in ("anchor_id", "tag", "label", "low", "high"))
        who, found, score = tree.best(ids, unpacked(anchors.column("x")), label, low, high, k, same)
        return pa.table({"anchor_id": ids[who], "tag": tags[who], "vec_id": found, "score": score})

    return run


def _first(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def hard_negatives(
    df: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, scale: int = SCALE,
    every: int = 100, noise: int = 7, vec: str = "embedding", block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row whose vec_id is divisible by ``every`` and each of its ``positives`` first neighbours of
    its label, the first ``negatives`` rows of other labels that score at least ``least_percent`` of the
    positive and no more than it. Where vec_id is divisible by ``noise`` the label is moved on by one
    modulo ten. Left out are rows with a null id, label or vector, with null, NaN or infinite components, and
    vectors that are empty or not of the commonest length. Rows repeated with one id, label and vector
    are one row; of rows that share an id and differ otherwise the one with the smallest label, then
    vector, counts. Equal scores go by the smaller id. A window of a negative score is empty. An empty
    table, or one label for all, gives no rows.
    """
    spark = df.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    moved = df.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select(
        "vec_id", F.when(F.col("vec_id") % noise == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long")).alias("label"), vec
    )
    rows, dim = integer_rows(moved, vec, {"vec_id": "long", "label": "long"}, scale, limit=LIMIT)
    if not dim:
        return spark.createDataFrame([], out)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x")
    rows = stored(rows, "candidates")
    size = rows.mapInArrow(_squares, "square long").agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("square")).first()
    if not size.n:
        return spark.createDataFrame([], out)
    index = Index(rows, size.n, float(size.square), block)
    anchors = rows.filter(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("anchor_id"), F.lit(0).cast("long").alias("tag"), "label", "x", F.lit(-_MANY).alias("low"), F.lit(_MANY).alias("high")
    )
    anchors = stored(anchors, "anchors")
    # one block near the anchor first: its worst hit there bounds what others must reach
    home = anchors.mapInArrow(_home(index.pivots), _with(anchors, "pivot int"))
    home = home.withColumn("slot", F.pmod(F.xxhash64("anchor_id"), F.array(*(F.lit(max(1, int(s))) for s in index.slots))[F.col("pivot")]).cast("int"))
    near = _first(index.search(anchors, positives, True, home), ["anchor_id"], positives)
    worst = near.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).filter(F.col("n") >= positives)
    bounded = anchors.join(worst, "anchor_id", "left").select("anchor_id", "tag", "label", "x", F.coalesce("least", "low").alias("low"), "high")
    bounded = stored(bounded, "bounded")
    best = stored(_first(index.search(bounded, positives, True), ["anchor_id"], positives), "positives")
    least = F.ceil(F.lit(least_percent) * F.col("score").cast("decimal(38,0)") / F.lit(100)).cast("long")
    windows = anchors.select("anchor_id", "label", "x").join(best.filter("score >= 0"), "anchor_id")
    windows = stored(windows.select("anchor_id", F.col("vec_id").alias("tag"), "label", "x", least.alias("low"), F.col("score").alias("high")), "windows")
    hits = _first(index.search(windows, negatives, False), ["anchor_id", "tag"], negatives)
    scores = best.select("anchor_id", F.col("vec_id").alias("tag"), F.col("score").alias("positive_score"))
    return hits.join(scores, ["anchor_id", "tag"]).select(
        "anchor_id", F.col("tag").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = unpacked(batch.column("x")).astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(np.ceil((x * x).sum(axis=1)).astype(np.int64) if len(x) else np.empty(0, np.int64))], ["square"])


def _home(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = unpacked(batch.column("x")).astype(float)
            if len(q):
                near = distances(np.column_stack([q, np.zeros(len(q))]), pivots).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "pivot"])

    return run
