"""Shards of near-equal bytes by a k-d tree over metadata, with DataFrame operations only.

Every cell of a level is split at once. A cell is cut along its widest dimension (its extent over the
extent of the whole table; the first of equals) at the weighted median of the bytes, so that each side
gets the share of its leaves. Medians are found from histograms: 4096 bins a cell, then 4096 bins of
the bin that holds the median, until that bin weighs at most ``tolerance`` of the cell or is one
value. Rows that share that value, such as all rows of one large source, are cut the same way by a
hash of the row, so no value is too frequent to split. Histograms and cuts stay in Spark; what is
broadcast has one row per cell, at most as many as shards.

Only narrow columns take part: the text is read once, for its size, length and checksum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.scratch import stored
from spanlake.ordered import with_ordinal

BINS, TOLERANCE = 4096, 0.001
_TIES = 1 << 36


def code(value: Column) -> Column:
    """A categorical dimension as a number; nulls get their own."""
    return F.pmod(F.xxhash64(value), F.lit(1 << 31)).cast("long")


def _ceil(a: Column, b: int) -> Column:
    return F.expr("1").cast("long") * F.floor((a + F.lit(b - 1)) / F.lit(b)).cast("long")


def _fronts(points: DataFrame, cells: DataFrame, extents: DataFrame, dims: int) -> DataFrame:
    """The cells to split: dimension, bytes wanted on the left, and the range that holds the cut."""
    found = points.groupBy("cell").agg(
        F.sum("size").alias("w"),
        F.array(*[F.min(F.col("dims")[i]) for i in range(dims)]).alias("lows"),
        F.array(*[F.max(F.col("dims")[i]) for i in range(dims)]).alias("highs"),
    )
    wide = F.array(*[(F.col("highs")[i] - F.col("lows")[i]) / F.greatest(F.col("extent")[i], F.lit(1)) for i in range(dims)])
    return (
        found.join(F.broadcast(cells.filter("leaves > 1")), "cell")
        .crossJoin(F.broadcast(extents))  # one row
        .withColumn("wide", wide)
        .withColumn("dim", (F.array_position("wide", F.array_max("wide")) - 1).cast("int"))
        .select(
            "cell", "leaves", "w", "dim",
            (F.col("w") * F.floor(F.col("leaves") / 2) / F.col("leaves")).alias("need"),
            F.col("lows")[F.col("dim")].alias("lo"), F.col("highs")[F.col("dim")].alias("hi"),
            F.lit(0.0).alias("base"), F.lit(False).alias("tied"), F.lit(0).cast("long").alias("value"),
            F.lit(False).alias("done"), F.lit(0).cast("long").alias("cut"), F.lit(0).cast("long").alias("tie_cut"),
        )
    )


def _narrowed(points: DataFrame, fronts: DataFrame, bins: int, tolerance: float) -> DataFrame:
    """One histogram of every open cell and what it tells of the cut."""
    opened = fronts.filter("not done").withColumn("width", _ceil(F.col("hi") - F.col("lo") + 1, bins))
    at = F.col("dims")[F.col("dim")]
    key = F.when(F.col("tied"), F.col("tie")).otherwise(at)
    hist = (
        points.join(F.broadcast(opened.select("cell", "dim", "lo", "hi", "tied", "value", "width")), "cell")
        .filter(F.when(F.col("tied"), at == F.col("value")).otherwise(F.lit(True)) & key.between(F.col("lo"), F.col("hi")))
        .groupBy("cell", F.floor((key - F.col("lo")) / F.col("width")).cast("long").alias("bin"))
        .agg(F.sum("size").alias("s"))
    )
    # at most `bins` rows of a cell
    run = Window.partitionBy("cell").orderBy("bin")
    told = hist.withColumn("upto", F.sum("s").over(run)).join(F.broadcast(opened), "cell")
    reached = told.filter(F.col("base") + F.col("upto") >= F.col("need")).groupBy("cell").agg(F.min_by(F.struct("bin", "s", "upto"), "bin").alias("b"))
    x = opened.join(F.broadcast(reached), "cell").select("*", "b.bin", "b.s", "b.upto")
    x = x.withColumn("from", F.col("lo") + F.col("bin") * F.col("width")).withColumn(
        "to", F.least(F.col("hi"), F.col("from") + F.col("width") - 1)
    )
    before = F.col("base") + F.col("upto") - F.col("s")
    small = F.col("s") <= tolerance * F.col("w")
    single = F.col("width") == 1
    done = small | (single & F.col("tied"))
    edge = F.when(F.col("need") - before < F.col("s") / 2, F.col("from")).otherwise(F.col("to") + 1)
    turn = single & ~F.col("tied") & ~small  # from here on by the hash of the row
    new = x.select(
        "cell", "leaves", "w", "dim", "need",
        F.when(turn, F.lit(0).cast("long")).otherwise(F.col("from")).alias("lo"),
        F.when(turn, F.lit(_TIES - 1)).otherwise(F.col("to")).alias("hi"),
        before.alias("base"),
        (F.col("tied") | turn).alias("tied"),
        F.when(turn, F.col("from")).otherwise(F.col("value")).alias("value"),
        done.alias("done"),
        F.when(F.col("tied"), F.col("value")).otherwise(edge).alias("cut"),
        F.when(F.col("tied"), edge).otherwise(F.lit(0).cast("long")).alias("tie_cut"),
    )
    return new.unionByName(fronts.filter("done"))


def kd_shards(
    docs: DataFrame,
    dims: Sequence[Column],
    shards: int | None = None,
    target_bytes: int | None = None,
    bins: int = BINS,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot per input row.

    ``dims`` are numeric columns below 2**60 (see ``code`` for categories; null counts as -1). Leaves:
    ``shards``, or as many as give at most ``target_bytes`` on average. A row's size is the UTF-8
    bytes of its text plus 1; null and empty texts weigh 1. Slots count from 0 in every shard by
    doc_id, null ids first. Rows alike in doc_id and text may share a side whatever the balance. With
    fewer rows than shards some shards stay empty; an empty table gives no row.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        F.array(*[F.coalesce(d.cast("long"), F.lit(-1)) for d in dims]).alias("dims"),
    )
    points = stored(
        raw.withColumn("tie", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(_TIES)).cast("long")).withColumn("cell", F.lit(1).cast("long")), "points"
    )
    n = len(dims)
    total = points.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("w"),
        F.array(*[F.max(F.col("dims")[i]) - F.min(F.col("dims")[i]) for i in range(n)]).alias("extent"),
    )
    leaves = F.lit(shards).cast("long") if shards else F.greatest(F.ceil(F.col("w") / F.lit(target_bytes)), F.lit(1)).cast("long")
    start = stored(total.select("extent", leaves.alias("leaves")), "extent")
    cells = start.select(F.lit(1).cast("long").alias("cell"), "leaves")
    while not cells.filter("leaves > 1").isEmpty():
        fronts = stored(_fronts(points, cells, start.select("extent"), n), "fronts")
        while not fronts.filter("not done").isEmpty():
            fronts = stored(_narrowed(points, fronts, bins, tolerance), "fronts")
        cuts = F.broadcast(fronts.select("cell", "dim", "cut", "tie_cut"))
        at = F.col("dims")[F.col("dim")]
        left = (at < F.col("cut")) | ((at == F.col("cut")) & (F.col("tie") < F.col("tie_cut")))
        points = stored(
            points.join(cuts, "cell", "left").select(
                "doc_id", "size", "text_crc32", "dims", "tie",
                F.when(F.col("dim").isNull(), F.col("cell")).otherwise(F.col("cell") * 2 + F.when(left, 0).otherwise(1)).alias("cell"),
            ),
            "points",
        )
        split = F.array(
            F.struct((F.col("cell") * 2).alias("cell"), F.floor(F.col("leaves") / 2).alias("leaves")),
            F.struct((F.col("cell") * 2 + 1).alias("cell"), F.ceil(F.col("leaves") / 2).alias("leaves")),
        )
        # cells without rows have no cut and end as they are
        parted = cells.join(F.broadcast(fronts.select("cell")), "cell", "left_semi").select(F.inline(split))
        cells = stored(parted.unionByName(cells.join(F.broadcast(fronts.select("cell")), "cell", "left_anti").withColumn("leaves", F.lit(1).cast("long"))), "cells")
    # path order of the leaves; one row per shard
    path = F.rpad(F.conv(F.col("cell").cast("string"), 10, 2), 64, "0")
    numbers = cells.select("cell", (F.row_number().over(Window.orderBy(path, "cell")) - 1).alias("shard"))
    placed = points.join(F.broadcast(numbers), "cell").select("doc_id", "size", "text_crc32", "shard")
    return with_ordinal(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")
