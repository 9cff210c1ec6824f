"""Ordinals and running sums that never put a whole group in one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sends every row of a key to one task. When one key
may hold a third of the table that task is the job. Here rows are range-partitioned by
(key, order) so that a hot key spans many partitions; each partition is ranked on its own and shifted
by the totals of the partitions before it, a table with one row per (key, partition).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.runtime import cut, shuffle_partitions

_PART = "_part"


def _as_cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    ordinal: str | None = None,
    sums: Mapping[str, str | Column] | None = None,
    id: Sequence[str] | None = None,
) -> DataFrame:
    """Add a 0-based ordinal and exclusive running sums per key, in ``order``.

    ``order`` must be total within a key (end it with an id). ``sums`` maps new column -> summed
    expression; each new column holds the sum over the rows before this one.

    With ``id``, columns that name a row, ``order`` is of column names, and only keys, order, ids and summands are
    ordered and written; texts, vectors and the like are joined to the result. Give it for wide rows.
    """
    sums = dict(sums or {})
    keys = list(keys)
    if id is not None:
        narrow = list(dict.fromkeys([*keys, *order, *id]))
        staged = df.select(*narrow, *(F.coalesce(_as_cols([expr])[0], F.lit(0)).alias("_s_" + name) for name, expr in sums.items()))
        placed = with_running(staged, keys, order, ordinal, {name: F.col("_s_" + name) for name in sums})
        new = [*([ordinal] if ordinal else []), *sums]
        named = placed.select(*(F.col(c).alias("_i_" + c) for c in id), *(F.col(c).alias("_n_" + c) for c in new))
        met = df.join(named, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col("_i_" + c)) for c in id]))
        return met.select(*(F.col(c) for c in df.columns if c not in new), *(F.col("_n_" + c).alias(c) for c in new))
    cols = _as_cols(order)
    staged = df
    for name, expr in sums.items():
        staged = staged.withColumn("_v_" + name, F.coalesce(_as_cols([expr])[0], F.lit(0)))
    n = shuffle_partitions(df.sparkSession)
    parts = cut(
        staged.repartitionByRange(n, *[F.col(k) for k in keys], *cols).withColumn(_PART, F.spark_partition_id())
    )
    totals = parts.groupBy(*keys, _PART).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum("_v_" + s).alias("_t_" + s) for s in sums]
    )
    # one row per (key, partition): at most `n` rows in any window below
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *keys,
        _PART,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base_n"),
        *[F.coalesce(F.sum("_t_" + s).over(before), F.lit(0)).alias("_base_" + s) for s in sums],
    )
    here = Window.partitionBy(*keys, _PART).orderBy(*cols)
    prev = here.rowsBetween(Window.unboundedPreceding, -1)
    out = parts
    if ordinal:
        out = out.withColumn("_rn", F.row_number().over(here) - 1)
    for s in sums:
        out = out.withColumn("_run_" + s, F.coalesce(F.sum("_v_" + s).over(prev), F.lit(0)))
    out = out.join(base, [*keys, _PART])
    select = [F.col(c) for c in df.columns if c not in sums and c != ordinal]
    if ordinal:
        select.append((F.col("_rn") + F.col("_base_n")).cast("long").alias(ordinal))
    select += [(F.col("_run_" + s) + F.col("_base_" + s)).alias(s) for s in sums]
    return out.select(*select)


def with_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, name: str) -> DataFrame:
    """Add the largest ``value`` of the rows before each one of its key, in ``order``; nulls don't count.

    With a struct that begins with the order this is the latest value before a row. Split like
    ``with_running``, so a hot key spans many tasks.
    """
    keys, cols = list(keys), _as_cols(order)
    n = shuffle_partitions(df.sparkSession)
    parts = cut(
        df.withColumn("_v", value).repartitionByRange(n, *[F.col(k) for k in keys], *cols).withColumn(_PART, F.spark_partition_id())
    )
    # one row per (key, partition): at most `n` rows in any window below
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    base = parts.groupBy(*keys, _PART).agg(F.max("_v").alias("_m")).withColumn("_base", F.max("_m").over(before)).drop("_m")
    here = Window.partitionBy(*keys, _PART).orderBy(*cols).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumn("_run", F.max("_v").over(here)).join(base, [*keys, _PART])
    return out.select(*df.columns, F.coalesce("_run", "_base").alias(name))


def latest(df: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """One row per key: the one with the largest ``order``, and of equal ones the one with the largest values.

    Without that column the largest values decide, so a replay picks the same row.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c != order]
    first = [F.col(order)] if order and order in df.columns else []
    row = F.struct(*first, *[F.col(c) for c in rest])
    return df.groupBy(*keys).agg(F.max(row).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def with_ordinal(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "ord", start: int = 0, id: Sequence[str] | None = None
) -> DataFrame:
    """0-based (or ``start``-based) position of each row inside its key; ``id`` as in ``with_running``."""
    out = with_running(df, keys, order, ordinal=name, id=id)
    return out.withColumn(name, F.col(name) + F.lit(start)) if start else out


def shifted(df: DataFrame, keys: Sequence[str], ordinal: str, by: int, value: str, name: str) -> DataFrame:
    """Value of the row ``by`` positions later (negative: earlier) in the same key, as an equi-join.

    ``df`` already carries ``ordinal``; the join key (key, ordinal) is unique, so no row set is
    gathered.
    """
    other = df.select(*keys, (F.col(ordinal) - F.lit(by)).alias(ordinal), F.col(value).alias(name))
    return df.join(other, [*keys, ordinal], "left")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key with a 1-based rank.

    The rank filter is pushed below the shuffle as a window group limit, so each map task sends at
    most ``k`` rows per key.
    """
    w = Window.partitionBy(*keys).orderBy(*_as_cols(order))
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
