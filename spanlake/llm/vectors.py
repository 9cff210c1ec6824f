"""Vectors as fixed-length integers in a binary column, for operators whose arithmetic must be exact."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: integers are held to this range
LIMIT = (1 << 31) - 1


def unpacked(column: pa.Array) -> np.ndarray:
    """Matrix of the integers in a binary column of equal lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return np.empty((0, 0), np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").astype(np.int64).reshape(len(column), -1)


def packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows, "<i4")], pa.binary())


def _integer_rows(vec: str, keep: Sequence[str], scale: int, offset: int, limit: int, dim: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(vec)
            values = column.flatten()
            flat = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            good = np.isfinite(flat).all(axis=1)
            if values.null_count:
                good &= ~np.asarray(values.is_null()).reshape(-1, dim).any(axis=1)
            x = np.clip(np.floor(scale * flat[good]) + offset, -limit, limit).astype(np.int64)
            kept = [batch.column(c).filter(pa.array(good)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, packed(x)], schema=schema)

    return run


def common_length(df: DataFrame, vec: str) -> int:
    """The length that most vectors have, the larger of equally common ones; 0 without vectors."""
    n = F.size(vec)
    found = df.filter(F.col(vec).isNotNull() & (n > 0)).groupBy(n.alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return found.n if found else 0


def integer_rows(df: DataFrame, vec: str, keep: dict[str, str], scale: int, offset: int = 0, limit: int = LIMIT) -> tuple[DataFrame, int]:
    """Rows with a whole vector as ``x`` = floor(scale * component) + offset, and the vectors' length.

    ``keep`` maps column -> type. Left out are null vectors, those with null, NaN or infinite
    components, and those that are empty or not of the commonest length. Integers beyond ``limit`` are
    held to it.
    """
    dim = common_length(df, vec)
    fields = [T.StructField(c, T._parse_datatype_string(kind)) for c, kind in keep.items()]
    out = T.StructType([*fields, T.StructField("x", T.BinaryType())])
    arrow = pa.schema([*(pa.field(c, pa.int64()) for c in keep), pa.field("x", pa.binary())])
    rows = df.select(*(F.col(c).cast(kind).alias(c) for c, kind in keep.items()), F.col(vec).cast("array<double>").alias("_vec"))
    rows = rows.filter(F.size("_vec") == F.lit(dim or -2))
    return rows.mapInArrow(_integer_rows("_vec", list(keep), scale, offset, limit, max(dim, 1), arrow), out), dim
