"""Vector expressions."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VEC = T.ArrayType(T.FloatType())
_TOKEN_RE = regex.compile(r"[\p{L}\p{Nd}]+")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine in double precision; 0 for unequal lengths, empty or zero vectors."""
    a, b = _c(a), _c(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(ok, F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))).otherwise(F.lit(0.0))


@F.arrow_udf(T.BinaryType())
def encode_vec(vec: pa.Array) -> pa.Array:
    """float32 array -> little-endian bytes, over the batch's flat buffer."""
    size = np.where(vec.is_null().to_numpy(False), 0, vec.value_lengths().fill_null(0).to_numpy(False))
    offsets = np.concatenate([[0], np.cumsum(4 * size)]).astype(np.int32)
    data = np.ascontiguousarray(vec.flatten().to_numpy(zero_copy_only=False), "<f4")
    known = pa.array(vec.is_valid().to_numpy(False)).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(vec), [known, pa.py_buffer(offsets), pa.py_buffer(data)])


@F.arrow_udf(VEC)
def decode_vec(blob: pa.Array) -> pa.Array:
    """Little-endian bytes -> float32 array, over the batch's flat buffer."""
    offsets = np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1]
    data = np.frombuffer(blob.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    values = pa.array(np.frombuffer(data.tobytes(), "<f4"), pa.float32())
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]) // 4, pa.int32()), values, mask=blob.is_null())


def feature_hash(text: str, dim: int) -> np.ndarray:
    """Unit vector of hashed token features; the same text always gives the same vector."""
    v = np.zeros(dim, dtype=np.float64)
    for m in _TOKEN_RE.finditer((text or "").lower()):
        h = zlib.crc32(m.group().encode("utf-8"))
        v[h % dim] += 1.0 if (h >> 16) & 1 else -1.0
    norm = np.sqrt(v @ v)
    if norm == 0.0:
        v[zlib.crc32((text or "").encode("utf-8")) % dim] = 1.0
        norm = 1.0
    return (v / norm).astype(np.float32)


def stub_embed(text: str | Column, dim: int = 64) -> Column:
    """Deterministic unit vector from text, standing in where no model is bound."""

    @F.arrow_udf(VEC)
    def embed(col: pa.Array) -> pa.Array:
        cache: dict[str, list[float]] = {}
        out = []
        for t in col.to_pylist():
            t = t or ""
            if t not in cache:
                cache[t] = feature_hash(t, dim).tolist()
            out.append(cache[t])
        return pa.array(out, pa.list_(pa.float32()))

    return embed(_c(text))
