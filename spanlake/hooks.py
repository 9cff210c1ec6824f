"""User functions: where a model or another rule can be plugged in, with the built-in defaults.

K1 embedder    column function ``text -> array<float>``; ``embedder`` wraps a plain Python callable
K2 completer   ``(system, prompt) -> reply``, called on executors; no default
K3 summariser  ``(texts, df, n_docs, group, order) -> digests`` DataFrame function
K4 clusterer   ``hits -> sub-themes`` DataFrame function
K5 stitcher    ``(spans, glue_level) -> pieces`` DataFrame function
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.vectors import VEC, stub_embed
from spanlake.operators.cluster import cluster_per_query
from spanlake.operators.keywords import extractive_digest
from spanlake.operators.outline import GLUE, stitch_spans

Embedder = Callable[..., Column]
Completer = Callable[[str, str], str]
Summariser = Callable[..., DataFrame]
Clusterer = Callable[[DataFrame], DataFrame]
Stitcher = Callable[[DataFrame, int], DataFrame]

EMBED_BATCH = 16


class EmbedderNotReady(RuntimeError):
    """Raised by an embedder that cannot answer yet; streaming jobs pause on it."""


def embedder(embed: Callable[[Sequence[str], str], Sequence[Sequence[float]]], side: str = "document") -> Embedder:
    """Column function calling ``embed(texts, side)`` on small batches; a wrong vector count is an error.

    ``side`` tells document texts from query texts for models that treat them differently.
    """

    def apply(text: str | Column) -> Column:
        @F.arrow_udf(VEC)
        def run(col: pa.Array) -> pa.Array:
            texts = col.to_pylist()
            out: list = []
            for lo in range(0, len(texts), EMBED_BATCH):
                part = [t or "" for t in texts[lo : lo + EMBED_BATCH]]
                vecs = embed(part, side)
                if len(vecs) != len(part):
                    raise ValueError(f"embedder gave {len(vecs)} vectors for {len(part)} texts")
                out.extend([float(x) for x in v] for v in vecs)
            return pa.array(out, pa.list_(pa.float32()))

        return run(F.col(text) if isinstance(text, str) else text)

    return apply


def glue_stitcher(spans: DataFrame, glue_level: int = 0) -> DataFrame:
    """Default stitcher: fixed glue between spans whatever the level."""
    return stitch_spans(spans, GLUE)


DEFAULT_EMBEDDER: Embedder = stub_embed
DEFAULT_SUMMARISER: Summariser = extractive_digest
DEFAULT_CLUSTERER: Clusterer = cluster_per_query
DEFAULT_STITCHER: Stitcher = glue_stitcher
