"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed; normaliser, metaspace marker, piece scores and byte fallback are
rebuilt as a tokenizers pipeline, for Unigram models from the scores themselves and for BPE models
from the merges that the scores imply. Texts are cut where a marker follows another character, which
changes nothing as long as no piece spans such a place, and is left out if one does.

A batch is encoded and decoded by the library's own threads. Parity with the sentencepiece library is
verified on what a task encodes: on every distinct word it meets, which is encoded once, or on whole
texts where words can't be cut. A difference is an error by default, so wrong ids are never written.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from spanlake.llm.scratch import unused

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed values of the protobuf: model types and piece types.
UNIGRAM, BPE = 1, 2
NORMAL, USER_DEFINED, BYTE = 1, 4, 6


def parse(model: bytes):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model)
    return proto


def merges_of(scores: dict[str, float]) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score first."""
    found = []
    for i, (piece, score) in enumerate(scores.items()):
        pairs = ((piece[:at], piece[at:]) for at in range(1, len(piece)))
        found.extend((-score, i, pair) for pair in pairs if pair[0] in scores and pair[1] in scores)
    found.sort(key=lambda x: x[:2])
    return [pair for _, _, pair in found]


def can_cut(pieces: Sequence[str]) -> bool:
    """Whether no piece has a marker after another character."""
    return not any(MARK in p.lstrip(MARK) for p in pieces)


def build(model: bytes, bare: bool = False) -> Tokenizer:
    """A tokenizers pipeline with the ids of the sentencepiece ``model``; ``bare`` takes normalised single words."""
    proto = parse(model)
    spec, trainer, pieces = proto.normalizer_spec, proto.trainer_spec, proto.pieces
    unk = next(i for i, p in enumerate(pieces) if p.type == 2)
    fallback = any(p.type == BYTE for p in pieces)
    if trainer.model_type == UNIGRAM:
        core = models.Unigram([(p.piece, p.score) for p in pieces], unk, fallback)
    elif trainer.model_type == BPE:
        scores = {p.piece: p.score for p in pieces if p.type in (NORMAL, USER_DEFINED)}
        core = models.BPE({p.piece: i for i, p in enumerate(pieces)}, merges_of(scores), unk_token=pieces[unk].piece, fuse_unk=True, byte_fallback=fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    out = Tokenizer(core)
    whole = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if bare:
        out.decoder = decoders.Sequence(whole)
        return out
    steps = []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    if can_cut([p.piece for p in pieces if p.type in (NORMAL, USER_DEFINED)]):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    out.decoder = decoders.Sequence([*whole, decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else whole)
    return out


class Backend:
    """A model in both libraries, with the ids of the words met so far in this process and what they decode to.

    Words are kept only where texts can be cut into them and the normaliser is the plain one; else a
    text is one word and nothing is kept. The memory is emptied when it holds ``most`` words or as
    many ids times eight.
    """

    def __init__(self, model: bytes, most: int = 300_000):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        self.tokenizer = build(model)
        self.own = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = parse(model).normalizer_spec
        plain = spec.add_dummy_prefix and spec.escape_whitespaces and not (spec.remove_extra_whitespaces or spec.precompiled_charsmap)
        self.cut = bool(plain and self.tokenizer.pre_tokenizer)
        self.bare = build(model, bare=True)
        # ids as little-endian 32-bit integers, so that a text's are its words' joined
        self.known: dict[str, bytes] = {}
        self.back: dict[str, str] = {}
        self.held, self.most = 0, most

    def words(self, text: str) -> list[str]:
        """The text's words without the marker that each begins with."""
        if not text:
            return []
        words = text.split(" ")
        if "" not in words and MARK not in text:
            return words
        return [w[1:] for w in _WORD.findall(MARK + text.replace(" ", MARK))]

    def differ(self, units: Sequence[str], ids: Sequence[list[int]]) -> list[str]:
        return [u for u, a, b in zip(units, ids, self.own.encode(list(units), num_threads=1)) if a != b]

    def both(self, texts: Sequence[str], verify: bool) -> tuple[list[bytes], list[str]]:
        """Ids of every text, as bytes, and the text decoded from them.

        Every word begins with the marker, which is a piece, so no run of byte pieces goes on from one word
        to the next and a text decodes to what its words decode to.
        """
        if not self.cut:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]
            self.check(self.differ(texts, ids) if verify else [])
            return list(map(_packed, ids)), self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        if len(self.known) > self.most or self.held > 8 * self.most:
            self.known, self.back, self.held = {}, {}, 0
        parts = [self.words(t) for t in texts]
        new = list(set().union(*parts).difference(self.known))
        ids = [e.ids for e in self.bare.encode_batch_fast([MARK + w for w in new], add_special_tokens=False)]
        # the lone marker of a space at the end is no text of its own
        self.check(self.differ(*zip(*[x for x in zip(new, ids) if x[0]])) if verify and any(new) else [])
        self.known.update(zip(new, map(_packed, ids)))
        self.back.update(zip(new, self.bare.decode_batch(ids, skip_special_tokens=False)))
        self.held += sum(map(len, ids))
        out = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        ends = [(t, _unpacked(x)) for t, p, x in zip(texts, parts, out) if p and not p[-1]]
        self.check(self.differ(*zip(*ends)) if verify and ends else [])
        return out, ["".join(map(self.back.__getitem__, p))[1:] for p in parts]

    @staticmethod
    def check(wrong: list[str]) -> None:
        if wrong:
            raise ValueError(f"{len(wrong)} words are encoded otherwise by sentencepiece, such as {wrong[0]!r}")


def _packed(ids: Sequence[int]) -> bytes:
    return array("i", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<i4").tobytes()


def _unpacked(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<i4").tolist()


_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> Backend:
    return Backend(model)


def encode(texts: Sequence[str], model: bytes, verify: bool = False) -> list[list[int]]:
    return list(map(_unpacked, _loaded(model).both(texts, verify)[0]))


def decode(ids: Sequence[Sequence[int]], model: bytes) -> list[str]:
    return _loaded(model).tokenizer.decode_batch(ids, skip_special_tokens=False)


_STEP = 2 << 20


def _batched(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _STEP:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


_OUT = pa.struct([("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())])


def encoded(text: str | Column, model: bytes, verify: bool = True, with_ids: bool = True) -> Column:
    """struct<ids, n_tokens, ids_sha256, decoded_sha256, round_trip> of a text column.

    ids_sha256 is over the ids as little-endian 32-bit integers, decoded_sha256 over the decoded text
    in UTF-8; ``round_trip`` says that it is the text again. ``ids`` is null unless ``with_ids``. A null
    text counts as empty and has no ids.
    """

    @F.arrow_udf("ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
    def run(col: pa.Array) -> pa.Array:
        texts = [t or "" for t in col.to_pylist()]
        ids_out, n, sha, back_sha, same = [], [], [], [], []
        for lo, hi in _batched(texts):
            part = texts[lo:hi]
            for t, x, back in zip(part, *_loaded(model).both(part, verify)):
                ids_out.append(x if with_ids else b"")
                n.append(len(x) // 4)
                sha.append(hashlib.sha256(x).hexdigest())
                back_sha.append(hashlib.sha256(back.encode()).hexdigest())
                same.append(back == t)
        if with_ids:
            flat = np.frombuffer(b"".join(ids_out), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]), pa.int32()), pa.array(flat, pa.int32()))
        else:
            lists = pa.nulls(len(texts), pa.list_(pa.int32()))
        arrays = [lists, pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(back_sha, pa.string()), pa.array(same, pa.bool_())]
        return pa.StructArray.from_arrays(arrays, fields=list(_OUT))

    return run(F.col(text) if isinstance(text, str) else text)


def read_model(path: str = DEFAULT_MODEL) -> bytes:
    """The model file, read once on the driver; some hundred kilobytes that go along with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def token_ids(docs: DataFrame, model: bytes, columns: Sequence[str] = ("doc_id",), verify: bool = True, with_ids: bool = True) -> DataFrame:
    """``columns`` and what ``encoded`` gives for every row of ``docs``."""
    (found,) = unused(docs, "_found")
    return docs.withColumn(found, encoded(F.col("text").cast("string"), model, verify, with_ids)).select(
        *columns, *(F.col(f"{found}.{n}").alias(n) for n in ("ids", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"))
    )
