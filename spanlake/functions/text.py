"""Text expressions: tokens, sentences, keywords, labels. All JVM-side except the span scanners."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.wordlists import (
    FILLER_WORDS,
    LABEL_STOP_WORDS,
    QUERY_STOP_WORDS,
    REASONING_MARKS,
)

TOKEN = r"[\p{L}\p{Nd}]+"
_WS_CHARS = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{_WS_CHARS}]"
NON_WS = f"[^{_WS_CHARS}]"
_MARK = "\x01"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text: str | Column) -> Column:
    """Lower-cased maximal runs of letters or decimal digits."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN), F.lit(0))


def words(text: str | Column) -> Column:
    """Whitespace-separated words (any Unicode white space)."""
    return F.regexp_extract_all(_c(text), F.lit(NON_WS + "+"), F.lit(0))


def collapse_ws(text: str | Column) -> Column:
    return F.array_join(words(text), " ")


def trim_ws(text: str | Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.regexp_replace(_c(text), f"^{WS}+|{WS}+$", "")


def is_label_term(term: Column) -> Column:
    return (
        F.octet_length(term).between(3, 30)
        & ~term.rlike("^[0-9]+$")
        & ~term.isin(LABEL_STOP_WORDS)
    )


def terms_tfidf(text: str | Column) -> Column:
    """Label terms: letter/number runs of 3-30 bytes, no stop words, no plain ASCII numbers."""
    terms = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.filter(terms, is_label_term)


def sentences(raw: str | Column) -> Column:
    """Ordered sentences of a raw transcript; paragraphs end at blank lines, white space collapsed."""
    text = F.replace(_c(raw), F.lit("\r\n"), F.lit("\n"))
    paragraphs = F.split(text, r"\n[ \t]*\n+")
    pieces = F.flatten(
        F.transform(
            paragraphs,
            lambda p: F.split(F.regexp_replace(p, r"([.!?])([ \n\t])", "$1" + _MARK + "$2"), _MARK),
        )
    )
    tidy = F.transform(pieces, lambda s: trim_ws(F.regexp_replace(s, r"[ \t\r\n]+", " ")))
    return F.filter(tidy, lambda s: s != "")


def first_sentences(text: str | Column, n: int) -> Column:
    """Up to ``n`` leading sentences; without any, the text or its first 280 characters and an ellipsis."""
    marked = F.regexp_replace(collapse_ws(text), r"([.!?])( |$)", "$1" + _MARK)

    def pick(pieces: Column) -> Column:
        found = F.size(pieces) - 1
        return F.when(
            found > 0,
            F.array_join(F.slice(pieces, F.lit(1), F.least(F.lit(n), F.greatest(found, F.lit(1)))), " "),
        ).otherwise(trim_runes(pieces[0], 280))

    return let(F.split(marked, _MARK), pick)


def trim_runes(text: str | Column, n: int) -> Column:
    """Text, or its first ``n`` code points trimmed and an ellipsis."""
    c = _c(text)
    return F.when(F.char_length(c) <= n, c).otherwise(F.concat(trim_ws(F.substring(c, 1, n)), F.lit("…")))


def preview_text(text: str | Column, n: int = 80) -> Column:
    """Text, or its first ``n`` code points (untrimmed) and an ellipsis."""
    c = _c(text)
    return F.when(F.char_length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit("…")))


def trim_words(text: str | Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def head_label(text: str | Column, n: int = 6) -> Column:
    return trim_words(text, n)


def _upper_letter(ch: Column) -> Column:
    """Upper case of one letter where that is one letter (not for the German sharp s)."""
    return F.when(F.char_length(F.upper(ch)) == 1, F.upper(ch)).otherwise(ch)


def title_case(text: str | Column) -> Column:
    """Upper-case the first letter of every space-separated word, leaving the rest alone."""
    return F.array_join(
        F.transform(
            F.split(_c(text), " "),
            lambda w: F.concat(_upper_letter(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)),
        ),
        " ",
    )


def slugify(text: str | Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(_c(text)), " _", "--"), "[^a-z0-9-]", "")


def extract_keywords(text: str | Column) -> Column:
    return F.array_join(F.filter(tokenize(text), lambda t: ~t.isin(QUERY_STOP_WORDS)), " ")


def clean_query(text: str | Column) -> Column:
    """Salient terms of a draft sentence in first-seen order; the trimmed input when none are left."""
    drop = QUERY_STOP_WORDS + FILLER_WORDS
    kept = F.array_distinct(
        F.filter(tokenize(text), lambda t: (F.octet_length(t) >= 2) & ~t.isin(drop))
    )
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(trim_ws(text))


def byte_prefix(text: str | Column, n: int) -> Column:
    """Longest prefix of whole characters that takes at most ``n`` bytes."""
    c = _c(text)
    head = F.substring(c.cast("binary"), 1, n).cast("string")
    whole = F.when(F.is_valid_utf8(head), head).otherwise(
        F.substring(head, F.lit(1), F.char_length(head) - 1)
    )
    return F.when(F.octet_length(c) <= n, c).otherwise(whole)


def query_variants(title: str | Column, body: str | Column, parent: str | Column) -> Column:
    """Up to four query texts for a node; empty when the title is blank."""

    def variants(x: Column) -> Column:
        t, b, p = x["t"], x["b"], x["p"]
        kw = extract_keywords(t)
        found = F.array(
            t,
            F.when((kw != t) & (kw != ""), kw),
            F.when(b != "", F.concat(t, F.lit(" "), byte_prefix(b, 200))),
            F.when(p != "", F.concat(p, F.lit(" "), t)),
        )
        return F.when(t != "", F.filter(found, lambda v: v.isNotNull())).otherwise(
            F.array().cast("array<string>")
        )

    t, b, p = (trim_ws(F.coalesce(_c(x), F.lit(""))) for x in (title, body, parent))
    return let(F.struct(t.alias("t"), b.alias("b"), p.alias("p")), variants)


def token_windows(text: str | Column, size: int = 300, stride: int = 150) -> Column:
    """Overlapping word windows: array of (start_token, text)."""

    def cut_windows(ws: Column) -> Column:
        n = F.size(ws)
        starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            starts,
            lambda i: F.struct(i.alias("start_token"), F.array_join(F.slice(ws, i + 1, size), " ").alias("text")),
        )

    return let(words(text), cut_windows)


def passage_id(chunk_id: str | Column, start: str | Column, end: str | Column) -> Column:
    return F.concat_ws("\x00", _c(chunk_id), _c(start).cast("string"), _c(end).cast("string"))


def split_passage_id(key: str | Column) -> Column:
    """(chunk_id, start, end), or null when the key is not a passage key."""
    parts = F.split(_c(key), "\x00", 3)
    s = F.try_element_at(parts, F.lit(2)).try_cast("int")
    e = F.try_element_at(parts, F.lit(3)).try_cast("int")
    return F.when(
        (F.size(parts) == 3) & s.isNotNull() & e.isNotNull() & (e > s),
        F.struct(parts[0].alias("chunk_id"), s.alias("start"), e.alias("end")),
    )


def strip_reasoning(reply: str | Column) -> Column:
    """Keep what follows the last end-of-reasoning mark."""
    out = _c(reply)
    for mark in REASONING_MARKS:
        out = F.element_at(F.split(out, "\\Q" + mark + "\\E"), -1)
    return out


def locate_selection(content: str | Column, selection: str | Column) -> Column:
    """Code-point span of a selection in its content: exact, else with white-space runs equated."""
    c, sel = _c(content), trim_ws(selection)
    at = F.instr(c, sel)
    quoted = F.replace(sel, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    pattern = F.concat(
        F.lit("\\Q"),
        F.regexp_replace(quoted, f"{WS}+", "\\\\E" + WS.replace("\\", "\\\\") + "+\\\\Q"),
        F.lit("\\E"),
    )
    hit = F.regexp_substr(c, pattern)
    before = F.char_length(F.element_at(F.split(c, pattern, 2), 1))
    return (
        F.when(sel == "", None)
        .when(at > 0, F.struct((at - 1).alias("start"), (at - 1 + F.char_length(sel)).alias("end")))
        .when(hit.isNotNull(), F.struct(before.alias("start"), (before + F.char_length(hit)).alias("end")))
    )


# ---- span scanners: need character positions, so they run on Arrow batches -----------------------

_TOKEN_RE = regex.compile(TOKEN)
_SENT_END_RE = regex.compile(r"[.!?](?=[ \n\t])")
_LEAD_WS_RE = regex.compile(r"\s*")

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
TOKEN_SPAN = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("sent", T.IntegerType()),
    ]
)
PASSAGE = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)


def spans_of_sentences(text: str) -> list[tuple[int, int]]:
    """Sentence spans of one text; same boundaries as ``sentences`` without the paragraph rule."""
    out = []
    start = _LEAD_WS_RE.match(text).end()
    for m in _SENT_END_RE.finditer(text):
        if m.end() > start:
            if text[start : m.end()].strip():
                out.append((start, m.end()))
            start = _LEAD_WS_RE.match(text, m.end()).end()
    if text[start:].strip():
        out.append((start, len(text)))
    return out


def _list_array(lengths: list[int], fields: dict[str, pa.Array]) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
    )


ROWS = 256  # texts of a batch that are Python objects at a time


def _in_slices(f, *columns: pa.Array) -> pa.Array:
    """``f`` of some rows at a time: only its Arrow results, a few bytes a token, are held for a whole batch."""
    done = [f(*(c.slice(lo, ROWS) for c in columns)) for lo in range(0, max(1, len(columns[0])), ROWS)]
    return pa.concat_arrays(done)


@F.arrow_udf(T.ArrayType(TOKEN_SPAN))
def tokenize_spans(text: pa.Array) -> pa.Array:
    """Tokens with code-point spans and the index of the sentence holding their start (-1: none)."""
    return _in_slices(_tokenize_spans, text)


def _tokenize_spans(text: pa.Array) -> pa.Array:
    lengths, terms, starts, ends, sents = [], [], [], [], []
    for t in text.to_pylist():
        before = len(terms)
        bounds = spans_of_sentences(t or "")
        k = 0
        for m in _TOKEN_RE.finditer(t or ""):
            s = m.start()
            while k < len(bounds) and s >= bounds[k][1]:
                k += 1
            terms.append(m.group().lower())
            starts.append(s)
            ends.append(m.end())
            sents.append(k if k < len(bounds) and s >= bounds[k][0] else -1)
        lengths.append(len(terms) - before)
    return _list_array(
        lengths,
        {
            "term": pa.array(terms, pa.string()),
            "start": pa.array(starts, pa.int32()),
            "end": pa.array(ends, pa.int32()),
            "sent": pa.array(sents, pa.int32()),
        },
    )


@F.arrow_udf(T.ArrayType(SPAN))
def sentence_spans(text: pa.Array) -> pa.Array:
    lengths, starts, ends = [], [], []
    for t in text.to_pylist():
        spans = spans_of_sentences(t or "")
        lengths.append(len(spans))
        starts.extend(s for s, _ in spans)
        ends.extend(e for _, e in spans)
    return _list_array(lengths, {"start": pa.array(starts, pa.int32()), "end": pa.array(ends, pa.int32())})


def chunk_passages(text: str | Column, size: int = 55, stride: int = 40) -> Column:
    """Overlapping token windows with their spans; the window reaching the last token is the last."""

    def passages(col: pa.Array) -> pa.Array:
        lengths, starts, ends, texts = [], [], [], []
        for t in col.to_pylist():
            spans = [m.span() for m in _TOKEN_RE.finditer(t or "")]
            n, before = len(spans), len(starts)
            for i in range(0, n, stride):
                j = min(i + size, n)
                s, e = spans[i][0], spans[j - 1][1]
                starts.append(s)
                ends.append(e)
                texts.append(t[s:e])
                if j == n:
                    break
            lengths.append(len(starts) - before)
        return _list_array(
            lengths,
            {
                "start": pa.array(starts, pa.int32()),
                "end": pa.array(ends, pa.int32()),
                "text": pa.array(texts, pa.string()),
            },
        )

    @F.arrow_udf(T.ArrayType(PASSAGE))
    def cut_passages(col: pa.Array) -> pa.Array:
        return _in_slices(passages, col)

    return cut_passages(_c(text))


SEGMENTS = T.ArrayType(
    T.StructType([T.StructField("text", T.StringType()), T.StructField("mark", T.BooleanType())])
)


def mark_segments(text: str, start: int, end: int, hits) -> list[dict]:
    """Cut text[start:end] into plain and marked pieces; overlapping hits extend the mark."""
    start, end = max(start, 0), min(end, len(text))
    edges = sorted((max(h["start"], start), min(h["end"], end)) for h in hits or [])
    out, pos = [], start

    def add(a, b, mark):
        if a < b:
            out.append({"text": text[a:b], "mark": mark})

    for a, b in edges:
        if a >= b or b <= pos:
            continue
        add(pos, max(a, pos), False)
        add(max(a, pos), b, True)
        pos = b
    add(pos, end, False)
    return out


@F.arrow_udf(SEGMENTS)
def snippet_segments(content: pa.Array, start: pa.Array, end: pa.Array, hits: pa.Array) -> pa.Array:
    """Marked pieces of a window, with an ellipsis on each side that is not a text edge."""
    return _in_slices(_snippet_segments, content, start, end, hits)


def _snippet_segments(content: pa.Array, start: pa.Array, end: pa.Array, hits: pa.Array) -> pa.Array:
    dots = {"text": "…", "mark": False}
    out = []
    for t, s, e, hs in zip(content.to_pylist(), start.to_pylist(), end.to_pylist(), hits.to_pylist()):
        if t is None or s is None or e is None:
            out.append(None)
            continue
        segs = mark_segments(t, s, e, hs)
        out.append(([dots] if s > 0 else []) + segs + ([dots] if e < len(t) else []))
    return pa.array(
        out, pa.list_(pa.struct([("text", pa.string()), ("mark", pa.bool_())]))
    )
