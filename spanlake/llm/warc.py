"""Web archives: one gzip member per record, written once per payload, read by byte ranges.

Writer: tasks stream records into files below a shared folder and report each finished file; only
reported files are archives, so what a lost or repeated task left behind is never read. Bytes go
through ``pyarrow.fs``, which opens local mounts, HDFS and object stores alike.

Reader: files are cut into byte ranges, one task each. A task scans its range for the gzip magic,
takes a candidate as a record only if the member decodes to a WARC version line, a complete header
and as many bytes as the header says, and owns the records that start inside its range; it reads
past the end to finish the last one.

Limits: a record is held in memory by one task, like any row. A stored (uncompressed) copy of a
whole archive inside a payload would look like records to a range that begins inside that payload;
ranges that begin at a record never look inside it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.llm.scratch import shared_path, stored

MAGIC = b"\x1f\x8b\x08"
STEP, PIECE = 1 << 18, 1 << 14
SALTS = 16
DATE = "2000-01-01T00:00:00Z"
#: Fixed value of the format: the profile of a revisit with the same payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILES = "path string, bytes long, records long"
RECORDS = (
    "path string, offset long, length long, record_type string, record_id string, target_uri string, "
    "page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"
)
_ARROW = pa.schema(
    [(n, pa.string()) for n in ("path",)]
    + [(n, pa.int64()) for n in ("offset", "length")]
    + [(n, pa.string()) for n in ("record_type", "record_id", "target_uri")]
    + [(n, pa.int64()) for n in ("page_id", "refers_to", "payload_bytes")]
    + [("payload_digest", pa.string()), ("payload", pa.binary())]
)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}') if page_id is not None else uuid.uuid4()}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record (HTTP header only) if ``refers_to`` is given."""
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    fields = [("WARC-Record-ID", _urn(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to)), ("X-Refers-To-Page-Id", str(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record("response", fields, http + payload) if refers_to is None else _record("revisit", fields, http)


def _writer(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        out, size, n = None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
                page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                    info = _record("warcinfo", [("WARC-Record-ID", _urn(None)), ("WARC-Date", DATE)], b"format: WARC File Format 1.1\r\n")
                    size += out.write(gzip.compress(info, level, mtime=0))
                b32 = base64.b32encode(bytes.fromhex(digest)).decode()
                size += out.write(gzip.compress(page_record(page_id, url, payload, b32, refers_to), level, mtime=0))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "bytes": [size], "records": [n]})

    return run


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, level: int = 6) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) below ``folder``; returns path, bytes and records of each file.

    A null html is an empty payload. Of equal payloads of at least ``min_revisit_bytes`` bytes the
    one with the smallest page_id is the response, the others are revisits of it. Rows that repeat
    that page_id with the same payload are responses too; where all ids are null all are responses.
    A null url is an empty target. An empty table gives no file.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    # only repeated payloads have a head; the salt deals a payload shared by very many pages to several tasks
    heads = (
        rows.filter(F.octet_length("payload") >= min_revisit_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & F.col("head").isNotNull())
        .select("digest", "head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    marked = (
        rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        .join(heads, ["digest", "salt"], "left")
        .select(
            "page_id", "url", "payload", "digest",
            F.when(F.col("page_id").eqNullSafe(F.col("head")), None).otherwise(F.col("head")).alias("refers_to"),
        )
    )
    return stored(marked.mapInArrow(_writer(folder, level), FILES), "warc-files")


class _Bytes:
    """Forward reads over one file that keep only what may still be needed."""

    def __init__(self, f, start: int):
        self.f, self.base, self.buf = f, start, b""
        f.seek(start)

    def upto(self, end: int) -> bool:
        """Have bytes up to ``end``; False at the end of the file."""
        while self.base + len(self.buf) < end:
            more = self.f.read(STEP)
            if not more:
                return False
            self.buf += more
        return True

    def drop(self, pos: int) -> None:
        if pos - self.base >= STEP:
            self.buf = self.buf[pos - self.base :]
            self.base = pos


def _member(src: _Bytes, at: int) -> tuple[bytes, int] | None:
    """The record in the gzip member at ``at`` and the member's length; None if it isn't one."""
    inflate, out, pos, begun = zlib.decompressobj(31), [], at, False
    while not inflate.eof:
        more = src.upto(pos + 1)
        if not more:
            if begun:
                raise ValueError(f"record at byte {at} is cut off")
            return None
        chunk = src.buf[pos - src.base : pos - src.base + PIECE]
        try:
            out.append(inflate.decompress(chunk))
        except zlib.error:
            return None
        pos += len(chunk) - len(inflate.unused_data)
        if not begun:
            seen = b"".join(out)[:8]
            if len(seen) < 7 and not inflate.eof:
                continue
            if not seen.startswith(b"WARC/1."):
                return None
            begun = True
    return b"".join(out), pos - at


def _parsed(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        return None
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = fields.get("content-length", "")
    if not n.isdigit() or rest[int(n) :] != b"\r\n\r\n":
        return None
    return fields, rest[: int(n)]


def records_in_range(f, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, fields, block) of the records that start in ``[start, end)``."""
    src, pos = _Bytes(f, start), start
    while pos < end:
        src.drop(pos)
        src.upto(min(pos + STEP, end) + len(MAGIC) - 1)
        at = src.buf.find(MAGIC, pos - src.base)
        if at < 0:
            nxt = src.base + len(src.buf) - len(MAGIC) + 1
            if nxt <= pos or not src.upto(src.base + len(src.buf) + 1):
                return
            pos = nxt
            continue
        at += src.base
        if at >= end:
            return
        found = _member(src, at)
        if found and (parsed := _parsed(found[0])):
            yield at, found[1], *parsed
            pos = at + found[1]
        else:
            pos = at + 1


def _number(x: str | None) -> int | None:
    return int(x) if x else None


def _reader(with_payload: bool):
    def rows(path: str, start: int, end: int):
        store, p = fs.FileSystem.from_uri(path)
        with store.open_input_file(p) as f:
            for at, length, head, block in records_in_range(f, start, end):
                kind = head.get("warc-type")
                if kind not in ("response", "revisit"):
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                if kind == "response":
                    size, digest = len(payload), _digest(payload)
                else:
                    told = re.search(rb"(?i)^content-length:\s*(\d+)", http, re.M)
                    size = int(told[1]) if told else None
                    digest = head.get("warc-payload-digest", "").rpartition(":")[2]
                yield (
                    path, at, length, kind, head.get("warc-record-id"), head.get("warc-target-uri"), _number(head.get("x-page-id")),
                    _number(head.get("x-refers-to-page-id")), size, digest, payload if with_payload and kind == "response" else None,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in batch.to_pylist():
                for row in rows(x["path"], x["start"], x["end"]):
                    held.append(row)
                    size += 200 + len(row[-1] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _ARROW.types)], schema=_ARROW)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _ARROW.types)], schema=_ARROW)

    return run


def read_archives(files: DataFrame, split_bytes: int = 16 << 20, with_payload: bool = True) -> DataFrame:
    """Response and revisit records of the archives listed in ``files`` (path, bytes).

    A revisit's payload_bytes and payload_digest are those of the full payload, from its headers;
    its payload is null.
    """
    cut = files.select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"), "bytes"
    ).select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end"))
    tasks = max(1, cut.count())
    return cut.repartition(tasks, "path", "start").mapInArrow(_reader(with_payload), RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame, min_revisit_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the records back."""
    files = write_archives(pages, shared_path(spark, "warc"), min_revisit_bytes)
    return read_archives(files, with_payload=with_payload)
