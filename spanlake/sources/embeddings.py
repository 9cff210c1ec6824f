"""Embedding files: the binary record format as a Spark data source, and the older TSV form."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)

# Header of the binary embedding file.
MAGIC = b"FEMB"
VERSION = 1
HEADER = struct.Struct("<4sHHI4x")
TSV_HEADER = ["file_name", "start_token", "embedding", "text"]

RECORD = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("start_token", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("vec", T.ArrayType(T.FloatType())),
    ]
)
_ARROW = pa.schema(
    [
        ("source_file", pa.string()),
        ("start_token", pa.int32()),
        ("text", pa.string()),
        ("vec", pa.list_(pa.float32())),
    ]
)


def _take(f, n: int, what: str, i: int) -> bytes:
    data = f.read(n)
    if len(data) != n:
        raise ValueError(f"{f.name}: truncated {what} at record {i}")
    return data


def iter_records(path: str) -> Iterator[tuple[str, int, str, np.ndarray]]:
    """Stream one file's records; a bad header or a short record raises."""
    with open(path, "rb") as f:
        head = f.read(HEADER.size)
        if len(head) != HEADER.size:
            raise ValueError(f"{path}: truncated header")
        magic, version, dims, count = HEADER.unpack(head)
        if magic != MAGIC:
            raise ValueError(f"{path}: not an embedding file")
        if version != VERSION:
            raise ValueError(f"{path}: unsupported version {version}")
        for i in range(count):
            (n,) = struct.unpack("<I", _take(f, 4, "source length", i))
            source = _take(f, n, "source", i).decode("utf-8")
            start, n = struct.unpack("<iI", _take(f, 8, "text length", i))
            text = _take(f, n, "text", i).decode("utf-8")
            yield source, start, text, np.frombuffer(_take(f, 4 * dims, "vector", i), dtype="<f4")


def write_records(path: str, rows) -> int:
    """Write records to one file; the count goes into the header at the end."""
    n, dims = 0, 0
    with open(path, "wb") as f:
        f.write(HEADER.pack(MAGIC, VERSION, 0, 0))
        for source, start, text, vec in rows:
            v = np.asarray(vec, dtype="<f4")
            if n == 0:
                dims = len(v)
            elif len(v) != dims:
                raise ValueError(f"{path}: vector of {len(v)} numbers among {dims}")
            s, t = source.encode("utf-8"), text.encode("utf-8")
            f.write(struct.pack("<I", len(s)) + s + struct.pack("<iI", start, len(t)) + t + v.tobytes())
            n += 1
        f.seek(0)
        f.write(HEADER.pack(MAGIC, VERSION, dims, n))
    return n


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _FembedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        import glob

        found = glob.glob(os.path.join(self.path, "*.fembed")) if os.path.isdir(self.path) else glob.glob(self.path)
        if not found:
            raise FileNotFoundError(self.path)
        return [_File(p) for p in sorted(found)]

    def read(self, partition: _File):
        batch: list = []
        for rec in iter_records(partition.path):
            batch.append(rec)
            if len(batch) == 1024:
                yield _batch(batch)
                batch = []
        if batch:
            yield _batch(batch)


def _batch(rows) -> pa.RecordBatch:
    src, start, text, vec = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(src, pa.string()),
            pa.array(start, pa.int32()),
            pa.array(text, pa.string()),
            pa.array([v.tolist() for v in vec], pa.list_(pa.float32())),
        ],
        schema=_ARROW,
    )


class _Commit(WriterCommitMessage):
    def __init__(self, temp: str | None, final: str | None):
        self.temp, self.final = temp, final


class _FembedWriter(DataSourceWriter):
    """One file per non-empty task; files appear under their final name only on commit."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        ctx = TaskContext.get()
        os.makedirs(self.path, exist_ok=True)
        name = f"part-{ctx.partitionId():05d}.fembed"
        temp = os.path.join(self.path, f"_{ctx.taskAttemptId()}-{name}.tmp")
        n = write_records(temp, ((r.source_file, r.start_token, r.text, r.vec) for r in iterator))
        if n == 0:
            os.remove(temp)
            return _Commit(None, None)
        return _Commit(temp, os.path.join(self.path, name))

    def commit(self, messages) -> None:
        os.makedirs(self.path, exist_ok=True)
        keep = {m.final for m in messages if m and m.final}
        for m in messages:
            if m and m.temp:
                os.replace(m.temp, m.final)
        if self.overwrite:
            for f in os.listdir(self.path):
                p = os.path.join(self.path, f)
                if f.endswith(".fembed") and p not in keep:
                    os.remove(p)

    def abort(self, messages) -> None:
        for m in messages:
            if m and m.temp and os.path.exists(m.temp):
                os.remove(m.temp)


class FembedDataSource(DataSource):
    """``spark.read.format("fembed").load(path)``: one partition per file of a shared file system."""

    @classmethod
    def name(cls) -> str:
        return "fembed"

    def schema(self):
        return RECORD

    def reader(self, schema):
        return _FembedReader(self.options["path"])

    def writer(self, schema, overwrite: bool):
        return _FembedWriter(self.options["path"], overwrite)


def read_fembed(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FembedDataSource)
    return spark.read.format("fembed").load(path)


def write_fembed(df: DataFrame, path: str) -> None:
    df.sparkSession.dataSource.register(FembedDataSource)
    df.select("source_file", "start_token", "text", "vec").write.format("fembed").mode("overwrite").save(path)


def read_embed_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, source_file, start_token, text, vec) of TSV embedding files.

    Rows with fewer than four fields are skipped, a wrong header or a bad number is an error.
    """
    schema = "file_name string, start_token string, embedding string, text string"
    lines = spark.read.csv(
        path, sep="\t", header=False, schema=schema, quote='"', escape='"', multiLine=True, mode="PERMISSIVE", encoding="UTF-8"
    ).select("*", F.col("_metadata.file_path").alias("path"))
    numbered = lines.withColumn("line", F.monotonically_increasing_id())
    is_head = F.col("file_name") == TSV_HEADER[0]
    good_head = is_head & (F.col("start_token") == TSV_HEADER[1]) & (F.col("embedding") == TSV_HEADER[2]) & (
        F.col("text") == TSV_HEADER[3]
    )
    heads = numbered.groupBy("path").agg(
        F.min(F.struct("line", good_head.alias("ok"))).alias("h")
    )
    rows = numbered.join(
        heads.select(
            "path",
            F.col("h.line").alias("head_line"),
            F.when(F.coalesce("h.ok", F.lit(False)), True)
            .otherwise(F.raise_error(F.concat(F.lit("unexpected header in "), F.col("path"))))
            .alias("ok"),
        ),
        "path",
    ).filter(F.col("ok") & (F.col("line") > F.col("head_line")) & F.col("text").isNotNull())
    return rows.select(
        "path",
        "line",
        F.col("file_name").alias("source_file"),
        F.trim("start_token").cast("int").alias("start_token"),
        "text",
        F.transform(F.split("embedding", ","), lambda x: F.trim(x).cast("float")).alias("vec"),
    )


def same_dims(rows: DataFrame) -> DataFrame:
    """Rows whose vector is as long as the first row's of their file."""
    first = rows.groupBy("path").agg(F.min(F.struct("line", F.size("vec").alias("dim"))).alias("f"))
    return rows.join(first.select("path", F.col("f.dim").alias("dim")), "path").filter(F.size("vec") == F.col("dim")).drop("dim")


def convert_tsv_to_fembed(spark: SparkSession, in_dir: str, out_dir: str) -> DataFrame:
    """Rewrite TSV files as binary files of the same name: (file, n, skipped)."""
    rows = read_embed_tsv(spark, os.path.join(in_dir, "*.embed"))
    kept = same_dims(rows)
    name = F.concat(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.embed$", ""), F.lit(".fembed"))

    def write_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows arrive sorted by (file, line); one output file is open at a time
        os.makedirs(out_dir, exist_ok=True)

        def stream():
            for b in batches:
                yield from b.to_pylist()

        from itertools import groupby

        for file, group in groupby(stream(), key=lambda r: r["file"]):
            final = os.path.join(out_dir, file)
            temp = f"{final}.{os.getpid()}.tmp"
            n = write_records(temp, ((r["source_file"], r["start_token"], r["text"], r["vec"]) for r in group))
            os.replace(temp, final)
            yield pa.RecordBatch.from_pydict({"file": [file], "n": pa.array([n], pa.int64())})

    written = (
        kept.withColumn("file", name)
        .repartition("file")
        .sortWithinPartitions("file", "line")
        .select("file", "source_file", "start_token", "text", "vec")
        .mapInArrow(write_file, "file string, n long")
    )
    read = rows.groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("read"))
    return written.join(read, "file").select("file", "n", (F.col("read") - F.col("n")).alias("skipped"))


def records_to_chunks(records: DataFrame) -> DataFrame:
    """Embedding records as chunk rows; the id follows from source, offset and text."""
    return records.select(
        F.sha2(F.concat_ws("\x00", "source_file", F.col("start_token").cast("string"), "text"), 256).alias("chunk_id"),
        "source_file",
        F.col("text").alias("content"),
        F.col("start_token").alias("start_offset"),
        (F.col("start_token") + F.char_length("text")).alias("end_offset"),
        F.lit(None).cast("string").alias("speaker"),
        "vec",
    )


def import_embeddings_dir(spark: SparkSession, path: str, fmt: str = "fembed") -> tuple[DataFrame, DataFrame]:
    """All matching files of a folder as chunks, and the row count per source file."""
    recs = read_fembed(spark, os.path.join(path, "*.fembed")) if fmt == "fembed" else read_embed_tsv(
        spark, os.path.join(path, "*.embed")
    )
    chunks = records_to_chunks(recs)
    return chunks, chunks.groupBy("source_file").agg(F.count(F.lit(1)).alias("imported"))
