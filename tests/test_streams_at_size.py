"""What queries on files and streams do with tables of several files."""

import glob
import os

import pyarrow as pa
import pytest

from spanlake.functions import text as tx
from spanlake.plans import streams
from spanlake.runtime import _LISTING, few_listing_tasks

N = 90


@pytest.fixture
def tables(spark, tmp_path, monkeypatch):
    """Documents, labels and embeddings as folders of three files each, and a scratch folder of our own."""
    docs = [(i, f"Text number {i}. It has words.\nAnd a line.", "de" if i % 3 else "en", f"src{i % 4}", 40) for i in range(N)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, i % 2) for i in range(0, N, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(N)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(1, "words of text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(streams, "_scratch", lambda _: f"{tmp_path}/scratch")
    return str(tmp_path)


def test_streams_read_a_folder_of_documents(spark, tables):
    assert streams.stream_backfill(spark, tables).count() == N


def test_streams_read_a_file_of_documents(spark, tables, tmp_path):
    (tmp_path / "one").mkdir()
    os.link(glob.glob(f"{tables}/documents.parquet/*.parquet")[0], tmp_path / "one" / "documents.parquet")
    assert 0 < streams.stream_backfill(spark, f"{tmp_path}/one").count() < N


def test_files_of_documents_lie_in_few_folders(spark, tables):
    at = streams._files(spark, tables)
    files = glob.glob(f"{at}/*/*.txt")
    assert len(files) == N and len(glob.glob(f"{at}/*")) < N
    with open(next(f for f in files if f.endswith("doc=7.txt")), "rb") as f:
        assert f.read() == b"Text number 7. It has words.\nAnd a line.\n"
    assert {r.doc_id for r in streams.scan_transcripts(spark, tables).collect()} == set(range(N))


def test_rows_of_one_document_share_its_file(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a"), ("1", "€"), ("2", None), (None, "b")], "doc string, line string")
    at = streams._write_files(rows, f"{tmp_path}/files", "latin-1")
    found = {f.split("doc=")[1]: sorted(open(f, "rb").read().split(b"\n")) for f in glob.glob(f"{at}/*/*")}
    assert found == {"1.txt": [b"", b"?", b"a"], "2.txt": [b"", b""], "__HIVE_DEFAULT_PARTITION__.txt": [b"", b"b"]}


def test_files_are_listed_by_few_tasks(spark):
    before = spark.conf.get(_LISTING)
    with few_listing_tasks(spark):
        assert int(spark.conf.get(_LISTING)) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(_LISTING) == before


def test_arriving_rows_are_not_put_into_one_file(spark, tables):
    assert streams.stream_backfill_stored(spark, tables).count() == N
    first = min(glob.glob(f"{tables}/scratch/in/*.parquet"))
    assert len(glob.glob(f"{tables}/scratch/in/*.parquet")) > 2, first


def test_tsv_files_are_of_bounded_length(spark, tables, monkeypatch):
    monkeypatch.setattr(streams, "TSV_RECORDS", 10)
    assert sum(r.imported for r in streams.convert_tsv_to_fembed(spark, tables).collect()) == N
    assert len(glob.glob(f"{tables}/scratch/in/*.embed")) >= N // 10


def test_texts_become_python_objects_in_slices():
    seen = []
    column = pa.array(range(2 * tx.ROWS + 1))
    assert tx._in_slices(lambda c: seen.append(len(c)) or c, column).equals(column)
    assert max(seen) == tx.ROWS
    assert len(tx._in_slices(lambda c: c, pa.array([], pa.int64()))) == 0
