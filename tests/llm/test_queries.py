"""Registered queries and the pipeline of the operators on the smallest tables."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_operators import clash

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert 0 < docs.count() <= before
        before = docs.count()


@pytest.mark.parametrize("i", range(5))
def test_stages_take_odd_tables(spark, i):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    stage = corpus_pipeline.STAGES[i][1]
    rows = [(1, None, None, None, None), (None, "the of and. to the in", "en", "s", 3), (2, "", "en", None, 0), (3, "the of and", "en", "s", 9), (3, "the of and", "en", "s", 9)]
    got = {r.doc_id for r in stage(spark, spark.createDataFrame(rows, schema), SF).collect()}
    assert 3 in got
    assert stage(spark, spark.createDataFrame([], schema), SF).count() == 0
    extra = clash(spark.createDataFrame(rows, schema))
    out = stage(spark, extra, SF)
    if i < 4:
        assert out.columns == extra.columns
        assert all(r[c] == "x" for r in out.collect() for c in out.columns[5:])
    else:
        assert out.count() == len(rows)


def test_one_row_of_a_class_stays(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    text, other = (" ".join(f"{w}{i}" for i in range(40)) for w in "ab")
    rows = [(7, text), (7, text), (None, text), (None, text), (9, other), (7, other), (8, text), (None, None), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], schema)
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted([(7, text), (7, other), (5, None), (None, None)], key=key)
