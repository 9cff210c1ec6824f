"""Every registered query next to its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools_check import TABLES, norm

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = norm(QUERIES[name](spark, SF).toPandas())
    if name in SQL:
        want = norm(con.execute(SQL[name]).fetchdf())
        assert list(got.columns) == list(want.columns)
        assert got.equals(want), got.merge(want, how="outer", indicator=True).query("_merge != 'both'").head(10).to_string()
