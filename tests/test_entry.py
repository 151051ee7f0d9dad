from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillmill.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 6) if isinstance(value, float) else value if value is None or isinstance(value, (bool, int, str)) else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = catalogue.queries()[name](spark, SMALL)
    result = con.execute(catalogue.oracle_sql()[name])
    columns = [x[0] for x in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted((tuple(map(plain, r)) for r in result.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert catalogue.queries()[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
