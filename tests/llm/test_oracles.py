"""Queries with SQL against DuckDB on the smallest tables."""

import glob

import duckdb
import pytest

from factlode.llm import queries

SF = "/root/testdata/sf0.001"


def rows(columns, records):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([round(r[i], 8) if isinstance(r[i], float) else r[i] for i in order]) for r in records)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {path.rsplit('/', 1)[1][:-8]} as select * from read_parquet('{path}')")
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, cursor.fetchall())


def test_ten_queries():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
