"""Every named query of the library against its SQL on the smallest tables."""

import glob
import math

import duckdb
import pytest

from factlode import plans

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows(columns, records):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in records)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {path.rsplit('/', 1)[1][:-8]} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(plans.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(columns, cursor.fetchall())


def test_trace_paths_over_repeated_lines_and_many_orders(spark, tmp_path):
    # both lines of order 9999 have one number and part; the best of 2100 orders have the last names
    made = {
        "customer": "select 1::bigint c_custkey, 5.0 c_acctbal",
        "orders": "select i o_orderkey, 1::bigint o_custkey, case when i < 9990 then 'P' else 'F' end o_orderstatus, '5-LOW' o_orderpriority from range(7900, 10000) r(i)",
        "lineitem": "select 9999::bigint l_orderkey, 1::bigint l_partkey, 3 l_linenumber, 5.0 l_quantity, 0.0 l_discount, 'A' l_returnflag from range(2)",
        "part": "select 1::bigint p_partkey, 9 p_size",
    }
    con = duckdb.connect()
    for name, sql in made.items():
        con.execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet' (format parquet)")
        con.execute(f"create view {name} as from '{tmp_path}/{name}.parquet'")
    df = plans.QUERIES["trace_paths"](spark, str(tmp_path))
    cursor = con.execute(plans.ORACLES["trace_paths"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cursor.description], cursor.fetchall())


def test_range_merge_without_times_and_with_copies(spark, tmp_path):
    t = ["null", "null", "timestamp '2024-01-01 00:01:30.5'", "timestamp '2024-01-01 00:07:00'", "timestamp '2024-01-01 00:14:00'", "timestamp '2024-01-01 00:14:59'"]
    con = duckdb.connect()
    con.execute(f"copy (select unnest([1, 1, 1, 1, 1, 1, 2, null])::bigint user_id, unnest([{', '.join(t)}, null, {t[2]}])::timestamp ts) to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as from '{tmp_path}/events.parquet'")
    df = plans.QUERIES["range_merge"](spark, str(tmp_path))
    cursor = con.execute(plans.ORACLES["range_merge"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cursor.description], cursor.fetchall())


def test_every_query_has_sql_or_is_known():
    assert set(plans.QUERIES) - set(plans.ORACLES) == {"html_blocks", "gap_detection"}


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
