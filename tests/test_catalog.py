"""Every query against its SQL at the smallest scale, and the shape of the registry."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry_module

CORE = [n for n in entry_module.catalog.QUERIES]


def rows(frame):
    frame = frame[sorted(frame.columns)]

    def plain(v):
        if v is None or str(v) in ("<NA>", "nan", "NaT", "None"):
            return "NULL"
        if isinstance(v, (bool, str)):
            return str(v)
        try:
            return repr(round(float(v), 6)) if math.isfinite(float(v)) else str(v)
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(map(plain, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, data, duck, name):
    got = entry_module.queries()[name](spark, data).toPandas()
    assert len(got)
    if name in entry_module.catalog.SQL:
        expected = duck.execute(entry_module.catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)


def test_entry(spark, data):
    df = entry_module.entry(spark)
    assert df.columns == ["list_id", "n", "triples", "transitive", "ndcg", "tau"]
    assert df.count() > 0


def test_sql_has_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_filters_reach_the_scan(spark, data):
    plan = entry_module.queries()["scan_dataset_hub"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(split,heldout)" in plan
    assert "candidates:array" not in plan.split("ReadSchema")[1]
