"""Each catalogue query against its SQL on DuckDB, and the plans that matter."""

import math
import os

import pytest

import __spark_entry__ as entry
from strata.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio") else v


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cur.description]
    want = cur.fetchall()
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(plain(r[c]) for c in columns) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted((tuple(map(plain, r)) for r in want), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_push_and_prune(spark):
    p = plan(QUERIES["range_half_open"](spark, SF))
    assert "WindowGroupLimit" in p and "ReadSchema" in p and "props" not in p.split("ReadSchema")[1].split("\n")[0]
    assert "WindowGroupLimit" in plan(QUERIES["latest_k_per_prefix"](spark, SF))
    assert "TakeOrderedAndProject" in plan(QUERIES["prefix_limit_map"](spark, SF))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
