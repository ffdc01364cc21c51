"""Every query of the workload against its SQL counterpart."""

import math

import duckdb
import pytest

from trellisgraph import scenarios, workload

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def oracle(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


QUERIES, SQL = workload.queries() | scenarios.queries(), workload.oracle_sql() | scenarios.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, small, oracle, name):
    df = QUERIES[name](spark, small)
    wanted = oracle.sql(SQL[name])
    assert sorted(df.columns) == sorted(wanted.columns)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(plain(v) for v in r) for r in wanted.select(*columns).fetchall()), key=str)


def test_flagship_reads_only_what_it_needs(spark, small):
    plan = workload.queries()["flagship"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,100000.0)" in plan and "TakeOrderedAndProject" in plan and "c_acctbal" not in plan
