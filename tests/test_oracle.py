"""Every registered query with SQL gives the rows that DuckDB gives on the same tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from wareflow.plans import catalog, products, quality, records, registry, retrieval  # noqa: F401
from wareflow.plans.tables import BASE

DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return repr(float(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return "NULL" if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = duck.sql(registry.SQL[name])
    assert sorted(want.columns) == columns
    assert got == sorted(tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall())


@pytest.mark.parametrize("name", ["substitute_edges", "compatibility_edges", "graph_neighbours", "bundle_issues", "bundle_picks", "typo_matches", "related_products", "ranked_search", "bm25_products", "all_terms_products"])
def test_plans_have_no_cartesian(spark, name):
    plan = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_python_only_where_markup_is_parsed(spark):
    for name, make in registry.QUERIES.items():
        if name in ("page_records", "page_scripts"):
            continue
        plan = make(spark, DIR)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "MapInPandas" not in plan and "ArrowEval" not in plan, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "name", "brand", "category", "price_vnd", "stock_status"]
    assert set(e.oracle_sql()) <= set(e.queries())
