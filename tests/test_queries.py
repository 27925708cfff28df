"""Every named query against its DuckDB oracle at the smoke scale, plus plan checks."""

import re

import pytest

import __spark_entry__ as E
from scrubspark import queries
from scrubspark.queries import QUERIES
from tests.oracle_harness import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, QUERIES[name], E.oracle_sql()[name], SF, con)
    assert r["status"] == "match", r


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() == 8
    assert "median" in df.columns


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_category_top_uses_group_limit(spark):
    from scrubspark.queries import analysis

    p = _plan(analysis(spark, SF, "orders").category_top())
    assert "WindowGroupLimit" in p


def test_core_plans_are_native(spark):
    from scrubspark.queries import QUERIES

    for name in ["describe_numeric", "clean_table", "histogram_auto", "category_top10", "normalize_headers", "csv_typing", "date_shapes"]:
        p = _plan(QUERIES[name](spark, SF))
        assert not re.search("Cartesian|Python|Pandas|Arrow", p), name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product_of_tables(spark, name):
    p = _plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in p and "BatchEvalPython" not in p and "BroadcastNestedLoopJoin" not in p, name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_partitioning_changes_nothing(spark, con, name, monkeypatch):
    plain_table, plain_dirty = queries.table, queries.dirty_orders
    monkeypatch.setattr(queries, "table", lambda s, d, t: plain_table(s, d, t).repartition(16))
    monkeypatch.setattr(queries, "dirty_orders", lambda s, d: plain_dirty(s, d).repartition(16))
    # another spelling of the folder, so that shared work is done anew
    r = compare(spark, name, QUERIES[name], E.oracle_sql()[name], SF + "/", con)
    assert r["status"] == "match", r
