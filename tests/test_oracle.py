"""Every registered query against its SQL, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from brigade.plans import catalogue
from tests import oracle

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SQL = entry.oracle_sql()
QUERIES = {name: fn for name, fn in entry.queries().items() if name in catalogue.QUERIES}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert oracle.compare(df, con, SQL[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas") if w in plan]


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", ["kpi_menu_quadrants", "anomaly_all", "usage_metered", "pos_insights"])
def test_result_does_not_depend_on_partitioning(spark, con, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert oracle.compare(QUERIES[name](spark, SF), con, SQL[name]) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
