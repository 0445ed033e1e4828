"""Every registered query against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from rowtide.plans.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    assert name in SQL, "every query here has SQL"
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    rows = Counter(tuple(r) for r in df.select(sorted(df.columns)).collect())
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert rows == Counter(tuple(r[i] for i in order) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["seq", "trx_id", "sql"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_filters_and_stay_in_the_jvm(spark, sf_dir):
    """Statements are rendered without Python; scans read the columns that are used; no task sees the whole feed in order."""
    plan = QUERIES["x24_update"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "l_" not in plan.split("ReadSchema")[-1] and "o_custkey" not in plan.split("ReadSchema")[-1]
    plan = QUERIES["f5_stop_takewhile"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
