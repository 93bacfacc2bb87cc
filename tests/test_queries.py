"""Every registered query with SQL gives the same rows in DuckDB; the others run."""

import datetime
import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from newsloom.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = plans.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = Counter(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_query_runs(spark, sf_dir, name):
    assert plans.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["ord", "id", "source_name", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_plans_push_down_and_prune(spark, sf_dir):
    plan = plans.queries()["retention_window"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan and "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    plan = plans.queries()["status_counts"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1]
