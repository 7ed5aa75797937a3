"""Every registered library query against its SQL in DuckDB, over the smallest tables."""

import math
import os

import duckdb
import pytest

from folioforge.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings stories story_tags tag_candidates tags site_tags story_site_tags jobs prompts eval_items".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def compare(spark, data, name, query, oracle):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = query(spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    rel = con.sql(oracle)
    assert sorted(rel.columns) == columns
    want = sorted(tuple(map(plain, r)) for r in con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({oracle}) z").fetchall())
    assert got == want, name


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, data, name):
    compare(spark, data, name, catalogue.queries()[name], catalogue.oracle_sql()[name])


def test_queries_without_sql_run(spark, data):
    for name in sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())):
        assert catalogue.queries()[name](spark, data).count() > 0, name
