import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from recordloom.plans import document_queries, fleet_queries, record_queries, repository_queries, table_queries

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


MODULES = (table_queries, record_queries, repository_queries, fleet_queries, document_queries)


@pytest.mark.parametrize("module, name", [(m, n) for m in MODULES for n in sorted(m.QUERIES)])
def test_same_rows_as_sql(spark, db, module, name):
    mine = module.QUERIES[name](spark, str(DATA))
    theirs = db.sql(module.SQL[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    at = [theirs.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(r) for r in mine.select(*columns).collect()))) == sorted(str(tuple(r[i] for i in at)) for r in theirs.fetchall())


def test_entry_has_rows_and_a_stable_schema(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["repo_id", "path", "message", "rule_id", "subject"] and df.count() > 0


def test_every_query_has_a_sql_or_is_known_to_have_none():
    for m in MODULES:
        assert set(m.QUERIES) == set(m.SQL)


@pytest.mark.parametrize("name", sorted(table_queries.QUERIES))
def test_no_plan_compares_all_rows_with_all(spark, name):
    plan = table_queries.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
