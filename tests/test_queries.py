"""Every query with SQL against DuckDB on the smallest tables; every other one runs and has a schema."""

import duckdb
import pytest

import __spark_entry__ as entry
from skarn.plans import registry
from skarn.plans.compare import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    said = compare(spark, con, SF, registry.QUERIES[name], registry.ORACLES.get(name))
    assert said.startswith("equal" if name in registry.ORACLES else "rows"), said


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5


def test_top_k_and_pushdown_in_the_plan(spark):
    from skarn.plans import fixtures as fx
    from skarn.plans.search import vector_topk

    plan = vector_topk(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan
    plan = fx.table(spark, SF, "documents").where("doc_id = 5").select("doc_id", "lang")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
