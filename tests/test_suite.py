import pytest

import __spark_entry__ as entry
from hearthcheck.demo.views import BASE_TABLES

FOLDER = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["check_id", "table_a", "table_b", "metric", "n"]
    assert frame.count() > 50


@pytest.mark.parametrize(
    "name",
    ["frequency", "crosstab_margins", "duplicates_by_id", "spec_fanout", "fusion", "difference_both", "chk_12", "xck_02",
     "xck_09", "rule_04", "agent_quality", "goal_forecast", "id_search_batch", "passages", "context_carry", "latest_export"],
)
def test_query_agrees_with_its_sql(spark, name):
    from tools.verify import compare

    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    assert compare(entry.queries()[name](spark, FOLDER), entry.oracle_sql()[name], con) == ""


def test_no_python_in_the_audit_and_partial_aggregates_everywhere(spark):
    plan = entry.queries()["audit_full"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
