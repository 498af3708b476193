"""Every registered query: same rows as its SQL text, and a plan that scales."""

import duckdb
import pytest

import __spark_entry__ as registered
from check import compare
from tidekeep import registry
from tidekeep.fixtures import TABLES

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(registry.queries())

# Digests, file listings and keyed state are the only places where Python runs.
PYTHON = {"schema_fingerprint", "artifact_digests", "verify_copy", "snapshot_tables", "alert_stream", "stale_series",
          "live_progress", "verify_artifacts", "missing_run_folders"}
# Each gathers the first n rows of a table, n being the parameter.
TOP_ROWS = {"sample_row_hashes", "verify_copy", "head_by_key", "snapshot_tables"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def plans():
    return {}


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, con, plans, name):
    def build(session, folder):
        df = registered.queries()[name](session, folder)
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return df

    text, good = compare(spark, con, FOLDER, name, build, registered.oracle_sql().get(name))
    assert good, text
    plan = plans[name]
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    if name not in PYTHON:
        assert "InArrow" not in plan and "InPandas" not in plan
    if name not in TOP_ROWS:
        assert "Exchange SinglePartition" not in plan


def test_every_query_has_a_sql_text():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_entry(spark):
    df = registered.entry(spark)
    assert df.count() > 0 and "final_outcome" in df.columns


def test_filters_and_columns_reach_the_scan(spark):
    plan = registered.queries()["run_by_id"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderkey,7)" in plan
    plan = registered.queries()["run_rollup"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string>" in plan


def test_table_counts_read_no_column(spark):
    plan = registered.queries()["table_row_counts"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("ReadSchema: struct<>" in line for line in scans)


@pytest.mark.parametrize("name", ["recent_runs", "tail_lines", "ownership_drift"])
def test_top_rows_are_cut_before_the_shuffle(spark, name):
    plan = registered.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # before and after the exchange
