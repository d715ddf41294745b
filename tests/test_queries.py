"""Every registered query against its SQL, on the smallest tables."""

import re

import pytest
from conftest import SF, rows

import fieldwise.plans.legal  # noqa: F401  (registers its queries)
from fieldwise.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.toPandas()) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:3] == ["parcel_id", "program_key", "status"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_altered_chains_are_found(spark):
    found = {r["chain"] for r in QUERIES["chain_verify"](spark, SF).collect()}
    assert found and all(int(c[1:]) % 4 == 0 for c in found)


@pytest.mark.parametrize("name", ["results_summary", "decision_failures", "decision_report", "decision_metrics"])
def test_decisions_meet_on_one_row(spark, name):
    """Neither decisions nor cases are dealt out to meet each other; lines are dealt by order and by part, and by nothing else."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert not re.search(r"Join \[.*?(parcel_id|case_id)#", plan)
    assert re.findall(r"(?:ShuffledHashJoin|SortMergeJoin) \[(\w+)#", plan) == ["l_partkey", "l_orderkey", "farmer_id"]
