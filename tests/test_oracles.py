"""Every registered query against its SQL oracle on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
# Long planners; their promises are checked on small clusters in test_plans.
SLOW = {"pln08_tolerance_sweep_invariants"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


# Queries that SQL cannot state; their own tests hold them against plain versions or count their promises.
NO_ORACLE = {n for n in entry_module.queries() if n.startswith("op") or n == "pipeline"} | {"pln02_repair_placement", "pln07_relocation_plan"}


def test_queries_without_oracle_are_known():
    assert set(entry_module.queries()) - set(entry_module.oracle_sql()) <= NO_ORACLE


@pytest.mark.parametrize("name", sorted(set(entry_module.oracle_sql()) - SLOW))
def test_query(spark, con, name):
    ok, message = compare(spark, con, name, entry_module.queries()[name], entry_module.oracle_sql().get(name), SF)
    assert ok, message


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
