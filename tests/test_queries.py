"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import oracle
import pytest

from tidelog.plans import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="benchmark tables not here")


@pytest.fixture(scope="module")
def duck():
    con = oracle.connect(SF_DIR)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert oracle.difference(QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) is None


def test_entry_contract(spark):
    import __spark_entry__ as contract

    assert contract.queries().keys() >= contract.oracle_sql().keys()
    assert contract.queries().keys() >= QUERIES.keys()
    assert contract.entry(spark).columns[:3] == ["bucket", "host", "service"]


def test_rollups_are_computed_once_for_all_kinds_of_rules(spark):
    from tidelog.plans import alert_queries

    found = alert_queries._all_tables(spark, SF_DIR)
    for name in ("log_rollup", "endpoint_rollup"):
        assert "Aggregate" not in found[name]._jdf.queryExecution().optimizedPlan().toString()
