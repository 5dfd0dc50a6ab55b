"""Every query on the smallest data: like its SQL, and by a plan without products of tables."""

from __future__ import annotations

from pathlib import Path

import pytest

from evidra.plans import catalog
from tests.oracle import DATA, connection, of_spark, of_sql

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    got = of_spark(df)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    if name in catalog.SQL:
        assert got == of_sql(con, catalog.SQL[name])


def test_windows_are_limited_before_the_shuffle_and_scans_are_narrow(spark):
    plan = catalog.QUERIES["k1_inbox"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "row_number(), 1, Partial" in plan and "rationale" not in plan and "normalized_content" not in plan
    plan = catalog.QUERIES["order_page"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,500)" in plan
