from __future__ import annotations

from pathlib import Path

import pytest

from evidra.llm import queries
from tests.oracle import DATA, connection, of_spark, of_sql

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")
SHAPES = {
    "p1_found": ["row_id:bigint"], "p3_found": ["row_id:bigint", "field_name:string", "pii_type:string"], "p6_found": ["campaign_id:string", "opportunity_id:string"],
    "p7_ids": ["doc_id:bigint", "ids:array<int>"], "p9_found": ["doc_id:bigint"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    names, rows = of_spark(df)
    assert len(rows) == len(set(rows)) > 0
    if name in SHAPES:
        assert [f"{c}:{t}" for c, t in df.dtypes] == SHAPES[name]
    if name in queries.SQL:
        assert (names, rows) == of_sql(connection(), queries.SQL[name])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
