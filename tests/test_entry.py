from __future__ import annotations

import re
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark):
    queries, sql = e.queries(), e.oracle_sql()
    assert {"p2_found", "p4_found", "p5_found", "k1_inbox"} <= queries.keys() and sql.keys() <= queries.keys()
    if Path("/root/testdata/sf0.001").exists():
        assert e.entry(spark).count() == 50


def test_nothing_else_imports_the_llm_package():
    for path in [*ROOT.glob("evidra/**/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts and path.exists():
            assert not re.search(r"(?:from|import)\s+evidra\.llm", path.read_text()), path


def test_found_queries_have_their_columns(spark):
    data = "/root/testdata/sf0.001"
    if Path(data).exists():
        shapes = {"p2_found": ["snapshot_no:int", "conversation_id:string", "change_kind:string"], "p4_found": ["owner:string", "owner_key:bigint", "node_kind:string", "node_id:string", "parent_id:string", "pos:int"], "p5_found": ["id:string", "root_id:string", "real_depth:int", "state:string"]}
        for name, columns in shapes.items():
            df = e.queries()[name](spark, data)
            assert [f"{c}:{t}" for c, t in df.dtypes] == columns and df.count() == df.distinct().count()
