"""Rows of a query beside those of its SQL, values as text, floats rounded to six digits."""

from __future__ import annotations

import math
from pathlib import Path

DATA = "/root/testdata/sf0.001"


def shown(value) -> str:
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


def connection():
    import duckdb

    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {path.stem} as from '{path}'")
    return con


def of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    found = con.sql(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted(tuple(shown(r[i]) for i in order) for r in found.fetchall())


def of_spark(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, sorted(tuple(shown(r[n]) for n in names) for r in df.collect())
