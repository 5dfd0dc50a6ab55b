"""All core queries by name."""

from __future__ import annotations

from evidra.plans import evidence, problems, records, runs, sinks, streams

_MODULES = (problems, evidence, streams, records, runs, sinks)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
