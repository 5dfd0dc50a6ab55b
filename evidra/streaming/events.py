"""Progress events as a stream: parsed, scoped, deduplicated, appended exactly once, completed and timed out.

Lateness is decided by the state of a run, not by event time, so no watermark drops rows; state that grows without bound is
avoided by keeping what was emitted in a table and looking there (``foreachBatch`` with an anti-join).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidra.sources.writers import append_once

ENVELOPE = "id string, type string, run_id string, workspace_id string, correlation_id string, occurred_at string, payload string"


def parsed(lines: DataFrame, value: str, types: list[str]) -> DataFrame:
    """Well-formed events of known types; malformed lines are dropped and the stream goes on."""
    event = F.from_json(F.col(value), ENVELOPE)
    rows = lines.select(event.alias("e")).select("e.*")
    return rows.where(F.col("id").isNotNull() & F.col("run_id").isNotNull() & F.col("workspace_id").isNotNull() & F.col("type").isin(types))


def scoped(events: DataFrame, workspace: str, run: str, correlation: str | None = None) -> DataFrame:
    kept = events.where((F.col("workspace_id") == workspace) & (F.col("run_id") == run))
    return kept if correlation is None else kept.where(F.col("correlation_id") == correlation)


def fan_out(observations: DataFrame, order: str, kinds: list[tuple[str, Column]]) -> DataFrame:
    """Events of each observation in a fixed sequence: those whose condition holds, ordered by (order, seq)."""
    events = F.filter(F.array(*[F.when(condition, F.struct(F.lit(i).alias("seq"), F.lit(kind).alias("type"))) for i, (kind, condition) in enumerate(kinds)]), lambda x: x.isNotNull())
    return observations.withColumn("event", F.explode(events)).select("*", "event.seq", "event.type").drop("event")


def append_stream(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str], then: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Rows of a stream appended once per key, also if a batch is delivered again."""

    def batch(df: DataFrame, number: int) -> None:
        append_once(df, path, keys, order)
        if then is not None:
            then(df, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def completions(observations: DataFrame, planned: DataFrame, emitted: DataFrame | None = None) -> DataFrame:
    """Runs all of whose planned queries are recorded, each once: columns run, recorded, planned.

    ``observations`` has run and query_id, ``planned`` run and query_id.
    """
    recorded = observations.select("run", "query_id").distinct().join(planned, ["run", "query_id"], "left_semi").groupBy("run").agg(F.count("*").alias("recorded"))
    expected = planned.groupBy("run").agg(F.count("*").alias("planned"))
    done = expected.join(recorded, "run", "left").where(F.coalesce("recorded", F.lit(0)) >= F.col("planned"))
    return done if emitted is None else done.join(emitted.select("run"), "run", "left_anti")


def accepted(arrivals: DataFrame, runs: DataFrame, terminal: list[str]) -> DataFrame:
    """Arrivals with ``decision``: already_done for discovery rows of a run that ended, else accepted. Fetches may come late."""
    state = runs.select("run", F.col("status").alias("__status"))
    late = F.coalesce(F.col("__status").isin(terminal), F.lit(False)) & (F.col("capability") == "discovery")
    return arrivals.join(state, "run", "left").withColumn("decision", F.when(late, "already_done").otherwise("accepted")).drop("__status")


def stale(runs: DataFrame, as_of: Column, idle_seconds: int) -> DataFrame:
    """Running runs that started before the cutoff, as failed and marked as reaped."""
    cutoff = as_of - F.make_interval(secs=F.lit(idle_seconds))
    return runs.where((F.col("status") == "running") & (F.col("started_at") < cutoff)).withColumn("status", F.lit("failed")).withColumn("reaped", F.lit(True))
