"""Roll-ups: run outcomes, histograms, transition counts, thread validation and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcomes that count as success, and as usable.
SUCCEEDED, USABLE = ("success", "no_results"), ("success", "no_results", "incomplete")


def outcome(all_succeeded: Column, any_usable: Column) -> Column:
    """The status of a run; a run without rows succeeded, as nothing in it failed."""
    return F.when(F.coalesce(all_succeeded, F.lit(True)), "succeeded").when(~F.coalesce(any_usable, F.lit(False)), "failed").otherwise("partial")


def run_rollup(observations: DataFrame, run: str = "discovery_run_id", status: str = "status", elapsed: str = "elapsed_ms", requests: str | None = None) -> DataFrame:
    """Per run: rows, status, total elapsed time, and the sum of measured requests, null if none was measured."""
    s = F.col(status)
    measured = F.sum(F.when(F.col(requests) >= 0, F.col(requests))) if requests else F.lit(None).cast("long")
    return observations.groupBy(run).agg(
        F.count("*").alias("attempts"), outcome(F.bool_and(s.isin(*SUCCEEDED)), F.bool_or(s.isin(*USABLE))).alias("run_status"),
        F.sum(F.coalesce(F.col(elapsed), F.lit(0))).cast("long").alias("total_elapsed_ms"), measured.alias("request_count"),
    )


def histogram(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows per group and value, nulls as a value of their own."""
    return df.groupBy(*by, value).agg(F.count("*").alias("n"))


def histogram_map(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per group a map of value to count, sorted by value; counts are made before anything is gathered."""
    counted = histogram(df.where(F.col(value).isNotNull()), by, value)
    return counted.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("counts"))


def by_frequency(df: DataFrame, value: str, order: str) -> DataFrame:
    """Values by falling count; of equal counts the one seen first."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen")


def counter_class(reported: Column, extracted: Column, unresolved: Column) -> Column:
    """How the reported number of comments relates to the extracted ones and to placeholders."""
    delta = reported - extracted
    return F.when(reported.isNull(), "unknown").when(delta == 0, "match").when((delta > 0) & (unresolved >= delta), "within_unresolved_more").when(delta > 0, "exceeds_visible_tree").otherwise("negative_counter_lag")


def visibility(author: Column, body: Column) -> Column:
    gone = F.coalesce(author == "[deleted]", F.lit(False)) | F.coalesce(body == "[deleted]", F.lit(False))
    return F.when(gone, "deleted").when(F.coalesce(body == "[removed]", F.lit(False)), "removed").otherwise("visible")


def transitions(candidates: DataFrame, fetched: DataFrame, discussions: DataFrame) -> DataFrame:
    """Per run: candidates expected, fetched (with any outcome) and normalized, and whether all were fetched."""
    joined = candidates.join(fetched.select("run", "external_id", F.lit(True).alias("was_fetched")), ["run", "external_id"], "left").join(discussions.select("external_id", F.lit(True).alias("was_normalized")), "external_id", "left")
    counted = joined.groupBy("run").agg(F.count("*").alias("expected"), F.count("was_fetched").alias("fetched"), F.count("was_normalized").alias("normalized"))
    return counted.withColumn("complete", F.col("expected") == F.col("fetched"))


def gate(rows: DataFrame, run: str, is_baseline: Column, success: Column, invalid: Column, mismatch: Column, floor: int) -> DataFrame:
    """Per run: baseline successes, invalid trees and mismatches, and whether the run passes."""
    counted = rows.groupBy(run).agg(F.count_if(is_baseline & success).alias("baseline_successes"), F.count_if(invalid).alias("invalid"), F.count_if(mismatch).alias("mismatches"))
    return counted.withColumn("passed", (F.col("baseline_successes") >= floor) & (F.col("invalid") == 0) & (F.col("mismatches") == 0))
