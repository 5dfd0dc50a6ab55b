"""Measures of ranked results and runs: precision, gain, latency, overlap, change over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def precision_at(df: DataFrame, group: str, rank: str, relevant: Column, k: int) -> DataFrame:
    """The share of relevant rows among the first k places; missing places count as not relevant."""
    return df.where(F.col(rank) <= k).groupBy(group).agg((F.count_if(relevant) / F.lit(k)).alias("precision"))


def ndcg_at(df: DataFrame, group: str, rank: str, gain: str, k: int) -> DataFrame:
    """Discounted gain of the first k places over that of the best order."""
    ideal = df.withColumn("__ideal", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(gain), rank)))
    sums = ideal.groupBy(group).agg(F.sum(F.when(F.col(rank) <= k, F.col(gain) / F.log2(F.col(rank) + 1))).alias("dcg"), F.sum(F.when(F.col("__ideal") <= k, F.col(gain) / F.log2(F.col("__ideal") + 1))).alias("best"))
    return sums.select(group, F.when(F.col("best") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("best")).otherwise(0.0).alias("ndcg"))


def latency(df: DataFrame, group: str, value: str) -> DataFrame:
    """Exact median and 95th percentile."""
    return df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.expr(f"percentile({value}, 0.5)").alias("median"), F.expr(f"percentile({value}, 0.95)").alias("p95"))


def overlap(df: DataFrame, provider: str, item: str) -> DataFrame:
    """Per provider its items, and those that other providers have too. Counts come from one pass over distinct pairs."""
    pairs = df.select(provider, item).where(F.col(item).isNotNull()).distinct()
    shared = pairs.groupBy(item).agg(F.count("*").alias("__providers"))
    return pairs.join(shared, item).groupBy(provider).agg(F.count("*").alias("items"), F.count_if(F.col("__providers") > 1).alias("shared_items"))


def seen_range(df: DataFrame, key: str, at: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("times_seen"))


def trend(df: DataFrame, group: str, period: str) -> DataFrame:
    """Rows per group and period with the change against the period before."""
    counted = df.groupBy(group, period).agg(F.count("*").alias("n"))
    return counted.withColumn("delta", F.col("n") - F.lag("n").over(Window.partitionBy(group).orderBy(period)))
