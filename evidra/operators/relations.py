"""Joins of evidence tables: lookups, presence, audits, positional and multi-way joins. Spark picks the physical strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inbox(opportunities: DataFrame, analyses: DataFrame, current: DataFrame, workspace: Column | None = None, campaign: str | None = None, status: str | None = None) -> DataFrame:
    """Opportunities with the analysis they rest on and the discussion's record; optional filters only where given.

    All three are unique in their ids. Filters apply before the joins, so they reach the scans.
    """
    rows = opportunities
    if workspace is not None:
        rows = rows.where(F.col("workspace_id") == workspace)
    if campaign is not None:
        rows = rows.where(F.col("campaign_id") == campaign)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    facts = analyses.withColumnRenamed("id", "analysis_id").drop("campaign_id", "conversation_id", "creation_order", "created_at")
    return rows.join(facts, "analysis_id").join(current, "conversation_id", "left")


def present(df: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key the other side has (EXISTS)."""
    return df.join(others.select(*on), on, "left_semi")


def absent(df: DataFrame, others: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key the other side has not (NOT EXISTS); rows with a null key are absent by definition."""
    return df.join(others.select(*on), on, "left_anti")


def lookup(df: DataFrame, names: DataFrame, key: str, value: str, fallback: Column, out: str) -> DataFrame:
    """A name for a key, or the fallback where the key is unknown."""
    return df.join(names.select(key, F.col(value).alias("__found")), key, "left").withColumn(out, F.coalesce("__found", fallback)).drop("__found")


def mismatched_owners(children: DataFrame, parents: DataFrame, on: str, owner: str) -> DataFrame:
    """Child rows whose parent belongs to another owner: an equi-join with an unequal residual."""
    c, p = children.alias("c"), parents.alias("p")
    return c.join(p, F.col(f"c.{on}") == F.col(f"p.{on}")).where(F.col(f"c.{owner}") != F.col(f"p.{owner}")).select("c.*", F.col(f"p.{owner}").alias("parent_owner"))


def unresolved_targets(rows: DataFrame, kind: str, target: str, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows that name a target by kind and id which does not exist, or a kind that is unknown."""
    known = None
    for name, (df, key) in tables.items():
        part = df.select(F.lit(name).alias(kind), F.col(key).cast("string").alias(target))
        known = part if known is None else known.unionByName(part)
    return rows.join(known, [kind, target], "left_anti")


def zipped(left: DataFrame, right: DataFrame, on: list[str], ordinal: str) -> DataFrame:
    """Rows paired by their place within a group, unpaired ones kept: a positional join on an explicit ordinal."""
    return left.join(right, [*on, ordinal], "full")


def referential(children: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Child rows with a key that no parent has, nulls apart."""
    return children.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")
