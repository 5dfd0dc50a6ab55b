"""First, last and current rows per key, with a total order so that ties never depend on the file order.

Each takes the order as columns; ascending order decides who is first. Rows with a null key form one key of their own, as
in SQL. Empty input gives empty output, and all columns of the input are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PLACE = "__place"


def _nth(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    # A filter on row_number lets Spark drop rows beyond n on each task before the shuffle (WindowGroupLimit), so a hot key stays small.
    placed = df.withColumn(_PLACE, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return placed.where(F.col(_PLACE) <= n).drop(_PLACE)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _nth(df, keys, [F.col(c).asc_nulls_last() for c in order], 1)


def last_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _nth(df, keys, [F.col(c).desc_nulls_last() for c in order], 1)


def top_by(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return _nth(df, keys, order, n)


def ranked_survivors(df: DataFrame, key: str, order: list[str], limit: int) -> DataFrame:
    """First row per key, then a dense ``rank`` over the survivors, up to ``limit``; the ranking is of a bounded report."""
    kept = first_by(df.where(F.col(key).isNotNull()), [key], order)
    return kept.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def second_places(df: DataFrame, scope: str, key: str, order: str) -> DataFrame:
    """For each key that a scope repeats, the place of its second occurrence: duplicates in the order they are noticed."""
    w = Window.partitionBy(scope, key).orderBy(order)
    return df.withColumn(_PLACE, F.row_number().over(w)).where(F.col(_PLACE) == 2).drop(_PLACE)


def current_versions(versions: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per discussion the version with the newest evidence: time, then order, then normalizer, then id.

    ``evidence`` links version ids to seen_at and creation_order; a version without evidence can never be current. The
    choice is made on narrow columns; join the wide record to the result.
    """
    narrow = versions.select("conversation_id", "normalizer_version", F.col("id").alias("version_id")).join(evidence, "version_id")
    best = narrow.groupBy("conversation_id").agg(F.max(F.struct("seen_at", "creation_order", "normalizer_version", "version_id")).alias("best"))
    return best.select("conversation_id", "best.version_id", "best.seen_at", "best.creation_order")


def with_creation_order(df: DataFrame, order: list[str], after: int = 0) -> DataFrame:
    """A stable LONG ``creation_order`` by a total order, above the highest given so far.

    Numbers come from a range partitioning: each partition counts on from the rows of those before it, so no single task
    sees all rows.
    """
    from evidra.session import cut

    ranged = cut(df.repartitionByRange(max(1, df.sparkSession.sparkContext.defaultParallelism), *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__low"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))  # a row per partition
    joined = ranged.join(F.broadcast(before.select("__part", "__low", F.coalesce("__before", F.lit(0)).alias("__before"))), "__part")
    return joined.withColumn("creation_order", F.lit(after) + F.col("__before") + F.col("__at") - F.col("__low") + 1).drop("__part", "__at", "__low", "__before")
