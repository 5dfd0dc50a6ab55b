"""Sinks: append once, merge by copy, keyed receipts, content-addressed publishing, reports. Nothing is updated in place."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators.dedupe import first_by


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def new_rows(rows: DataFrame, existing: DataFrame | None, keys: list[str], order: list[str]) -> DataFrame:
    """Rows whose key is not recorded yet, the first of each key: writing them again adds nothing."""
    fresh = first_by(rows, keys, order)
    return fresh if existing is None else fresh.join(existing.select(*keys), keys, "left_anti")


def append_once(rows: DataFrame, path: str, keys: list[str], order: list[str]) -> None:
    """Append what is new to a parquet table; a replay of the same rows is a no-op. One writer at a time."""
    spark = rows.sparkSession
    existing = spark.read.parquet(path) if _exists(spark, path) else None
    new_rows(rows, existing, keys, order).write.mode("append").parquet(path)


def get_or_create(rows: DataFrame, existing: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Every requested row with ``created`` (it is new) and ``conflict`` (it is there with other values)."""
    kept = existing.select(key, *[F.col(c).alias("__old_" + c) for c in same], F.lit(True).alias("__there"))
    joined = rows.join(kept, key, "left")
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.col("__old_" + c))
    return joined.select(*rows.columns, F.col("__there").isNull().alias("created"), (F.col("__there").isNotNull() & differs).alias("conflict"))


def merged(old: DataFrame, new: DataFrame, keys: list[str], replaced: list[str], defaults: dict[str, Column]) -> DataFrame:
    """The table after a merge: new keys get defaults, known keys take only the ``replaced`` columns, the rest is kept."""
    o = old.select(*keys, *[F.col(c).alias("__o_" + c) for c in old.columns if c not in keys], F.lit(True).alias("__o"))
    n = new.select(*keys, *[F.col(c).alias("__n_" + c) for c in replaced], F.lit(True).alias("__n"))
    both = o.join(n, keys, "full")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.col(c))
        elif c in replaced:
            out.append(F.when(F.col("__n"), F.col("__n_" + c)).otherwise(F.col("__o_" + c)).alias(c))
        else:
            out.append(F.when(F.col("__o"), F.col("__o_" + c)).otherwise(defaults.get(c, F.lit(None))).alias(c))
    return both.select(*out)


def swap_in(df: DataFrame, path: str) -> None:
    """Replace a table by copy: write beside it, then put it in its place. Never reads and overwrites the same files.

    A table that is not there yet appears in one rename. One that is there is replaced by two: should the second fail, the old
    table is put back, and a reader between them finds it under ``<path>.old`` (see ``stored``).
    """
    spark = df.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(beside)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (beside, path, path + ".old"))
    fs = target.getFileSystem(conf)
    there = fs.exists(target)
    if there:
        fs.delete(old, True)
        fs.rename(target, old)
    if not fs.rename(source, target):
        if there:
            fs.rename(old, target)
        raise OSError(f"{path} could not be replaced")
    fs.delete(old, True)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``swap_in``, also while it is being replaced."""
    return spark.read.parquet(path if _exists(spark, path) else path + ".old")


def receipts(requests: DataFrame, stored: DataFrame, keys: list[str], fingerprint: str, response: str) -> DataFrame:
    """For each keyed write: new, replay, conflict (another fingerprint) or unfinished (no response stored yet)."""
    kept = stored.select(*keys, F.col(fingerprint).alias("__f"), F.col(response).alias("__r"), F.lit(True).alias("__there"))
    decision = F.when(F.col("__there").isNull(), "new").when(~F.col(fingerprint).eqNullSafe(F.col("__f")), "conflict").when(F.col("__r").isNull(), "unfinished").otherwise("replay")
    return requests.join(kept, keys, "left").select(*requests.columns, decision.alias("decision"), F.when(decision == "replay", F.col("__r")).alias("stored_response"))


def publish(df: DataFrame, folder: str, digest: str) -> str:
    """Content-addressed: the folder is named by the digest; what is there already is left alone."""
    spark = df.sparkSession
    target = f"{folder}/{digest}"
    if not _exists(spark, target):
        swap_in(df, target)
    return target


def write_tsv(df: DataFrame, path: str) -> None:
    df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value")).write.mode("append").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object per row; fails if the target exists, so that evidence is never overwritten."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("errorifexists").text(path)


def backfilled(df: DataFrame, column: str, *sources: tuple[Column, DataFrame, str, str]) -> DataFrame:
    """A null column filled by conditional lookups: (condition, table, its key, its value), the key being ``target_id``."""
    out, values = df, [F.col(column)]
    for i, (condition, table, key, value) in enumerate(sources):
        name = f"__v{i}"
        out = out.join(table.select(F.col(key).alias("target_id"), F.col(value).alias(name)), "target_id", "left")
        values.append(F.when(condition, F.col(name)))
    return out.withColumn(column, F.coalesce(*values)).drop(*[f"__v{i}" for i in range(len(sources))])
