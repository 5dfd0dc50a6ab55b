"""Typed model tasks over rows: a pluggable function gives fields, rules decide whether they count; every call is recorded.

The function takes pandas Series in and returns a DataFrame with the declared fields and, where it failed, a failure class.
It is marked as not deterministic, so that it runs once for each row and after the cheap filters before it.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.operators.validate import first_rule
from evidra.session import ship

FAILURE = T.StructField("failure_class", T.StringType())


def run_task(df: DataFrame, inputs: list[str], fields: list[T.StructField], function: Callable[..., pd.DataFrame], rules: list[tuple[Column, str]], version: str) -> DataFrame:
    """All rows with the fields, ``failure`` (the function's or the first broken rule's) and ``task_version``.

    Fields of a failed row are null. ``rules`` are (condition of failure, label) on the fields.
    """
    ship(df.sparkSession)
    kind = T.StructType([*fields, FAILURE])

    def call(rows: pd.DataFrame) -> pd.DataFrame:
        made = function(*[rows[c] for c in inputs])
        return made.reindex(columns=kind.fieldNames()).astype(object).where(lambda x: x.notna(), None)

    called = df.withColumn("__out", F.pandas_udf(call, kind).asNondeterministic()(F.struct(*inputs)))
    names = [f.name for f in fields]
    opened = called.select(*df.columns, *[F.col(f"__out.{n}").alias(n) for n in names], F.col("__out.failure_class").alias("__failed"))
    failure = F.coalesce("__failed", first_rule(rules) if rules else F.lit(None).cast("string"))
    judged = opened.withColumn("failure", failure)
    return judged.select(*df.columns, *[F.when(F.col("failure").isNull(), F.col(n)).alias(n) for n in names], "failure", F.lit(version).alias("task_version"))


def not_yet_done(subjects: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Subjects without a recorded result of this task and version: the cheap check before the dear call."""
    return subjects.join(done.select(*key), key, "left_anti")
