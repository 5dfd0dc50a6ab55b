"""Top-k and keyset pages. A page never counts or skips: it filters by the cursor's position and reads one row more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.ids import decode_cursor, encode_cursor

MOST, DEFAULT = 200, 50


def clamp(limit: int | None) -> int:
    return DEFAULT if limit is None else max(1, min(MOST, limit))


def top_k(df: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    """The first rows by a total order: TakeOrderedAndProject, no full sort."""
    return df.orderBy(*order).limit(clamp(limit))


def page(df: DataFrame, order: str, namespace: str, cursor: str | None = None, limit: int | None = None, descending: bool = False) -> DataFrame:
    """A page with ``next_cursor`` on its last row if there is more, else null."""
    size = clamp(limit)
    c = F.col(order)
    if cursor is not None:
        at = decode_cursor(namespace, cursor)
        df = df.where(c < at if descending else c > at)
    ahead = df.orderBy(c.desc() if descending else c.asc()).limit(size + 1)
    from pyspark.sql import Window

    w = Window.orderBy(c.desc() if descending else c.asc())  # over at most size + 1 rows
    placed = ahead.withColumn("__at", F.row_number().over(w)).withColumn("__more", F.lead(F.lit(True)).over(w))
    token = F.when((F.col("__at") == size) & F.col("__more"), encode_cursor(F.lit(namespace), c))
    return placed.where(F.col("__at") <= size).withColumn("next_cursor", token).drop("__at", "__more")
