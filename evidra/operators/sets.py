"""Set operations on columns and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tidy_list(c: Column) -> Column:
    """Trimmed, blanks dropped, repeats dropped, the first of each kept in its place."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != ""))


def same_members(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.select(*on).distinct().join(b.select(*on), on, "left_anti")


def pooled(*parts: DataFrame) -> DataFrame:
    """All rows of all parts by column name; columns that a part lacks are null."""
    first, *rest = parts
    for p in rest:
        first = first.unionByName(p, allowMissingColumns=True)
    return first
