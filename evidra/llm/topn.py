"""The N best items of every group, by partition lower bounds.

The N-th best key of a group within any one partition is a lower bound of its N-th best key overall. Each partition keeps
at most N keys per group while it streams; the largest bound of each group is joined back to drop rows below it. What
survives is at most N rows per group and partition, however many millions of items the group has, and only that is ranked.

The key is (score, tie) in descending order, then the item ascending, so equal scores are settled the same way each time.
Defined cases: rows with a null group or item, and null or NaN scores take no part; groups with fewer than N items give
what they have; of repeated rows of an item all count, so make items unique before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.session import cut, join_small, map_arrow


#: At least so many rows wait for a sort.
LEAST_WAITING = 50_000


class _Best:
    """The n best (score, tie) of each group seen so far, in flat arrays.

    New rows wait until there are as many of them as rows held, and are then sorted in once: each row takes part in a
    number of sorts that grows with the logarithm of the rows, however many groups there are.
    """

    def __init__(self, n: int):
        self.n, self.numbers = n, {}
        self.group, self.score, self.tie = (np.empty(0, t) for t in (np.int64, np.float64, np.int64))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.count = 0

    def add(self, groups: list[str], score: np.ndarray, tie: np.ndarray) -> None:
        numbers = self.numbers
        number = np.fromiter((numbers.setdefault(g, len(numbers)) for g in groups), np.int64, len(groups))
        self.waiting.append((number, score, tie))
        self.count += len(number)
        if self.count >= max(LEAST_WAITING, len(self.group)):
            self._sort_in()

    def _sort_in(self) -> None:
        if not self.waiting:
            return
        g, s, t = (np.concatenate(x) for x in zip((self.group, self.score, self.tie), *self.waiting))
        self.waiting, self.count = [], 0
        order = np.lexsort((~t, -s, g))  # ~t falls as t rises and cannot overflow
        g, s, t = g[order], s[order], t[order]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
        keep = place < self.n
        self.group, self.score, self.tie, self.place = g[keep], s[keep], t[keep], place[keep]

    def bounds(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Groups with n rows here, and their n-th best key."""
        self._sort_in()
        if not len(self.group):
            return [], self.score, self.tie
        last = self.place == self.n - 1
        names = list(self.numbers)
        return [names[x] for x in self.group[last]], self.score[last], self.tie[last]


def _bounds(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(n)
        for b in batches:
            if b.num_rows:
                best.add(b.column("grp").to_pylist(), b.column("score").to_numpy(), b.column("tie").to_numpy())
        groups, score, tie = best.bounds()
        yield pa.RecordBatch.from_pydict({"grp": pa.array(groups, pa.string()), "low_score": score, "low_tie": tie})

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, tie: str, n: int) -> DataFrame:
    """Columns grp, item, score, tie and place (from 1) of the n best items of each group."""
    rows = cut(df.select(F.col(group).cast("string").alias("grp"), F.col(item).cast("string").alias("item"), F.col(score).cast("double").alias("score"), F.coalesce(F.col(tie).cast("long"), F.lit(-(2**63))).alias("tie")).where("grp IS NOT NULL AND item IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)"))
    local = map_arrow(rows.select("grp", "score", "tie"), _bounds(n), "grp string, low_score double, low_tie long")
    low = cut(local.groupBy("grp").agg(F.max(F.struct("low_score", "low_tie")).alias("low")))
    joined = join_small(rows, low, ["grp"], "left", low.count())
    survivors = joined.where(F.col("low").isNull() | (F.struct(F.col("score").alias("low_score"), F.col("tie").alias("low_tie")) >= F.col("low")))
    ranked = survivors.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score"), F.desc("tie"), "item")))
    return ranked.where(F.col("place") <= n).select("grp", "item", "score", "tie", "place")
