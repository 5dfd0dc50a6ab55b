from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.llm.topn import _Best, top_n

SCHEMA = "g string, item string, s double, t long, grp string, score string, low string"


def brute(rows, n):
    groups = {}
    for g, item, s, t, *_ in rows:
        if g is not None and item is not None and s is not None and s == s:
            groups.setdefault(g, []).append((-s, -(t if t is not None else -(2**63)), item))
    return {(g, x[2], k) for g, xs in groups.items() for k, x in enumerate(sorted(xs)[:n], 1)}


def made(seed, size=3000):
    r = random.Random(seed)
    return [(r.choice(["hot"] * 6 + [f"g{r.randrange(200)}", None]), f"i{k:05d}" if r.random() < 0.99 else None, r.choice([0.5, 0.5, 1.0, r.random(), None, float("nan"), float("inf"), -1.0]), r.choice([None, 1, 2, k]), "x", "x", "x") for k in range(size)]


@pytest.mark.parametrize(("seed", "parts", "n"), [(1, 1, 3), (2, 8, 3), (3, 5, 1), (4, 3, 50)])
def test_like_brute_force(spark, seed, parts, n):
    rows = made(seed)
    got = top_n(spark.createDataFrame(rows, SCHEMA).repartition(parts), "g", "item", "s", "t", n)
    assert {(r["grp"], r["item"], r["place"]) for r in got.collect()} == brute(rows, n)


def test_empty_and_small(spark):
    df = spark.createDataFrame(made(5, 4), SCHEMA)
    assert top_n(df.where("false"), "g", "item", "s", "t", 3).count() == 0
    assert {(r["grp"], r["item"], r["place"]) for r in top_n(df, "g", "item", "s", "t", 3).collect()} == brute(made(5, 4), 3)


def test_all_scores_equal_leaves_few_survivors(spark):
    df = spark.range(0, 20_000, 1, 4).select(F.lit("g").alias("g"), F.col("id").cast("string").alias("item"), F.lit(1.0).alias("s"), F.col("id").alias("t"))
    got = top_n(df, "g", "item", "s", "t", 3)
    assert [r["item"] for r in got.orderBy("place").collect()] == ["19999", "19998", "19997"]


def test_bounds_hold_little_and_are_valid():
    best = _Best(3)
    r = np.random.default_rng(1)
    scores = r.random(5000)
    for k in range(0, 5000, 500):
        best.add(["a"] * 250 + ["b"] * 250, scores[k : k + 500], np.arange(500))
    best.bounds()  # sorts in what waits
    assert len(best.group) == 6
    names, low, _ = best.bounds()
    assert names == ["a", "b"]
    a = np.sort(np.concatenate([scores[k : k + 250] for k in range(0, 5000, 500)]))[-3]
    assert low[0] == a


def test_many_groups_take_one_pass():
    import time

    import numpy as np

    from evidra.llm.topn import _Best

    r = np.random.default_rng(1)
    group, score = r.integers(0, 300_000, 1_000_000), r.random(1_000_000)
    best, began = _Best(3), time.perf_counter()
    for i in range(0, 1_000_000, 10_000):
        best.add([str(g) for g in group[i : i + 10_000]], score[i : i + 10_000], np.zeros(10_000, np.int64))
    best.bounds()
    assert time.perf_counter() - began < 6
