from __future__ import annotations

import random

from evidra.llm.mixing import apportion, mix, source_key
from pyspark.sql import functions as F

TARGETS = [("a_b", 0.5, 1), ("c", 0.3, 3), ("d", 0.2, 2), ("none", 0.1, 2), ("zero", 0.0, 2), ("null", None, None)]


def rows(seed=1):
    r = random.Random(seed)
    names = {"A-b": 500, " a_b": 100, "C": 120, "d ": 90, "other": 50, None: 20, "zero": 10, "null": 5}
    out, k = [], 0
    for name, n in names.items():
        for _ in range(n):
            out.append((k, name, r.choice([0, None, 5, 20, 60, r.randrange(1, 300)]), "x"))
            k += 1
    return [*out, (k, "c", 5000, "x")]


def test_apportion_is_sainte_lague():
    assert apportion({"a": 53, "b": 24, "c": 23}, {"a": 99, "b": 99, "c": 99}, 7) == {"a": 3, "b": 2, "c": 2}
    assert apportion({"a": 1, "b": 1}, {"a": 1, "b": 99}, 6) == {"a": 1, "b": 5}
    assert apportion({"a": 1, "b": 0}, {"a": 2, "b": 5}, 9) == {"a": 2, "b": 0}
    assert apportion({}, {}, 3) == {}


def run(spark, data, targets=TARGETS, **more):
    df = spark.createDataFrame(data, "id long, name string, n long, source string")
    return mix(df, "id", "name", "n", targets, **more)


def test_shares_and_caps(spark):
    mixed, report = run(spark, rows())
    got = {r["source"]: r for r in report.collect()}
    used = {r["id"]: r for r in mixed.collect()}
    assert abs(got["a_b"]["actual_share"] - 0.5) < 0.02 and abs(got["c"]["actual_share"] - 0.3) < 0.02 and abs(got["d"]["actual_share"] - 0.2) < 0.02
    assert got["none"]["actual_share"] == got["zero"]["actual_share"] == got["null"]["actual_share"] == 0
    cap = {n: r for n, _, r in TARGETS}
    assert all(1 <= r["times_used"] <= cap[r["source"]] for r in used.values())
    assert sum(r["tokens"] * r["times_used"] for r in used.values()) == sum(r["used_tokens"] for r in got.values())
    assert all(r["used_tokens"] <= r["quota_tokens"] for r in got.values())


def test_file_order_and_seed(spark):
    data = rows()
    a = sorted(map(tuple, run(spark, data)[0].collect()))
    b = sorted(map(tuple, run(spark, random.Random(5).sample(data, len(data)))[0].collect()))
    c = sorted(map(tuple, run(spark, data, seed=8)[0].collect()))
    assert a == b != c


def test_size_and_nothing(spark):
    _, report = run(spark, rows(), size=2000)
    assert 1500 <= sum(r["used_tokens"] for r in report.collect()) <= 2000
    mixed, report = run(spark, [])
    assert mixed.count() == 0 and report.count() == len(TARGETS)


def test_source_names(spark):
    df = spark.createDataFrame([(" Thread_Comment ",), ("thread-comment",), ("thread comment",), (None,)], "s string")
    assert [r[0] for r in df.select(source_key(F.col("s"))).collect()] == ["thread_comment"] * 3 + [None]
