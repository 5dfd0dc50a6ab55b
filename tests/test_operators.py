from __future__ import annotations

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidra.operators import dedupe, measures, paging, relations, rollup, sets, validate
from evidra.operators.threads import normalize, normalized_threads


def thread(more=True, **changes):
    """A thread of one comment with one deleted reply, and one placeholder."""
    reply = {"id": "deleted", "name": "t1_deleted", "author": "[deleted]", "score": 0, "depth": 1, "parent_id": "t1_visible", "created_utc": 1700000002, "body": "[deleted]", "replies": ""}
    top = {"id": "visible", "name": "t1_visible", "author": "person", "score": 2, "depth": 0, "parent_id": "t3_post", "created_utc": 1700000001, "body": "Visible reply", "replies": {"data": {"children": [{"kind": "t1", "data": reply}]}}}
    root = {"id": "post", "name": "t3_post", "title": "Example", "author": "op", "score": 5, "upvote_ratio": 0.9, "subreddit_name_prefixed": "r/example", "num_comments": 3, "created_utc": 1700000000, "selftext": "Body", "permalink": "/r/example/comments/post/example/", "is_self": True, "locked": False} | changes
    below = [{"kind": "t1", "data": top}] + ([{"kind": "more", "data": {"id": "more_1", "parent_id": "t3_post", "count": 1, "children": ["unresolved"], "depth": 0}}] if more else [])
    return [{"data": {"children": [{"kind": "t3", "data": root}]}}, {"data": {"children": below}}]


#: The digests of this thread.
FULL, CONTENT = "0bb8007228cbeae0f785a7ba10a54141bdb12aae68c4cd9464ce26def52f6833", "a5131ccc958a17f6bad0819b1e823276019adcf35a7092103c82469e187514b7"


def test_golden_digests(spark):
    record = normalize(thread())
    assert (record["normalizedSha256"], record["normalizedContentSha256"]) == (FULL, CONTENT)
    scored = normalize(thread(score=99, upvote_ratio=0.1, created_utc=1700000000.0))
    assert scored["normalizedContentSha256"] == CONTENT and scored["normalizedSha256"] != FULL
    rows = [(1, json.dumps(thread())), (2, json.dumps({"content": thread(), "path": "x"})), (3, "[]"), (4, None), (5, '[{"data":{}},{}]')]
    got = {r["k"]: r for r in normalized_threads(spark.createDataFrame(rows, "k int, raw string"), "k", "raw").collect()}
    assert got[1]["normalized_sha256"] == got[2]["normalized_sha256"] == FULL and got[1]["counter_class"] == "within_unresolved_more" and not got[1]["exhausted"]
    assert got[3]["problem"] == got[4]["problem"] == "not a two-listing array" and got[5]["problem"] == "no root post"


@pytest.mark.parametrize(("reported", "more", "kind"), [(None, True, "unknown"), (2, True, "match"), (3, True, "within_unresolved_more"), (9, False, "exceeds_visible_tree"), (1, False, "negative_counter_lag"), ("3", True, "unknown")])
def test_counter_classes(spark, reported, more, kind):
    assert normalize(thread(more, num_comments=reported))["validation"]["counterDeltaClass"] == kind
    if not isinstance(reported, str):
        df = spark.createDataFrame([(reported, 2, int(more))], "r int, e int, u int")
        assert df.select(rollup.counter_class(F.col("r"), F.col("e"), F.col("u"))).first()[0] == kind


STATUSES = ["success", "no_results", "incomplete", "blocked", "rate_limited", "auth_required", "forbidden", "upstream_unavailable", "parse_failed", "transport_failed", "runtime_verification_failed", "failed"]


def test_rollup_of_all_statuses(spark):
    rows = [("all", s, 100 * i, 3 * i) for i, s in enumerate(STATUSES, 1)] + [(s, s, None, None) for s in STATUSES]
    df = spark.createDataFrame(rows, "discovery_run_id string, status string, elapsed_ms int, requests int")
    got = {r["discovery_run_id"]: r for r in rollup.run_rollup(df, requests="requests").collect()}
    assert (got["all"]["run_status"], got["all"]["total_elapsed_ms"], got["all"]["request_count"]) == ("partial", 7800, 234)
    for s in STATUSES:
        assert got[s]["run_status"] == ("succeeded" if s in rollup.SUCCEEDED else "partial" if s == "incomplete" else "failed") and got[s]["request_count"] is None
    assert df.where("false").agg(rollup.outcome(F.bool_and(F.lit(True)), F.bool_or(F.lit(True)))).first()[0] == "succeeded"


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_first_and_last_do_not_depend_on_file_order(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([None, "a", "b", "c"]), r.choice([None, 1, 2]), "x") for i in range(60)]
    expected = {"first": {}, "last": {}}
    for k in (None, "a", "b", "c"):
        mine = [x for x in rows if x[1] == k]
        if mine:
            expected["first"][k] = min(mine, key=lambda x: (x[2] is None, x[2] or 0, x[0]))[0]
            expected["last"][k] = max(mine, key=lambda x: (x[2] is not None, x[2] or 0, x[0]))[0]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, k string, o int, extra string").repartition(1 + seed % 5)
    assert {x["k"]: x["i"] for x in dedupe.first_by(df, ["k"], ["o", "i"]).collect()} == expected["first"]
    assert {x["k"]: x["i"] for x in dedupe.last_by(df, ["k"], ["o", "i"]).collect()} == expected["last"]


def test_current_versions_by_evidence(spark):
    versions = spark.createDataFrame([("d", "n1", "v1"), ("d", "n1", "v2"), ("e", "n1", "v3"), ("f", "n1", "v4")], "conversation_id string, normalizer_version string, id string")
    evidence = spark.createDataFrame([("v1", 12, 1), ("v2", 9, 2), ("v1", 3, 3), ("v3", 5, 4)], "version_id string, seen_at int, creation_order int")
    got = {r["conversation_id"]: r["version_id"] for r in dedupe.current_versions(versions, evidence).collect()}
    assert got == {"d": "v1", "e": "v3"}


def test_creation_order_is_dense_and_stable(spark):
    df = spark.range(0, 997, 1, 7).select(F.xxhash64("id").alias("o"), "id")
    a = {r["id"]: r["creation_order"] for r in dedupe.with_creation_order(df, ["o", "id"], 10).collect()}
    b = {r["id"]: r["creation_order"] for r in dedupe.with_creation_order(df.repartition(3), ["o", "id"], 10).collect()}
    assert a == b and sorted(a.values()) == list(range(11, 1008))


def test_pages_reach_every_row_once(spark):
    df = spark.range(1, 24).withColumnRenamed("id", "creation_order")
    for descending in (False, True):
        seen, cursor = [], None
        while True:
            rows = paging.page(df, "creation_order", "n", cursor, 5, descending).orderBy(F.desc("creation_order") if descending else "creation_order").collect()
            seen += [r["creation_order"] for r in rows]
            cursor = rows[-1]["next_cursor"]
            if cursor is None:
                break
        assert seen == sorted(range(1, 24), reverse=descending)
    assert (paging.clamp(None), paging.clamp(0), paging.clamp(999)) == (50, 1, 200)
    assert paging.page(df.where("false"), "creation_order", "n").count() == 0


def test_sets(spark):
    df = spark.createDataFrame([([" b", "a", "b ", "", " "], ["a", "b"])], "x array<string>, y array<string>")
    r = df.select(sets.tidy_list(F.col("x")).alias("t"), sets.same_members(sets.tidy_list(F.col("x")), F.col("y")).alias("s"), sets.same_members(F.col("x"), F.col("y")).alias("n")).first()
    assert (r["t"], r["s"], r["n"]) == (["b", "a"], True, False)
    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,)], "k int")
    assert {r["k"] for r in sets.difference(a, b, ["k"]).collect()} == {1, None}
    assert sets.pooled(a, b.withColumn("z", F.lit(1))).count() == 5


def test_rules_and_cascade(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "k int, v int")
    assert sorted(map(tuple, validate.violations(df, ["k"], {"there": F.col("v").isNotNull(), "positive": F.col("v") > 0}).collect())) == [(2, "positive"), (2, "there"), (3, "positive")]
    assert [r["k"] for r in validate.all_or_nothing(df.withColumn("p", F.col("k") % 2), ["p"], F.col("v").isNotNull() & (F.col("v") < 9)).orderBy("k").collect()] == [1, 3]
    yes, no, null = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    cases = [
        ((yes, yes, yes, yes, yes, yes, yes, yes, 0, yes), "transport_timeout"), ((no, yes, yes, yes, no, no, no, no, 0, yes), "evidence_unreadable"), ((no, no, yes, yes, no, no, no, no, 0, yes), "evidence_unlocated"),
        ((no, no, no, yes, no, no, no, no, 0, no), "unknown_observation_schema"), ((no, no, no, yes, yes, no, no, no, 0, no), "unknown_observation_status"), ((no, no, no, yes, yes, yes, no, yes, 0, no), "contract_violation"),
        ((no, no, no, yes, yes, yes, yes, no, 0, no), "contract_violation"), ((no, no, no, yes, yes, yes, yes, yes, 0, no), "native"), ((no, no, no, null, no, no, no, no, 0, no), "evidence_unlocated"),
        ((no, no, no, no, no, no, no, no, 1, yes), "runtime_verification_failed"), ((no, no, no, no, no, no, no, no, 1, no), "wrapper_error"), ((no, no, no, no, no, no, no, no, 7, no), "transport_error"),
    ]
    one = spark.range(1)
    got = one.select(*[validate.attempt_class(*a[:8], F.lit(a[8]), a[9], F.lit("native")).alias(f"c{i}") for i, (a, _) in enumerate(cases)]).first()
    assert list(got) == [label for _, label in cases]


def test_manifests(spark):
    m = spark.createDataFrame([("a", "x", 1, "d"), ("b", "x", 1, "d"), ("c", "x", 1, "d"), ("c", "y", 1, "d")], "bundle string, name string, length int, sha256 string")
    f = spark.createDataFrame([("a", "x", 1, "d"), ("b", "x", 2, "d"), ("c", "x", 1, "d"), ("e", "z", 1, "d")], "bundle string, name string, length int, sha256 string")
    assert {r["bundle"]: r["verified"] for r in validate.verified_artifacts(m, f).collect()} == {"a": True, "b": False, "c": False, "e": False}


def test_relations(spark):
    rows = spark.createDataFrame([(1, "a", "w1"), (2, "b", "w2"), (3, None, "w1")], "i int, k string, w string")
    other = spark.createDataFrame([("a", "w2"), ("b", "w2")], "k string, w string")
    assert [r["i"] for r in relations.present(rows, other, ["k"]).orderBy("i").collect()] == [1, 2]
    assert [r["i"] for r in relations.absent(rows, other, ["k"]).collect()] == [3]
    assert [(r["i"], r["parent_owner"]) for r in relations.mismatched_owners(rows, other, "k", "w").collect()] == [(1, "w2")]
    assert [r["k"] for r in relations.referential(rows, "k", other.where("k = 'a'"), "k").collect()] == ["b"]
    named = relations.lookup(rows, other.select("k", "w").withColumnRenamed("w", "n"), "k", "n", F.lit("?"), "name")
    assert [r["name"] for r in named.orderBy("i").collect()] == ["w2", "w2", "?"]


def test_measures(spark):
    df = spark.createDataFrame([("g", 1, 3.0), ("g", 2, 1.0), ("g", 3, 2.0), ("h", 1, 0.0)], "g string, rank int, gain double")
    import math

    dcg, best = 3 + 1 / math.log2(3) + 2 / 2, 3 + 2 / math.log2(3) + 1 / 2
    got = {r["g"]: r["ndcg"] for r in measures.ndcg_at(df, "g", "rank", "gain", 10).collect()}
    assert round(got["g"], 9) == round(dcg / best, 9) and got["h"] == 0
    assert {r["g"]: r["precision"] for r in measures.precision_at(df, "g", "rank", F.col("gain") >= 2, 2).collect()} == {"g": 0.5, "h": 0.0}
    over = {r["g"]: (r["items"], r["shared_items"]) for r in measures.overlap(df, "g", "rank").collect()}
    assert over == {"g": (3, 1), "h": (1, 1)}
    assert measures.latency(df, "g", "gain").where("g = 'g'").first()["median"] == 2.0
