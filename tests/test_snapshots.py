from __future__ import annotations

import datetime as dt
import json
import random

import pytest

from evidra.operators.snapshots import content_of, snapshot_changes

SCHEMA = "row_id long, snapshot_no int, conversation_id string, normalized_content string, delivered_at timestamp, key string, digest string"


def doc(title, created=5, **extra):
    return json.dumps({"post": {"id": "t3_a", "title": title, "createdUtc": created, **extra}, "comments": [], "unresolvedMore": []})


def test_content_ignores_form_and_volatile_fields():
    same = [
        doc("A"), doc("A", 5.0), doc("A", score=9), json.dumps(doc("A")), json.dumps(json.dumps(doc("A"))),
        '{"comments":[],"post":{"createdUtc":5e0,"title":"\\u0041","id":"t3_a","author":null}}',
    ]
    assert len({content_of(x) for x in same}) == 1
    assert len({content_of(x) for x in (doc("A"), doc("a"), doc("A", 6), doc("A", "5"), doc("A", author="x"), None, "no json", "[]")}) == 8


def test_content_of_comments_and_placeholders():
    base = {"post": {}, "comments": [{"id": "c", "body": "x", "score": 1}], "unresolvedMore": [{"id": "m", "childIds": ["a", "b"]}]}
    volatile = {**base, "comments": [{"id": "c", "body": "x", "score": 7, "parentId": None}]}
    turned = {**base, "unresolvedMore": [{"id": "m", "childIds": ["b", "a"]}]}
    assert content_of(json.dumps(base)) == content_of(json.dumps(volatile)) != content_of(json.dumps(turned))
    assert content_of(json.dumps(base)) != content_of(json.dumps({**base, "comments": base["comments"] * 2}))


def brute(rows):
    last = {}
    for r in rows:
        if r[1] is None or r[2] is None:
            continue
        k = (r[1], r[2].lower())
        if k not in last or (r[4] is not None, r[4], r[0]) > (last[k][4] is not None, last[k][4], last[k][0]):
            last[k] = r
    numbers = sorted({s for s, _ in last})
    out = set()
    for a, b in zip(numbers, numbers[1:]):
        old, new = ({k: content_of(r[3]) for (s, k), r in last.items() if s == n} for n in (a, b))
        for k in old.keys() | new.keys():
            if k not in old:
                out.add((b, k, "added"))
            elif k not in new:
                out.add((b, k, "removed"))
            elif old[k] != new[k]:
                out.add((b, k, "changed"))
    return out


@pytest.mark.parametrize(("seed", "chunk"), [(1, 64), (2, 3), (3, 1)])
def test_like_brute_force(spark, seed, chunk):
    r = random.Random(seed)
    rows = []
    for i in range(1500):
        title = r.choice("AB") if r.random() < 0.2 else "A"
        content = r.choice([doc(title), doc(title), doc(title, 5.0), json.dumps(doc(title)), None if r.random() < 0.1 else doc(title), "broken"[: r.choice([6, 6, 0])] if r.random() < 0.1 else doc(title)])
        rows.append((i, r.choice([1, 2, 4, 9, None if r.random() < 0.05 else 4]), r.choice(["k", "K"]) + str(r.randrange(200)) if r.random() < 0.99 else None, content, None if r.random() < 0.02 else dt.datetime(2026, 1, 1 + r.randrange(3)), "clash", "clash"))
    df = spark.createDataFrame(rows, SCHEMA)
    got = snapshot_changes(df, "snapshot_no", "conversation_id", "normalized_content", "delivered_at", "row_id", chunk_keys=chunk)
    collected = [tuple(x) for x in got.collect()]
    assert len(collected) == len(set(collected)) and set(collected) == brute(rows)


def test_one_snapshot_and_none(spark):
    one = spark.createDataFrame([(1, 3, "a", doc("A"), None, "", "")], SCHEMA)
    for df in (one, one.where("false")):
        assert snapshot_changes(df, "snapshot_no", "conversation_id", "normalized_content", "delivered_at", "row_id").count() == 0


def test_a_key_delivered_very_often(spark):
    rows = [(i, 1 + i % 2, "hot", doc(str(i)), dt.datetime(2026, 1, 1), "", "") for i in range(3000)]
    got = snapshot_changes(spark.createDataFrame(rows, SCHEMA), "snapshot_no", "conversation_id", "normalized_content", "delivered_at", "row_id").collect()
    assert [tuple(r) for r in got] == [(2, "hot", "changed")]
