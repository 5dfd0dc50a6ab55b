from __future__ import annotations

import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from evidra.functions import ids, json_columns, text, times


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_uuid5_like_python(spark):
    names = ["", "a\0b", "ünïcode ☃", "x" * 500]
    assert column(spark, names, lambda c: ids.uuid5(ids.VERSION_NS, c)) == [str(uuid.uuid5(uuid.UUID(ids.VERSION_NS), n)) for n in names]


def test_derived_ids(spark):
    assert column(spark, ["e"], lambda c: ids.discussion_id(F.lit("w"), F.lit(" Reddit "), c)) == [str(uuid.uuid5(uuid.UUID(ids.DISCUSSION_NS), "w\0reddit\0e"))]
    assert column(spark, ["d" * 64], lambda c: ids.bundle_id(F.lit("w"), c)) == [str(uuid.uuid5(uuid.UUID(ids.BUNDLE_NS), "w:" + "d" * 64))]
    assert column(spark, ["t3_x"], ids.work_item_id) == ["thread_" + hashlib.sha256(b"t3_x").hexdigest()[:32]]
    assert column(spark, ["q"], lambda c: ids.job_id("discovery", F.lit("w"), c)) == ["discovery:w:q"]
    assert column(spark, ["a" * 64, "A" * 64, "a", None], ids.is_digest) == [True, False, False, False]


def test_cursor_round_trip(spark):
    for n, name in ((1, "a"), (10**12, "campaigns"), (77, "x?>")):
        token = column(spark, [n], lambda c: ids.encode_cursor(F.lit(name), c), "long")[0]
        assert "=" not in token and ids.decode_cursor(name, token) == n
        with pytest.raises(ValueError):
            ids.decode_cursor("other", token)
    for bad in ("", "%%%", "a" * 201, "YTow", "YTotMQ"):
        with pytest.raises(ValueError):
            ids.decode_cursor("a", bad)


def test_canonical_json(spark):
    docs = ['{"b": 1.0, "a": [1, {"z": null, "y": "ü"}]}', '{"a":[1,{"y":"ü","z":null}],"b":1}', "not json", None]
    got = column(spark, docs, ids.canonical_json)
    assert got[0] == got[1] == '{"a":[1,{"y":"ü","z":null}],"b":1}' and got[2:] == [None, None]
    ascii_digest = column(spark, docs[1:], ids.ascii_json_digest)
    assert ascii_digest[0] == hashlib.sha256(json.dumps(json.loads(docs[1]), sort_keys=True, separators=(",", ":")).encode()).hexdigest() and ascii_digest[1:] == [None, None]


def test_thread_urls(spark):
    cases = {
        "https://duckduckgo.com/l/?uddg=https%3A%2F%2Fold.reddit.com%2Fr%2Fcybersecurity%2Fcomments%2Fabc123%2Ftitle%2F&rut=ignored": ("https://www.reddit.com/r/cybersecurity/comments/abc123/title/", "t3_abc123", "cybersecurity"),
        "https://Reddit.com/comments/ABC.json?x=1#y": ("https://www.reddit.com/comments/abc/_/", "t3_abc", None),
        "http://www.reddit.com/r/a/comments/abc": ("https://www.reddit.com/r/a/comments/abc/_/", "t3_abc", "a"),
        "https://example.com/r/test/comments/abc/title/": None, "https://www.reddit.com/r/test/": None, "nonsense": None, "ftp://reddit.com/comments/abc": None,
    }
    got = column(spark, [*cases, None], text.thread_url)
    assert [None if g is None else (g["url"], g["external_id"], g["subreddit"]) for g in got] == [*cases.values(), None]
    url = column(spark, ["https://www.reddit.com/r/example/comments/abc/title/"], text.thread_json_url)[0]
    assert url == "https://www.reddit.com/r/example/comments/abc/title.json?limit=500&raw_json=1&sort=confidence"


def test_texts(spark):
    assert column(spark, ["x TOKEN=abc&y=1 /home/ann/z solution=:", None], text.redact) == ["x TOKEN=<redacted>&y=1 ~/z solution=<redacted>:", None]
    assert column(spark, ["https://a/b?x=1&token=z&y=2", "https://a/b?token=z", "https://a/b?solution=1&js_challenge=2#f"], text.without_secret_params) == ["https://a/b?x=1&y=2", "https://a/b", "https://a/b#f"]
    assert column(spark, ["  a \n b  ", ""], text.collapse) == ["a b", ""]
    assert column(spark, ["abcd", "abcde", None], lambda c: text.clip(c, 4)) == ["abcd", "abc…", None]
    assert column(spark, ["--a b!!c--", "***", None, "x" * 99], text.safe_name) == ["a-b-c", "attempt", "attempt", "x" * 80]
    assert column(spark, ["http://a", "HTTPS://b/c", "ftp://x", "x", "http://", None], text.is_http_url) == [True, True, False, False, False, False]
    assert column(spark, ["a\r\n\n b ,c\n"], text.lines) == [["a", "b ,c"]]
    assert column(spark, ["a/b.json", "/a", "a/../b", "a\\b", "", "a//b", "."], text.artifact_name_ok) == [True, False, False, False, False, False, False]
    assert column(spark, ["x.JSON", "x.html", "x", "x.zzz"], text.media_type) == ["application/json", "text/html", "application/octet-stream", "application/octet-stream"]
    assert column(spark, [None, 5, 2048, 3 * 1048576], text.bytes_label, "long") == ["—", "5 B", "2.0 KiB", "3.0 MiB"]
    assert column(spark, [None, -1, 999, 1999, 61000], text.latency_label, "int") == ["—", "—", "999 ms", "1.9 s", "1 m 1 s"]
    assert column(spark, [None, 0.5, 47.9, 48.0], text.age_label, "double") == ["—", "<1 h", "47 h", "2 d"]
    assert column(spark, ["timed out", "JSON bad", "boom"], text.error_class) == ["upstream_unavailable", "parse_failed", "failed"]


def test_access_class(spark):
    rows = [(429, "https://a", "", ""), (401, "https://a", "", ""), (403, "https://a", "", ""), (202, "https://lite.duckduckgo.com/x", "", ""), (200, "https://a?x=1&token=2", "", ""), (200, "https://a", "Whoa there, pardner", None), (200, "https://a", None, "fine"), (200, "https://a", "", "x" * 9000 + "bot challenge")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s int, u string, t string, b string")
    got = [r[0] for r in df.orderBy("i").select(text.access_class(F.col("s"), F.col("u"), F.col("t"), F.col("b"))).collect()]
    assert got == ["rate_limited", "auth_required", "forbidden", "blocked", "blocked", "blocked", None, None]


def test_times(spark):
    got = column(spark, ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05+02:00", "2026-01-02T03:04:05", "x", None], lambda c: F.date_format(times.strict_timestamp(c), "HH:mm"))
    assert got == ["03:04", "01:04", None, None, None]
    assert column(spark, [0.0, 1700000000.9999, 1e12, None], times.epoch_iso, "double") == ["1970-01-01T00:00:00.000Z", "2023-11-14T22:13:20.999Z", None, None]
    assert [round(x, 9) for x in column(spark, [48.0, 96.0, 144.0, 24.0, -5.0], times.freshness, "double")] == [0.5, 0.25, 0.125, round(2**-0.5, 9), 1.0]
    assert column(spark, [0, 1, 2, 3, 9], times.backoff_ms, "int") == [3000, 6000, 12000, 15000, 15000]
    assert column(spark, [0.0, 1.0, 1.01, -0.1, float("nan"), None], times.in_unit, "double") == [True, True, False, False, False, False]


def test_score(spark):
    names = [n for n, _ in times.WEIGHTS]
    df = spark.createDataFrame([(0.9, 0.8, 0.7, 1.0, 0.95, 0.0), (1.2, 0.8, 0.7, 1.0, 0.9, 0.0), (1.0, 1.0, 1.0, 1.0, 1.0, None)], ", ".join(f"{n} double" for n in names) + ", age double")
    got = [r[0] for r in df.select(times.score({n: F.col(n) for n in names}, F.col("age"))).collect()]
    expected = 0.375 * 0.9 + 0.1875 * 0.8 + 0.125 * 0.7 + 0.1875 * 1.0 + 0.125 * 0.95
    assert round(got[0]["score"], 9) == round(expected, 9) and got[1:] == [None, None]


def test_json_columns(spark):
    doc = '{"i": 3, "f": 3.0, "h": 3.5, "s": "3", "b": true, "n": null}'
    for path, whole, number, txt, flag in (("$.i", 3, 3.0, None, None), ("$.f", 3, 3.0, None, None), ("$.h", None, 3.5, None, None), ("$.s", None, None, "3", None), ("$.b", None, None, None, True), ("$.n", None, None, None, None), ("$.gone", None, None, None, None)):
        v = lambda c: F.try_parse_json(c)
        got = [column(spark, [doc], lambda c: f(v(c), path))[0] for f in (json_columns.whole_number, json_columns.finite_number, json_columns.member_text, json_columns.flag)]  # noqa: B023
        assert got == [whole, number, txt, flag], path
    assert column(spark, ['{"a":1,"b":2}', '{"a":1}', "x", None], lambda c: json_columns.same_keys(c, ["b", "a"])) == [True, False, False, False]
