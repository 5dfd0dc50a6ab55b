from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.functions import text
from evidra.operators.tasks import not_yet_done, run_task


def test_typed_task(spark):
    def judge(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        made = pd.DataFrame({"relevance": texts.str.len() / 10, "topic": texts.str[:3]})
        made["failure_class"] = [None if len(t) else "output_invalid" for t in texts]
        return made

    df = spark.createDataFrame([(1, "abcdef"), (2, ""), (3, "x" * 30), (4, "  z")], "id int, body string")
    fields = [T.StructField("relevance", T.DoubleType()), T.StructField("topic", T.StringType())]
    got = {r["id"]: r for r in run_task(df, ["id", "body"], fields, judge, [(~F.col("relevance").between(0, 1), "domain_validation_failed")], "judge@1").collect()}
    assert (got[1]["relevance"], got[1]["topic"], got[1]["failure"]) == (0.6, "abc", None)
    assert (got[2]["failure"], got[2]["relevance"]) == ("output_invalid", None)
    assert (got[3]["failure"], got[3]["topic"]) == ("domain_validation_failed", None) and got[4]["task_version"] == "judge@1"
    single = run_task(df.select("body"), ["body"], fields[:1], lambda s: pd.DataFrame({"relevance": s.str.len() * 1.0}), [], "n@1")
    assert sorted(r["relevance"] for r in single.collect()) == [0.0, 3.0, 6.0, 30.0]
    assert [r["id"] for r in not_yet_done(df, df.where("id < 3"), ["id"]).orderBy("id").collect()] == [3, 4]


def test_labels(spark):
    df = spark.createDataFrame([(1, None, " a ", None), (None, None, "", "x")], "n int, m int, p string, q string")
    got = df.select(text.usage_label((F.col("n"), "requests"), (F.col("m"), "bytes")).alias("u"), text.joined_line(F.col("p"), F.col("q")).alias("l")).collect()
    assert sorted(map(tuple, got)) == [("1 requests", "a"), ("—", "x")]
    pages = spark.createDataFrame([(None,), (" ",), ("short",), ("m" * 100,), ("l" * 500,), ("l" * 500 + "\n\nmore",), ("x" * 500 + " bot challenge",)], "t string")
    assert [r[0] for r in pages.select(text.content_level(F.col("t"))).collect()] == [0, 0, 1, 2, 3, 4, 0]
    paths = spark.createDataFrame([("/r/x",), ("r/x",), (None,)], "p string")
    assert [r[0] for r in paths.select(text.site_url("https://s", F.col("p"))).collect()] == ["https://s/r/x", None, None]
    urls = spark.createDataFrame([("a b", ["x"]), ("ü", ["x", "y"]), ("q", [])], "q string, s array<string>")
    assert [r[0] for r in urls.select(text.search_url("https://e/", F.col("q"), F.col("s"), "h")).collect()] == ["https://e/?q=site%3Ah%2Fr%2Fx+a+b", "https://e/?q=site%3Ah+%C3%BC", "https://e/?q=site%3Ah+q"]
