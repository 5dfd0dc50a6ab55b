"""Queries over events, documents and warehouse tables: text and time functions, digests, writes, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import ids, json_columns, text, times
from evidra.operators import dedupe, paging, threads
from evidra.plans.evidence import ATTEMPTS, LATEST, attempts, candidates, latest
from evidra.plans.registry import Registry
from evidra.session import ensure_checkpoint_dir, table
from evidra.sources import readers, writers
from evidra.streaming import events as stream

query = Registry()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, substr(regexp_replace(regexp_replace(text || ' token=abc&x=1 in /home/ann/work', '((?:solution|js_challenge|token|jsc_orig_r)=)[^&\\s:]*', '\\1<redacted>', 'gi'), '/home/[^/\\s:]+', '~', 'g'), 1, 500) AS redacted FROM documents")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and home folders masked."""
    return table(spark, sf_dir, "documents").select("doc_id", text.redact(F.concat("text", F.lit(" token=abc&x=1 in /home/ann/work"))).alias("redacted"))


@query("""SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 59) || '…' ELSE text END AS clipped, coalesce(nullif(substr(regexp_replace(regexp_replace(source, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), ''), 'attempt') AS safe, nullif(lang, '') AS lang,
    CASE WHEN n_chars IS NULL THEN '—' WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN printf('%.1f KiB', n_chars / 1024) ELSE printf('%.1f MiB', n_chars / 1048576) END AS size_label FROM documents""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped text, safe names, labels."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.clip(F.col("text"), 60).alias("clipped"), text.safe_name(F.col("source")).alias("safe"), text.text_or_null(F.col("lang")).alias("lang"), text.bytes_label(F.col("n_chars")).alias("size_label"))


@query("SELECT doc_id, sha256(text) AS digest, length(text) AS chars FROM documents WHERE text IS NOT NULL")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the exact text."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("digest"), F.char_length("text").cast("long").alias("chars"))


@query("SELECT event_id, sha256(CAST(json(props) AS VARCHAR)) AS digest, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) = 1 AND json_keys(props)[1] = 'k' AS exact_keys FROM events")
def strict_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest and strictly typed member."""
    doc = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", ids.json_digest(F.col("props")).alias("digest"), json_columns.whole_number(doc, "$.k").alias("k"), json_columns.same_keys(F.col("props"), ["k"]).alias("exact_keys"))


@query("SELECT row_id, strftime(make_timestamp(created_utc * 1000000), '%Y-%m-%dT%H:%M:%S') || '.000Z' AS created_iso, strftime(fetched_at, '%Y-%m-%d %H:%M') AS short_date, round((epoch_us(fetched_at) - created_utc * 1000000) / 3.6e9, 6) AS age_hours FROM deep_comments WHERE created_utc IS NOT NULL")
def comment_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch to ISO, short dates, ages."""
    rows = table(spark, sf_dir, "deep_comments").where("created_utc IS NOT NULL")
    return rows.select("row_id", times.epoch_iso(F.col("created_utc").cast("double")).alias("created_iso"), F.date_format("fetched_at", "yyyy-MM-dd HH:mm").alias("short_date"), F.round(times.age_hours(F.timestamp_seconds("created_utc"), F.col("fetched_at")), 6).alias("age_hours"))


@query(f"""WITH {ATTEMPTS} SELECT id, CASE WHEN elapsed_ms IS NULL OR elapsed_ms < 0 THEN '—' WHEN elapsed_ms < 1000 THEN elapsed_ms || ' ms' WHEN elapsed_ms < 60000 THEN printf('%.1f s', floor(elapsed_ms / 100) / 10) ELSE CAST(floor(elapsed_ms / 60000) AS BIGINT) || ' m ' || CAST(floor(elapsed_ms / 1000) % 60 AS BIGINT) || ' s' END AS latency,
    CASE WHEN completed_at >= started_at THEN CAST((epoch_us(completed_at) - epoch_us(started_at)) // 1000 AS BIGINT) END AS measured_ms, CAST(least(3000 * pow(2, least(candidate_count, 3)), 15000) AS BIGINT) AS backoff_ms FROM attempts""")
def attempt_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency labels, measured time, back-off."""
    micros = F.unix_micros(F.col("completed_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return attempts(spark, sf_dir).select("id", text.latency_label(F.col("elapsed_ms")).alias("latency"), F.when(F.col("completed_at") >= F.col("started_at"), F.floor(micros / 1000)).alias("measured_ms"), times.backoff_ms(F.col("candidate_count")).alias("backoff_ms"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 200")
def order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyset page; the position filter reaches the scan."""
    return paging.top_k(table(spark, sf_dir, "orders").where("o_orderkey > 500").select("o_orderkey", "o_orderdate"), [F.col("o_orderkey")], 200)


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user."""
    return dedupe.last_by(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents WHERE text IS NOT NULL) WHERE n = 1")
def first_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    return dedupe.first_by(table(spark, sf_dir, "documents").where("text IS NOT NULL"), ["text"], ["doc_id"]).select("doc_id", "text")


@query("SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 1000 AS creation_order, o_orderkey FROM orders")
def creation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable numbers given at ingest, after those given before."""
    rows = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey")
    return dedupe.with_creation_order(rows, ["o_orderdate", "o_orderkey"], 1000).select("creation_order", "o_orderkey")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' AND ts < (SELECT max(ts) FROM events) - INTERVAL 900 SECOND")
def stale_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has been open since before the cutoff; the newest event stands for now."""
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "event_type", F.col("ts").alias("started_at"), F.lit("running").alias("status"))
    now = table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]
    return stream.stale(rows, F.lit(now).cast("timestamp_ntz"), 900).select("event_id", "event_type")


@query(f"WITH {LATEST} SELECT id, campaign_id FROM latest")
def append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping deliveries and a replay leave each id once."""
    rows, path = latest(spark, sf_dir).select("id", "campaign_id", "creation_order"), scratch(spark, "append-once")
    for part in (rows.where("creation_order % 3 <> 0"), rows.where("creation_order % 3 <> 1"), rows.where("creation_order % 3 <> 1")):
        writers.append_once(part, path, ["id"], ["creation_order"])
    return spark.read.parquet(path).select("id", "campaign_id")


@query(f"""WITH {LATEST}, old AS (SELECT * FROM latest WHERE creation_order % 3 <> 0), new AS (SELECT id, opportunity_score / 2 AS s FROM latest WHERE creation_order % 2 = 0)
    SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.s ELSE o.opportunity_score END AS opportunity_score, CASE WHEN o.id IS NOT NULL THEN o.status ELSE 'open' END AS status FROM old o FULL JOIN new n ON o.id = n.id""")
def merge_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge replaces scores and keeps what people set."""
    rows = latest(spark, sf_dir)
    old = rows.where("creation_order % 3 <> 0").select("id", "opportunity_score", "status")
    new = rows.where("creation_order % 2 = 0").select("id", (F.col("opportunity_score") / 2).alias("opportunity_score"))
    return writers.merged(old, new, ["id"], ["opportunity_score"], {"status": F.lit("open")})


@query(f"""WITH {LATEST}, stored AS (SELECT id, campaign_id AS f, CASE WHEN creation_order % 5 = 0 THEN NULL ELSE 'ok' END AS r FROM latest WHERE creation_order % 2 = 0), asked AS (SELECT id, CASE WHEN creation_order % 7 = 0 THEN 'other' ELSE campaign_id END AS f FROM latest)
    SELECT a.id, CASE WHEN s.id IS NULL THEN 'new' WHEN a.f IS DISTINCT FROM s.f THEN 'conflict' WHEN s.r IS NULL THEN 'unfinished' ELSE 'replay' END AS decision FROM asked a LEFT JOIN stored s ON a.id = s.id""")
def write_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed writes are new, replayed, in conflict or unfinished."""
    rows = latest(spark, sf_dir)
    stored = rows.where("creation_order % 2 = 0").select("id", F.col("campaign_id").alias("f"), F.when(F.col("creation_order") % 5 != 0, "ok").alias("r"))
    asked = rows.select("id", F.when(F.col("creation_order") % 7 == 0, "other").otherwise(F.col("campaign_id")).alias("f"))
    return writers.receipts(asked, stored, ["id"], "f", "r").select("id", "decision")


@query(f"""WITH {LATEST}, kept AS (SELECT id, campaign_id FROM latest WHERE creation_order % 2 = 0) SELECT l.id, k.id IS NULL AS created, k.id IS NOT NULL AND k.campaign_id IS DISTINCT FROM CASE WHEN l.creation_order % 7 = 0 THEN 'other' ELSE l.campaign_id END AS conflict FROM latest l LEFT JOIN kept k ON l.id = k.id""")
def get_or_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested rows that are new, there, or there with other values."""
    rows = latest(spark, sf_dir)
    asked = rows.select("id", F.when(F.col("creation_order") % 7 == 0, "other").otherwise(F.col("campaign_id")).alias("campaign_id"))
    kept = rows.where("creation_order % 2 = 0").select("id", "campaign_id")
    return writers.get_or_create(asked, kept, "id", ["campaign_id"]).select("id", "created", "conflict")


@query("SELECT event_id, event_type, value FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream delivered twice is appended once."""
    source = table(spark, sf_dir, "events")
    path, marks = scratch(spark, "events"), scratch(spark, "marks")
    folder = scratch(spark, "arrivals")
    for _ in range(2):  # the same rows arrive in two files
        source.write.mode("append").parquet(folder)
    for attempt in range(2):  # and everything is delivered again to another stream
        rows = spark.readStream.schema(source.schema).parquet(folder)
        stream.append_stream(rows, path, f"{marks}-{attempt}", ["event_id"], ["ts"]).awaitTermination()
    return spark.read.parquet(path).select("event_id", "event_type", "value")


_USABLE = "status IN ('success', 'no_results', 'incomplete') AND query_id IS NOT NULL"


@query(f"WITH {ATTEMPTS}, p AS (SELECT DISTINCT discovery_run_id AS run, query_id FROM retrieval_observations WHERE {_USABLE}), r AS (SELECT DISTINCT discovery_run_id AS run, query_id FROM attempts WHERE {_USABLE} AND elapsed_ms >= 0) SELECT p.run, count(r.query_id) AS recorded, count(*) AS planned FROM p LEFT JOIN r ON p.run = r.run AND p.query_id = r.query_id GROUP BY 1 HAVING count(r.query_id) >= count(*)")
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs all of whose planned queries are recorded with a measured attempt."""
    planned = table(spark, sf_dir, "retrieval_observations").where(_USABLE).select(F.col("discovery_run_id").alias("run"), "query_id").distinct()
    measured = attempts(spark, sf_dir).where(_USABLE + " AND elapsed_ms >= 0").select(F.col("discovery_run_id").alias("run"), "query_id")
    return stream.completions(measured, planned).select("run", "recorded", "planned")


@query(f"WITH {ATTEMPTS}, r AS (SELECT discovery_run_id, bool_and(status IN ('success', 'no_results')) AS done FROM attempts GROUP BY 1) SELECT a.id, CASE WHEN r.done AND a.capability = 'discovery' THEN 'already_done' ELSE 'accepted' END AS decision FROM attempts a JOIN r USING (discovery_run_id)")
def late_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: discovery rows of an ended run come too late, fetches do not."""
    rows = attempts(spark, sf_dir).withColumnRenamed("discovery_run_id", "run")
    runs = rows.groupBy("run").agg(F.when(F.bool_and(F.col("status").isin("success", "no_results")), "succeeded").otherwise("running").alias("status"))
    return stream.accepted(rows.select("id", "run", "capability"), runs, ["succeeded", "partial", "failed", "cancelled"]).select("id", "decision")


@query(f"""WITH {ATTEMPTS} SELECT creation_order, seq, type FROM (SELECT creation_order, 0 AS seq, 'candidates.found' AS type FROM attempts WHERE candidate_count > 0 UNION ALL SELECT creation_order, 1, 'observation.recorded' FROM attempts UNION ALL SELECT creation_order, 2, 'attempt.failed' FROM attempts WHERE failure_class IS NOT NULL)""")
def event_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each attempt in their sequence."""
    kinds = [("candidates.found", F.col("candidate_count") > 0), ("observation.recorded", F.lit(True)), ("attempt.failed", F.col("failure_class").isNotNull())]
    return stream.fan_out(attempts(spark, sf_dir), "creation_order", kinds).select("creation_order", "seq", "type")


@query("SELECT event_id AS id, event_type AS type, user_id % 4 = 1 AS in_scope FROM events WHERE event_type IN ('click', 'error', 'view')")
def event_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes parsed, malformed ones and those of unknown types dropped; which belong to one run."""
    e = table(spark, sf_dir, "events")
    envelope = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("type"), (F.col("user_id") % 4).cast("string").alias("run_id"), F.lit("w1").alias("workspace_id")))
    lines = e.select(envelope.alias("line")).unionByName(e.select(F.lit("{not json").alias("line")))
    known = stream.parsed(lines, "line", ["click", "error", "view"])
    mine = stream.scoped(known, "w1", "1").select("id", F.lit(True).alias("mine"))
    return known.join(mine, "id", "left").select(F.col("id").cast("long").alias("id"), "type", F.coalesce("mine", F.lit(False)).alias("in_scope"))


@query()
def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result links of HTML pages made of the candidates."""
    link = F.concat(F.lit('<tr><td><a class="result-link" href="'), F.col("url"), F.lit('">'), F.col("title"), F.lit('</a></td></tr><tr><td class="result-snippet">'), F.col("snippet"), F.lit("</td></tr>"))
    pages = candidates(spark, sf_dir).groupBy("creation_order").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", link.alias("html")))), lambda x: x["html"])).alias("page"))
    return readers.result_rows(pages, "creation_order", "page")


@query()
def thread_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw threads to records with digests and validation."""
    raw = table(spark, sf_dir, "retrieval_observations").where("raw_artifact IS NOT NULL").select(F.col("creation_order"), "raw_artifact").distinct()
    return threads.normalized_threads(raw, "creation_order", "raw_artifact").where("problem IS NULL").drop("record", "problem").withColumn("normalizer", F.lit(threads.NORMALIZER))


QUERIES, SQL = query.queries, query.sql
