"""Queries over whole runs: completion against a plan, tenants, provenance, outcome cascades, bundles, labels, tasks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.functions import ids, text, times
from evidra.functions.json_columns import member_text, whole_number
from evidra.operators import dedupe, relations, rollup, sets, tasks, validate
from evidra.plans.evidence import ATTEMPTS, FACTS, LATEST, attempts, candidates, facts, latest
from evidra.plans.records import _UNWRAPPED, _variant
from evidra.plans.registry import Registry
from evidra.session import table

query = Registry()

#: A run plans every query that its workspace has ever asked; one attempt counts per run and query, the first.
_PLAN = f"""{ATTEMPTS}, runs AS (SELECT DISTINCT discovery_run_id AS run, workspace_id FROM attempts WHERE discovery_run_id IS NOT NULL),
    asked AS (SELECT DISTINCT workspace_id, query_id FROM attempts WHERE query_id IS NOT NULL), plan AS (SELECT r.run, a.query_id FROM runs r JOIN asked a ON a.workspace_id = r.workspace_id),
    kept AS (SELECT * FROM attempts WHERE query_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY discovery_run_id, query_id ORDER BY creation_order, id) = 1)"""


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(run, query_id) of every planned query, and the attempts that count."""
    rows = attempts(spark, sf_dir)
    asked = rows.where("query_id IS NOT NULL").select("workspace_id", "query_id").distinct()
    runs = rows.where("discovery_run_id IS NOT NULL").select(F.col("discovery_run_id").alias("run"), "workspace_id").distinct()
    kept = dedupe.first_by(rows.where("query_id IS NOT NULL"), ["discovery_run_id", "query_id"], ["creation_order", "id"])
    return runs.join(asked, "workspace_id").select("run", "query_id").distinct(), kept.withColumnRenamed("discovery_run_id", "run")


@query(f"""WITH {_PLAN}, planned AS (SELECT DISTINCT run, query_id FROM plan), done AS (SELECT p.run, p.query_id, k.id, k.status, k.elapsed_ms, k.candidate_count FROM planned p LEFT JOIN kept k ON k.discovery_run_id = p.run AND k.query_id = p.query_id),
    n AS (SELECT run, string_agg(status || '=' || c, ',' ORDER BY status) AS counts FROM (SELECT run, status, count(*) AS c FROM done WHERE status IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    r AS (SELECT run, count(*) AS planned, count(id) AS recorded, bool_and(status IN ('success', 'no_results')) AS good, bool_or(status IN ('success', 'no_results', 'incomplete')) AS usable, count(CASE WHEN status = 'success' THEN 1 END) AS successes, count(CASE WHEN status = 'incomplete' THEN 1 END) AS incomplete,
        CAST(sum(coalesce(elapsed_ms, 0)) AS BIGINT) AS elapsed, CAST(sum(CASE WHEN candidate_count >= 0 THEN candidate_count END) AS BIGINT) AS requests FROM done GROUP BY 1)
    SELECT r.run, planned, recorded, successes, incomplete, CASE WHEN recorded < planned THEN NULL WHEN good THEN 'succeeded' WHEN NOT usable THEN 'failed' ELSE 'partial' END AS final_status, CASE WHEN recorded = planned THEN n.counts END AS counts,
    CASE WHEN recorded = planned THEN elapsed END AS total_elapsed_ms, CASE WHEN recorded = planned THEN requests END AS request_count, CASE WHEN recorded = planned THEN greatest(requests - 1, 0) END AS retries, CAST(NULL AS BIGINT) AS bytes_transferred, CAST(NULL AS DOUBLE) AS cost_usd, 'unpriced' AS cost_status FROM r LEFT JOIN n ON n.run = r.run""")
def run_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run against its plan; open until every planned query is recorded, and only planned ones count."""
    plan, kept = _plan(spark, sf_dir)
    done = plan.join(kept.select("run", "query_id", "id", "status", "elapsed_ms", "candidate_count"), ["run", "query_id"], "left")
    s = F.col("status")
    counted = done.groupBy("run").agg(
        F.count("*").alias("planned"), F.count("id").alias("recorded"), F.count_if(s == "success").alias("successes"), F.count_if(s == "incomplete").alias("incomplete"),
        rollup.outcome(F.bool_and(s.isin(*rollup.SUCCEEDED)), F.bool_or(s.isin(*rollup.USABLE))).alias("outcome"), F.sum(F.coalesce("elapsed_ms", F.lit(0))).cast("long").alias("elapsed"), F.sum(F.when(F.col("candidate_count") >= 0, F.col("candidate_count"))).cast("long").alias("requests"),
    )
    counts = rollup.histogram_map(done, ["run"], "status").select("run", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))
    closed = lambda c: F.when(F.col("recorded") == F.col("planned"), c)
    return counted.join(counts, "run", "left").select(
        "run", "planned", "recorded", "successes", "incomplete", closed(F.col("outcome")).alias("final_status"), closed(F.col("counts")).alias("counts"), closed(F.col("elapsed")).alias("total_elapsed_ms"), closed(F.col("requests")).alias("request_count"),
        closed(F.when(F.col("requests").isNotNull(), F.greatest(F.col("requests") - 1, F.lit(0))).otherwise(0).cast("long")).alias("retries"), F.lit(None).cast("long").alias("bytes_transferred"), F.lit(None).cast("double").alias("cost_usd"), F.lit("unpriced").alias("cost_status"),
    )


_TENANT = "(SELECT min(id) FROM workspaces)"


@query(f"""WITH {LATEST}, {FACTS}, versions AS (SELECT * FROM conversation_versions QUALIFY row_number() OVER (PARTITION BY workspace_id, conversation_id ORDER BY delivered_at DESC NULLS LAST, row_id DESC) = 1),
    models AS (SELECT analysis_identity, count(*) AS calls FROM facts GROUP BY 1), talks AS (SELECT DISTINCT workspace_id, conversation_id FROM conversation_versions),
    kept AS (SELECT l.id AS opportunity_id, l.campaign_id, l.opportunity_score, l.creation_order, f.topic, m.calls, v.id AS version_id, length(f.topic) + length(f.rationale) AS tokens FROM latest l JOIN facts f ON l.analysis_id = f.id JOIN models m ON m.analysis_identity = f.analysis_identity
        JOIN talks t ON t.workspace_id = l.workspace_id AND t.conversation_id = l.conversation_id JOIN versions v ON v.workspace_id = l.workspace_id AND v.conversation_id = l.conversation_id WHERE l.workspace_id = {_TENANT} ORDER BY l.opportunity_score DESC NULLS LAST, l.creation_order DESC, l.id LIMIT 200)
    SELECT row_number() OVER (ORDER BY opportunity_score DESC NULLS LAST, creation_order DESC, opportunity_id) AS display_rank, opportunity_id, campaign_id, topic, calls, version_id, tokens FROM kept""")
def tenant_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One workspace's inbox over five tables, with the rank that is shown; the workspace filter reaches the scan."""
    tenant = table(spark, sf_dir, "workspaces").agg(F.min("id")).first()[0]  # the argument of the request
    from evidra.sources.readers import workspace_table

    mine = dedupe.last_by(workspace_table(spark, f"{sf_dir}/opportunities.parquet", tenant), ["id"], ["updated_at", "creation_order"])
    seen = workspace_table(spark, f"{sf_dir}/conversation_versions.parquet", tenant).select("workspace_id", "conversation_id", F.col("id").alias("version_id"), "delivered_at", "row_id")
    versions = dedupe.last_by(seen, ["workspace_id", "conversation_id"], ["delivered_at", "row_id"]).drop("delivered_at", "row_id")
    known = facts(spark, sf_dir).select(F.col("id").alias("analysis_id"), "topic", "rationale", "analysis_identity")
    models = known.groupBy("analysis_identity").agg(F.count("*").alias("calls"))
    joined = mine.join(seen.select("workspace_id", "conversation_id").distinct(), ["workspace_id", "conversation_id"]).join(versions, ["workspace_id", "conversation_id"]).join(known, "analysis_id").join(models, "analysis_identity")
    order = [F.desc_nulls_last("opportunity_score"), F.desc("creation_order"), F.asc("id")]
    page = joined.select("id", "campaign_id", "topic", "calls", "version_id", (F.char_length("topic") + F.char_length("rationale")).cast("long").alias("tokens"), "opportunity_score", "creation_order").orderBy(*order).limit(200)
    return page.withColumn("display_rank", F.row_number().over(Window.orderBy(*order)).cast("long")).select("display_rank", F.col("id").alias("opportunity_id"), "campaign_id", "topic", "calls", "version_id", "tokens")  # at most a page


@query(f"""WITH {ATTEMPTS}, provenance AS (SELECT v.row_id, a.id AS observation_id FROM conversation_versions v JOIN attempts a ON a.workspace_id = v.workspace_id AND a.creation_order % 37 = v.row_id % 37),
    edges AS (SELECT v.workspace_id, v.conversation_id, v.id AS version_id, v.normalizer_version, a.creation_order, coalesce(a.completed_at, a.started_at, a.created_at) AS seen_at FROM conversation_versions v JOIN provenance p ON p.row_id = v.row_id JOIN attempts a ON a.workspace_id = v.workspace_id AND a.id = p.observation_id)
    SELECT workspace_id, conversation_id, version_id, creation_order, strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS seen_at FROM edges QUALIFY row_number() OVER (PARTITION BY workspace_id, conversation_id ORDER BY seen_at DESC NULLS LAST, creation_order DESC, normalizer_version DESC, version_id DESC) = 1""")
def provenance_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions with their provenance and observations, three-way; per discussion the version with the newest evidence, those
    without vanish. The table of provenance is made by a rule, as no table of the data holds it."""
    versions = table(spark, sf_dir, "conversation_versions").select("row_id", "workspace_id", "conversation_id", F.col("id").alias("version_id"), "normalizer_version")
    seen = attempts(spark, sf_dir).select("workspace_id", F.col("id").alias("observation_id"), "creation_order", F.coalesce("completed_at", "started_at", "created_at").alias("seen_at"))
    rule = versions.select("row_id", "workspace_id", (F.col("row_id") % 37).alias("place")).join(seen.select("workspace_id", "observation_id", (F.col("creation_order") % 37).alias("place")), ["workspace_id", "place"]).select("row_id", "observation_id")
    edges = versions.join(rule, "row_id").join(seen, ["workspace_id", "observation_id"])
    best = edges.groupBy("workspace_id", "conversation_id").agg(F.max(F.struct("seen_at", "creation_order", "normalizer_version", "version_id")).alias("best"))
    return best.select("workspace_id", "conversation_id", "best.version_id", "best.creation_order", F.date_format("best.seen_at", "yyyy-MM-dd HH:mm:ss").alias("seen_at"))


_CASCADE = """CASE WHEN coalesce(timed_out, false) THEN 'transport_timeout' WHEN coalesce(unreadable, false) THEN 'evidence_unreadable' WHEN coalesce(no_pointer, false) THEN 'evidence_unlocated' WHEN there AND NOT version_ok THEN 'unknown_observation_schema' WHEN there AND NOT status_ok THEN 'unknown_observation_status'
    WHEN there AND NOT (shape_ok AND capability_ok) THEN 'contract_violation' WHEN NOT there AND exit_code = 0 THEN 'evidence_unlocated' WHEN NOT there AND exit_code = 1 AND marker THEN 'runtime_verification_failed' WHEN NOT there AND exit_code = 1 THEN 'wrapper_error' WHEN NOT there THEN 'transport_error' ELSE status END"""
#: Statuses of the wire contract.
STATUSES = "success no_results incomplete blocked auth_required forbidden rate_limited upstream_unavailable parse_failed runtime_verification_failed transport_failed failed".split()


@query(f"""WITH {ATTEMPTS}, facts AS (SELECT id, status, evidence_state = 'none' AND failure_reason LIKE 'timeout%' AS timed_out, evidence_state = 'unreadable' AS unreadable, evidence_state = 'bundle' AND raw_artifact IS NULL AND capability = 'thread_fetch' AS no_pointer, coalesce(evidence_state = 'bundle', false) AS there, coalesce(schema_version = 1, false) AS version_ok,
    coalesce(status IN ({", ".join(f"'{s}'" for s in STATUSES)}), false) AS status_ok, observation_id IS NOT NULL AND length(observation_id) <= 200 AS shape_ok, coalesce(capability IN ('discovery', 'thread_fetch'), false) AS capability_ok, CASE WHEN failure_class = 'wrapper_error' THEN 1 WHEN failure_class IS NULL THEN 0 ELSE 2 END AS exit_code, coalesce(status = 'runtime_verification_failed', false) AS marker FROM attempts)
    SELECT id, {_CASCADE} AS outcome FROM facts""")
def attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each attempt, by the first rule of the ordered cascade that holds."""
    c, none = F.col, F.coalesce(F.col("evidence_state") == "bundle", F.lit(False))
    exit_code = F.when(c("failure_class") == "wrapper_error", 1).when(c("failure_class").isNull(), 0).otherwise(2)
    outcome = validate.attempt_class(
        (c("evidence_state") == "none") & c("failure_reason").startswith("timeout"), c("evidence_state") == "unreadable", none & c("raw_artifact").isNull() & (c("capability") == "thread_fetch"), none,
        F.coalesce(c("schema_version") == 1, F.lit(False)), F.coalesce(c("status").isin(*STATUSES), F.lit(False)), c("observation_id").isNotNull() & (F.char_length("observation_id") <= 200),
        F.coalesce(c("capability").isin("discovery", "thread_fetch"), F.lit(False)), exit_code, F.coalesce(c("status") == "runtime_verification_failed", F.lit(False)), c("status"),
    )
    return attempts(spark, sf_dir).select("id", outcome.alias("outcome"))


_HTTP = "CASE WHEN n_chars % 11 = 0 THEN 429 WHEN n_chars % 11 = 1 THEN 401 WHEN n_chars % 11 = 2 THEN 403 WHEN n_chars % 11 = 3 THEN 202 ELSE 200 END"
_PAGE = "CASE WHEN n_chars % 3 = 0 THEN 'https://lite.duckduckgo.com/lite?q=a' WHEN n_chars % 3 = 1 THEN 'https://www.threads.example/r/a?solution=1' ELSE 'https://threads.example/r/a?x=1' END"


@query(f"""WITH p AS (SELECT doc_id, {_HTTP} AS status, {_PAGE} AS url, substr(coalesce(source, '') || chr(10) || coalesce(text, ''), 1, 8000) AS shown FROM documents)
    SELECT doc_id, CASE WHEN status = 429 THEN 'rate_limited' WHEN status = 401 THEN 'auth_required' WHEN status = 403 THEN 'forbidden' WHEN status = 202 AND url LIKE '%duckduckgo.com/%' THEN 'blocked' WHEN url LIKE '%solution=%' OR regexp_matches(shown, '(?i)unusual traffic|bot challenge|verify (?:you are|that you are) human|duckduckgo.*anomaly|whoa there, pardner|you(?:''ve| have) been blocked') THEN 'blocked' END AS access_class FROM p""")
def access_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a page could not be read; status and address are made of the length of each text, which is the page."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.access_class(F.expr(_HTTP), F.expr(_PAGE), F.col("source"), F.col("text")).alias("access_class"))


@query(f"""WITH {ATTEMPTS}, m AS (SELECT id, coalesce(failure_reason, failure_class, status) AS message FROM attempts) SELECT id, CASE WHEN regexp_matches(message, '(?i)timeout|timed out|network error|ERR_|ECONN|ENOTFOUND|EAI_AGAIN') THEN 'upstream_unavailable' WHEN regexp_matches(message, '(?i)JSON|parse|root post|two-listing array') THEN 'parse_failed' ELSE 'failed' END AS error_class FROM m""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P20: error texts by class."""
    return attempts(spark, sf_dir).select("id", text.error_class(F.coalesce("failure_reason", "failure_class", "status")).alias("error_class"))


@query(f"""WITH {ATTEMPTS}, asked AS (SELECT id, coalesce(query_id, '') || CASE WHEN creation_order % 5 = 0 THEN ' x' WHEN creation_order % 7 = 0 THEN repeat('q', 300) WHEN creation_order % 3 = 0 THEN 'z' ELSE '' END AS claimed FROM attempts), known AS (SELECT DISTINCT query_id FROM attempts WHERE query_id IS NOT NULL)
    SELECT id, CASE WHEN length(claimed) > 200 THEN 'too long' WHEN NOT regexp_matches(claimed, '^[A-Za-z0-9_-]{{1,64}}$') THEN 'characters' WHEN k.query_id IS NULL THEN 'not in plan' ELSE 'claimed' END AS decision FROM asked LEFT JOIN known k ON k.query_id = claimed""")
def plan_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of queries: refused for length, for characters, for not being planned, in that order."""
    rows = attempts(spark, sf_dir)
    n = F.col("creation_order")
    ending = F.when(n % 5 == 0, " x").when(n % 7 == 0, F.repeat(F.lit("q"), F.lit(300))).when(n % 3 == 0, "z").otherwise("")
    claims = rows.select("id", F.concat(F.coalesce("query_id", F.lit("")), ending).alias("query_id"))
    known = rows.where("query_id IS NOT NULL").select("query_id").distinct().withColumn("known", F.lit(True))
    rules = [(F.char_length("query_id") > 200, "too long"), (~F.col("query_id").rlike("^[A-Za-z0-9_-]{1,64}$"), "characters"), (F.col("known").isNull(), "not in plan")]
    return claims.join(known, "query_id", "left").select("id", validate.first_rule(rules, F.lit("claimed")).alias("decision"))


@query("""SELECT row_id, coalesce(normalized_content_sha256 = sha256(normalized_content), true) AND coalesce(normalized_sha256 = normalized_content_sha256, true) AS agrees, source_tree_exhausted IS NOT DISTINCT FROM (len(coalesce(json_extract(CASE WHEN json_type(normalized_content) = 'VARCHAR' THEN CAST(json_extract_string(normalized_content, '$') AS JSON) ELSE CAST(normalized_content AS JSON) END, '$.unresolvedMore[*]'), [])) = 0) AS complete
    FROM conversation_versions WHERE json_valid(normalized_content)""")
def version_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored digests against computed ones, missing ones agree; and whether a tree said to be exhausted has no placeholders left."""
    rows = table(spark, sf_dir, "conversation_versions").select("row_id", "normalized_content", "normalized_content_sha256", "normalized_sha256", "source_tree_exhausted", _variant(F.col("normalized_content")).alias("doc")).where("doc IS NOT NULL")
    same = lambda a, b: F.coalesce(a == b, F.lit(True))
    left = F.coalesce(F.size(F.from_json(F.to_json(F.try_variant_get("doc", "$.unresolvedMore", "variant")), "array<string>")), F.lit(0))
    return rows.select("row_id", (same(F.col("normalized_content_sha256"), F.sha2("normalized_content", 256)) & same(F.col("normalized_sha256"), F.col("normalized_content_sha256"))).alias("agrees"), F.col("source_tree_exhausted").eqNullSafe(left <= 0).alias("complete"))


def _artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = _variant(F.col("raw_artifact"))
    rows = attempts(spark, sf_dir).where("raw_artifact IS NOT NULL").select("id", "workspace_id", "discovery_run_id", "raw_artifact", doc.alias("doc")).where("doc IS NOT NULL")
    return rows.select("id", "workspace_id", "discovery_run_id", member_text(F.col("doc"), "$.filename").alias("name"), whole_number(F.col("doc"), "$.bytes").alias("length"), member_text(F.col("doc"), "$.sha256").alias("sha256"), F.octet_length("raw_artifact").cast("long").alias("real_length"), F.sha2("raw_artifact", 256).alias("real_sha256"))


_ARTIFACTS = f"{ATTEMPTS}, art AS (SELECT id, workspace_id, discovery_run_id, raw_artifact, json_extract_string(j, '$.filename') AS name, TRY_CAST(json_extract_string(j, '$.bytes') AS BIGINT) AS length, json_extract_string(j, '$.sha256') AS sha256, strlen(raw_artifact) AS real_length, sha256(raw_artifact) AS real_sha256 FROM (SELECT id, workspace_id, discovery_run_id, raw_artifact, {_UNWRAPPED} AS j FROM attempts WHERE raw_artifact IS NOT NULL AND json_valid(raw_artifact)))"


@query(f"WITH {_ARTIFACTS} SELECT id, coalesce(name IS NOT NULL AND length = real_length AND sha256 = real_sha256, false) AS verified FROM art")
def verified_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of every bundle against its manifest: same names, lengths and digests."""
    rows = _artifacts(spark, sf_dir)
    manifest = rows.select(F.col("id").alias("bundle"), "name", "length", "sha256")
    files = rows.select(F.col("id").alias("bundle"), "name", F.col("real_length").alias("length"), F.col("real_sha256").alias("sha256"))
    return validate.verified_artifacts(manifest, files).select(F.col("bundle").alias("id"), "verified")


@query(f"""WITH {_ARTIFACTS}, b AS (SELECT workspace_id, discovery_run_id, sha256('{{"artifacts":[' || string_agg('{{"name":"' || name || '","sha256":"' || real_sha256 || '","size":' || real_length || '}}', ',' ORDER BY name, real_sha256) || '],"manifest_version":1}}') AS bundle_sha256, count(*) AS artifacts FROM art WHERE name IS NOT NULL AND discovery_run_id IS NOT NULL GROUP BY 1, 2)
    SELECT discovery_run_id, workspace_id, artifacts, bundle_sha256, 'workspaces/' || workspace_id || '/evidence/' || bundle_sha256 AS storage_key FROM b""")
def bundle_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest per run and workspace, its artifacts sorted by name, with its digest and storage key."""
    entry = F.concat(F.lit('{"name":"'), F.col("name"), F.lit('","sha256":"'), F.col("real_sha256"), F.lit('","size":'), F.col("real_length").cast("string"), F.lit("}"))
    rows = _artifacts(spark, sf_dir).where("name IS NOT NULL AND discovery_run_id IS NOT NULL").select("workspace_id", "discovery_run_id", F.struct("name", "real_sha256", entry.alias("entry")).alias("a"))
    sorted_entries = F.concat_ws(",", F.transform(F.array_sort(F.collect_list("a")), lambda a: a["entry"]))
    made = rows.groupBy("workspace_id", "discovery_run_id").agg(F.sha2(F.concat(F.lit('{"artifacts":['), sorted_entries, F.lit('],"manifest_version":1}')), 256).alias("bundle_sha256"), F.count("*").alias("artifacts"))
    return made.select("discovery_run_id", "workspace_id", "artifacts", "bundle_sha256", F.concat(F.lit("workspaces/"), "workspace_id", F.lit("/evidence/"), "bundle_sha256").alias("storage_key"))


@query(f"""WITH {ATTEMPTS}, u AS (SELECT id, source_url, source_url || '?token=abc&x=1' AS shown FROM attempts WHERE source_url IS NOT NULL)
    SELECT id, regexp_replace(regexp_replace(shown, '([?&])(?:solution|js_challenge|token|jsc_orig_r)=[^&#]*&?', '\\1', 'g'), '[?&]$', '') AS redacted, regexp_replace(source_url, '/$', '') || '.json?limit=500&raw_json=1&sort=confidence' AS json_url, coalesce(nullif(lower(regexp_extract(source_url, '^https?://([^/?#:]+)', 1)), ''), 'configured-endpoint') AS endpoint FROM u""")
def url_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """addresses without secret parameters, the JSON address of a thread, and the label of an endpoint."""
    rows = attempts(spark, sf_dir).where("source_url IS NOT NULL")
    host = F.lower(F.try_parse_url("source_url", F.lit("HOST")))
    return rows.select("id", text.without_secret_params(F.concat("source_url", F.lit("?token=abc&x=1"))).alias("redacted"), text.thread_json_url(F.col("source_url")).alias("json_url"), F.coalesce(text.text_or_null(host), F.lit("configured-endpoint")).alias("endpoint"))


@query(f"""WITH {_ARTIFACTS} SELECT id, CASE lower(regexp_extract(name, '\\.([A-Za-z0-9]+)$', 1)) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.MEDIA_TYPES.items())} ELSE 'application/octet-stream' END AS media_type,
    coalesce(regexp_matches(name, '^[^/\\\\]+(/[^/\\\\]+)*$') AND NOT regexp_matches(name, '(^|/)\\.{{1,2}}(/|$)') AND strlen(name) <= 255, false) AS name_ok FROM art WHERE name IS NOT NULL""")
def artifact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media types by file name, and names in canonical form."""
    return _artifacts(spark, sf_dir).where("name IS NOT NULL").select("id", text.media_type(F.col("name")).alias("media_type"), text.artifact_name_ok(F.col("name")).alias("name_ok"))


@query("SELECT doc_id, len(list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS lines FROM documents WHERE text IS NOT NULL")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: lines of each text, trimmed, blank ones dropped."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(text.lines(F.col("text"))).cast("long").alias("lines"))


@query("SELECT row_id, CASE WHEN row_id % 3 = 0 THEN NULL ELSE CAST(epoch_us(fetched_at) // 1000000 AS BIGINT) END AS parsed FROM deep_comments WHERE fetched_at IS NOT NULL")
def strict_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of times with a zone are read, those without give null."""
    shown = F.concat(F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("row_id") % 3 == 0, "").when(F.col("row_id") % 3 == 1, "Z").otherwise("+00:00"))
    rows = table(spark, sf_dir, "deep_comments").where("fetched_at IS NOT NULL").select("row_id", shown.alias("shown"))
    return rows.select("row_id", F.unix_seconds(times.strict_timestamp(F.col("shown"))).alias("parsed"))


@query("SELECT event_id, sha256(CAST(json(props) AS VARCHAR)) AS digest FROM events WHERE json_valid(props)")
def ascii_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3: digest of canonical JSON in ASCII."""
    return table(spark, sf_dir, "events").select("event_id", ids.ascii_json_digest(F.col("props")).alias("digest")).where("digest IS NOT NULL")


@query(f"""WITH {ATTEMPTS}, found AS (SELECT discovery_run_id AS run, list_sort(list_distinct(flatten(list(list_transform(candidates, lambda c: c.external_source_id))))) AS ids FROM attempts WHERE capability = 'discovery' AND len(candidates) > 0 GROUP BY 1), got AS (SELECT discovery_run_id AS run, list_sort(list_distinct(list(external_source_id))) AS ids FROM attempts WHERE capability = 'thread_fetch' AND external_source_id IS NOT NULL GROUP BY 1)
    SELECT f.run, list_filter(f.ids, lambda x: x IS NOT NULL) = coalesce(g.ids, []) AS same_ids FROM found f LEFT JOIN got g ON f.run = g.run""")
def same_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run fetched exactly the threads it found."""
    found = candidates(spark, sf_dir).where("external_id IS NOT NULL").groupBy("run").agg(F.collect_set("external_id").alias("found"))
    got = attempts(spark, sf_dir).where("capability = 'thread_fetch' AND external_source_id IS NOT NULL").groupBy(F.col("discovery_run_id").alias("run")).agg(F.collect_set("external_source_id").alias("got"))
    return found.join(got, "run", "left").select("run", sets.same_members(F.col("found"), F.coalesce("got", F.array().cast("array<string>"))).alias("same_ids"))


#: Labels and tones of the interface.
ACTION_LABELS = {"ignore": "Ignore", "monitor": "Monitor", "reply_helpfully": "Reply helpfully", "reply_with_product": "Reply with product", "content_opportunity": "Content opportunity"}
STATUS_LABELS = {"open": "Open", "saved": "Saved", "dismissed": "Dismissed", "acted_on": "Acted on"}


def _mapped(c: Column, names: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[c]


def _case(c: str, names: dict[str, str]) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


@query(f"WITH {LATEST}, {FACTS} SELECT l.id, {_case('l.status', STATUS_LABELS)} AS status_label, {_case('f.recommended_action', ACTION_LABELS)} AS action_label FROM latest l LEFT JOIN facts f ON f.id = l.analysis_id")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the labels of statuses and actions; unknown ones have none."""
    known = facts(spark, sf_dir).select(F.col("id").alias("analysis_id"), "recommended_action")
    return latest(spark, sf_dir).join(known, "analysis_id", "left").select("id", _mapped(F.col("status"), STATUS_LABELS).alias("status_label"), _mapped(F.col("recommended_action"), ACTION_LABELS).alias("action_label"))


@query(f"WITH {ATTEMPTS} SELECT id, CASE WHEN status = 'success' THEN 'success' WHEN status IN ('no_results', 'incomplete') THEN 'warning' ELSE 'danger' END AS tone FROM attempts")
def tones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how an attempt's status is toned: usable evidence is never danger."""
    s = F.col("status")
    return attempts(spark, sf_dir).select("id", F.when(s == "success", "success").when(s.isin("no_results", "incomplete"), "warning").otherwise("danger").alias("tone"))


_TASK = "task.v1"


def _judge(rationales: pd.Series, relevance: pd.Series) -> pd.DataFrame:
    """A stand-in for a model: the length of a rationale, and a failure where there is nothing to read."""
    sizes = rationales.str.len()
    return pd.DataFrame({"size": sizes, "failure_class": [None if isinstance(r, str) and r.strip() else "model_input_empty" for r in rationales]})


@query(f"""WITH {FACTS}, t AS (SELECT id, CASE WHEN rationale IS NULL OR trim(rationale) = '' THEN 'model_input_empty' WHEN length(rationale) > 120 THEN 'too long' END AS failure, length(rationale) AS size FROM facts) SELECT id, CASE WHEN failure IS NULL THEN size END AS size, failure, 'task.v1' AS task_version FROM t""")
def model_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed task over every analysis: its fields where they are valid, the failure where not, recorded either way."""
    rows = facts(spark, sf_dir).select("id", "rationale", "relevance")
    done = tasks.run_task(rows, ["rationale", "relevance"], [T.StructField("size", T.LongType())], _judge, [(F.col("size") > 120, "too long")], _TASK)
    return done.select("id", "size", "failure", "task_version")


@query(f"WITH {FACTS}, done AS (SELECT DISTINCT campaign_id, conversation_id, analysis_identity FROM facts WHERE creation_order % 2 = 0) SELECT id FROM facts f WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.campaign_id = f.campaign_id AND d.conversation_id = f.conversation_id AND d.analysis_identity = f.analysis_identity)")
def tasks_to_do(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: subjects whose campaign, conversation and task version have no recorded result yet; every other result is recorded here."""
    rows = facts(spark, sf_dir).select("id", "campaign_id", "conversation_id", "analysis_identity", "creation_order")
    done = rows.where("creation_order % 2 = 0").select("campaign_id", "conversation_id", "analysis_identity").distinct()
    return tasks.not_yet_done(rows, done, ["campaign_id", "conversation_id", "analysis_identity"]).select("id")


@query(f"""WITH {FACTS} SELECT id, analysis_identity || ':task@v1' AS identity, sha256('{{"campaign_id":"' || campaign_id || '","conversation_version_id":"' || conversation_id || '","task":"' || analysis_identity || '"}}') AS input_digest,
    CASE WHEN confidence > 0.8 AND persona IS NOT NULL THEN 'strong' WHEN topic IS NOT NULL THEN 'ordinary' END AS served_tier, CASE WHEN rationale IS NULL THEN 'invalid_output' WHEN topic IS NULL THEN 'schema_violation' WHEN isnan(relevance) OR relevance < 0 OR relevance > 1 THEN 'domain_violation' END AS failure_class FROM facts WHERE campaign_id IS NOT NULL AND conversation_id IS NOT NULL AND analysis_identity IS NOT NULL""")
def task_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity and input digest of a task, the tier that serves it (strong, else ordinary, else none), and the class of a failure."""
    rows = facts(spark, sf_dir).where("campaign_id IS NOT NULL AND conversation_id IS NOT NULL AND analysis_identity IS NOT NULL")
    whole = F.to_json(F.struct("campaign_id", F.col("conversation_id").alias("conversation_version_id"), F.col("analysis_identity").alias("task")))
    tier = F.when((F.col("confidence") > 0.8) & F.col("persona").isNotNull(), "strong").when(F.col("topic").isNotNull(), "ordinary")
    failure = validate.first_rule([(F.col("rationale").isNull(), "invalid_output"), (F.col("topic").isNull(), "schema_violation"), (F.isnan("relevance") | (F.col("relevance") < 0) | (F.col("relevance") > 1), "domain_violation")])
    return rows.select("id", F.concat("analysis_identity", F.lit(":task@v1")).alias("identity"), F.sha2(whole, 256).alias("input_digest"), tier.alias("served_tier"), failure.alias("failure_class"))


@query(f"""WITH {ATTEMPTS} SELECT id, CASE WHEN capability IS NULL OR capability NOT IN ('discovery', 'thread_fetch') THEN 'capability' WHEN NOT coalesce(regexp_matches(provider_variant, '^[a-z0-9-]+/v[0-9]+$'), false) THEN 'variant' WHEN coalesce(elapsed_ms, 0) > 180000 THEN 'timeout' ELSE 'valid' END AS verdict, sha256(coalesce(capability, '') || chr(10) || coalesce(provider_variant, '')) AS config_sha256 FROM attempts""")
def config_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider configuration of each attempt by its shape rules, with the digest of its text."""
    rules = [(F.col("capability").isNull() | ~F.col("capability").isin("discovery", "thread_fetch"), "capability"), (~F.coalesce(F.col("provider_variant").rlike("^[a-z0-9-]+/v[0-9]+$"), F.lit(False)), "variant"), (F.coalesce("elapsed_ms", F.lit(0)) > 180000, "timeout")]
    digest = F.sha2(F.concat(F.coalesce("capability", F.lit("")), F.lit("\n"), F.coalesce("provider_variant", F.lit(""))), 256)
    return attempts(spark, sf_dir).select("id", validate.first_rule(rules, F.lit("valid")).alias("verdict"), digest.alias("config_sha256"))


@query(f"""WITH {ATTEMPTS} SELECT discovery_run_id, query_id, string_agg(coalesce(status, 'missing') || '(' || coalesce(CAST(candidate_count AS VARCHAR), '0') || ')', ' ' ORDER BY creation_order, id) AS cells, sum(CASE WHEN elapsed_ms >= 0 THEN elapsed_ms END) AS elapsed_ms, max(elapsed_ms) AS peak_ms, count(*) AS responses FROM attempts WHERE query_id IS NOT NULL AND discovery_run_id IS NOT NULL GROUP BY 1, 2""")
def run_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of each query of a run: cells of status and count, sums, peaks and counters."""
    rows = attempts(spark, sf_dir).where("query_id IS NOT NULL AND discovery_run_id IS NOT NULL")
    cell = F.concat(F.coalesce("status", F.lit("missing")), F.lit("("), F.coalesce(F.col("candidate_count").cast("string"), F.lit("0")), F.lit(")"))
    cells = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("creation_order", "id", cell.alias("cell")))), lambda x: x["cell"]))
    return rows.groupBy("discovery_run_id", "query_id").agg(cells.alias("cells"), F.sum(F.when(F.col("elapsed_ms") >= 0, F.col("elapsed_ms"))).alias("elapsed_ms"), F.max("elapsed_ms").alias("peak_ms"), F.count("*").alias("responses"))


_LAST_COMMENT = "last AS (SELECT * FROM deep_comments WHERE id IS NOT NULL AND thread_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST, row_id DESC) = 1)"


@query(f"""WITH {_LAST_COMMENT}, best AS (SELECT id, thread_id FROM last WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY score DESC, id) <= 10), early AS (SELECT DISTINCT thread_id, id FROM deep_comments WHERE fetched_at < (SELECT max(fetched_at) FROM deep_comments) - INTERVAL 10 DAY)
    SELECT b.thread_id, count(*) AS best, count(e.id) AS had_early, count(e.id) / count(*) AS recall FROM best b LEFT JOIN early e ON e.thread_id = b.thread_id AND e.id = b.id GROUP BY 1""")
def top_comment_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each thread's ten best comments, how many an early extraction had already."""
    rows = table(spark, sf_dir, "deep_comments").where("id IS NOT NULL AND thread_id IS NOT NULL").select("id", "thread_id", "score", "fetched_at", "row_id")
    last = dedupe.last_by(rows, ["id"], ["fetched_at", "row_id"])
    best = dedupe.top_by(last.where("score IS NOT NULL"), ["thread_id"], [F.desc("score"), F.asc("id")], 10).select("thread_id", "id")
    newest = table(spark, sf_dir, "deep_comments").agg(F.max("fetched_at")).first()[0]  # the argument of the report
    early = rows.where(F.col("fetched_at") < F.lit(newest) - F.expr("INTERVAL 10 DAY")).select("thread_id", "id").distinct().withColumn("early", F.lit(1))
    return best.join(early, ["thread_id", "id"], "left").groupBy("thread_id").agg(F.count("*").alias("best"), F.count("early").alias("had_early"), (F.count("early") / F.count("*")).alias("recall"))


@query("SELECT row_id, score / greatest((epoch_us(fetched_at) - created_utc * 1000000) / 3.6e9, 1.0) AS velocity FROM deep_comments WHERE score IS NOT NULL AND created_utc IS NOT NULL AND fetched_at IS NOT NULL")
def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score per hour of age, of each extraction of a comment."""
    rows = table(spark, sf_dir, "deep_comments").where("score IS NOT NULL AND created_utc IS NOT NULL AND fetched_at IS NOT NULL")
    hours = F.greatest(times.age_hours(F.timestamp_seconds("created_utc"), F.col("fetched_at")), F.lit(1.0))
    return rows.select("row_id", (F.col("score") / hours).alias("velocity"))


@query(f"""WITH {LATEST} SELECT campaign_id, count(*) AS opportunities, count(CASE WHEN status = 'open' THEN 1 END) AS open_ones, max(opportunity_score) AS best_score FROM latest WHERE campaign_id IS NOT NULL AND NOT isnan(coalesce(opportunity_score, 0)) GROUP BY 1""")
def campaign_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each campaign in numbers."""
    rows = latest(spark, sf_dir).where("campaign_id IS NOT NULL AND NOT isnan(coalesce(opportunity_score, 0))")
    return rows.groupBy("campaign_id").agg(F.count("*").alias("opportunities"), F.count_if(F.col("status") == "open").alias("open_ones"), F.max("opportunity_score").alias("best_score"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS s, lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events)
    SELECT event_id, n AS place, coalesce((s - before) // 15, 0) AS keepalives, n > total - 100 AS replayed FROM e""")
def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4, M5: the stream of each scope: the place of each event, keepalives due in the silence before it (one in 15 seconds), and whether a late subscriber still gets it (the last hundred)."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = table(spark, sf_dir, "events").select("event_id", F.row_number().over(by).cast("long").alias("place"), F.coalesce(F.floor((seconds - F.lag(seconds).over(by)) / 15), F.lit(0)).alias("keepalives"), F.count("*").over(Window.partitionBy("user_id")).alias("total"))
    return rows.select("event_id", "place", "keepalives", (F.col("place") > F.col("total") - 100).alias("replayed"))


@query(f"""WITH {ATTEMPTS}, open AS (SELECT discovery_run_id AS run, max(coalesce(started_at, created_at)) AS since, max(coalesce(elapsed_ms, 0)) AS longest FROM attempts WHERE discovery_run_id IS NOT NULL GROUP BY 1), late AS (SELECT run FROM open WHERE since < (SELECT max(created_at) FROM attempts) - to_seconds(CAST(greatest(3 * longest / 1000, 900) AS BIGINT)))
    SELECT run, 'discovery_run.reaped' AS action, 'running' AS before, 'failed' AS after FROM late""")
def reaped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs open for longer than the larger of three time limits and 900 seconds, each with the audit row that is appended once."""
    from evidra.plans.streams import scratch
    from evidra.sources.writers import append_once

    rows = attempts(spark, sf_dir).where("discovery_run_id IS NOT NULL")
    now = attempts(spark, sf_dir).agg(F.max("created_at").cast("timestamp")).first()[0]  # the argument of the job
    runs = rows.groupBy(F.col("discovery_run_id").alias("run")).agg(F.max(F.coalesce("started_at", "created_at")).alias("since"), F.max(F.coalesce("elapsed_ms", F.lit(0))).alias("longest"))
    limit = F.greatest(F.floor(3 * F.col("longest") / 1000), F.lit(900))
    late = runs.where(F.unix_micros(F.col("since").cast("timestamp")) < F.unix_micros(F.lit(now)) - limit * 1_000_000)
    audit, path = late.select("run", F.lit("discovery_run.reaped").alias("action"), F.lit("running").alias("before"), F.lit("failed").alias("after")), scratch(spark, "audit")
    for _ in range(2):  # the job runs again, the audit does not
        append_once(audit, path, ["run", "action"], ["before"])
    return spark.read.parquet(path)


@query(f"""WITH {ATTEMPTS}, p AS (SELECT DISTINCT workspace_id, query_id FROM attempts WHERE query_id IS NOT NULL) SELECT workspace_id, query_id, CAST(NULL AS VARCHAR) AS problem FROM p UNION ALL SELECT DISTINCT workspace_id, 'bad id', 'id' FROM p""")
def plan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query plans written as files, one per workspace with one bad id each, and read back with the rule they break."""
    from evidra.plans.streams import scratch
    from evidra.sources.readers import query_plans

    known = attempts(spark, sf_dir).where("query_id IS NOT NULL").select("workspace_id", "query_id").distinct()
    named = known.unionByName(known.select("workspace_id").distinct().withColumn("query_id", F.lit("bad id")))
    entry = F.struct(F.col("query_id").alias("id"), F.lit("p").alias("pattern"), F.lit("some words").alias("query"), F.array(F.lit("a")).alias("subreddits"))
    plans = named.groupBy("workspace_id").agg(F.collect_list(entry).alias("queries")).select(F.lit(1).alias("schemaVersion"), F.col("workspace_id").alias("campaignContext"), "queries", "workspace_id")
    path = scratch(spark, "plans")
    plans.write.partitionBy("workspace_id").json(path)
    found = query_plans(spark, f"{path}/*/*.json")
    return found.select(F.regexp_extract("file", "workspace_id=([^/]+)", 1).alias("workspace_id"), F.col("id").alias("query_id"), "problem")


@query(f"WITH {ATTEMPTS}, d AS (SELECT id, {_UNWRAPPED} AS j FROM attempts WHERE raw_artifact IS NOT NULL AND json_valid(raw_artifact)) SELECT json_extract_string(j, '$.sha256') AS sha256, count(*) AS files FROM d WHERE json_extract_string(j, '$.sha256') IS NOT NULL GROUP BY 1")
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artifacts written as files and read back whole, parsed, with their declared digests."""
    from evidra.plans.streams import scratch
    from evidra.sources.readers import whole_texts

    path = scratch(spark, "documents")
    doc = _variant(F.col("raw_artifact"))
    rows = attempts(spark, sf_dir).where("raw_artifact IS NOT NULL").select(F.to_json(F.struct(member_text(doc, "$.sha256").alias("sha256"))).alias("value"), doc.alias("doc")).where("doc IS NOT NULL").select("value")
    rows.write.text(path)
    lines = whole_texts(spark, path).select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return lines.select(F.try_variant_get(F.try_parse_json("line"), "$.sha256", "string").alias("sha256")).where("sha256 IS NOT NULL").groupBy("sha256").agg(F.count("*").alias("files"))


QUERIES, SQL = query.queries, query.sql
