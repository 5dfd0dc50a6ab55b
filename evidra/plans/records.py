"""Queries over record shapes: eligibility, manifests, public rows, labels, subtree sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import text
from evidra.functions.json_columns import member_text, whole_number
from evidra.operators.hierarchy import hierarchy, latest_nodes
from evidra.operators.validate import first_rule
from evidra.plans.evidence import ATTEMPTS, FACTS, LATEST, attempts, facts, latest
from evidra.plans.problems import WALK
from evidra.plans.registry import Registry
from evidra.session import table

query = Registry()


@query(f"""WITH {ATTEMPTS} SELECT id, CASE WHEN capability <> 'thread_fetch' THEN 'other capability' WHEN status NOT IN ('success', 'incomplete') THEN 'not usable' WHEN evidence_state IS DISTINCT FROM 'bundle' THEN 'no bundle' WHEN coalesce(external_source_id, '') = '' THEN 'no id' ELSE 'eligible' END AS eligibility FROM attempts""")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an attempt can become a version, or the first reason against it."""
    rules = [(F.col("capability") != "thread_fetch", "other capability"), (~F.col("status").isin("success", "incomplete"), "not usable"), (~F.col("evidence_state").eqNullSafe(F.lit("bundle")), "no bundle"), (F.coalesce("external_source_id", F.lit("")) == "", "no id")]
    return attempts(spark, sf_dir).select("id", first_rule(rules, F.lit("eligible")).alias("eligibility"))


_UNWRAPPED = "CASE WHEN json_type(raw_artifact) = 'VARCHAR' THEN CAST(json_extract_string(raw_artifact, '$') AS JSON) ELSE CAST(raw_artifact AS JSON) END"


def _variant(c: Column) -> Column:
    """JSON text as a VARIANT, also when it is JSON within a JSON string."""
    doc = F.try_parse_json(c)
    return F.coalesce(F.when(F.schema_of_variant(doc) == "STRING", F.try_parse_json(F.try_variant_get(doc, "$", "string"))), doc)


@query(f"""WITH {ATTEMPTS}, docs AS (SELECT id, {_UNWRAPPED} AS j FROM attempts WHERE raw_artifact IS NOT NULL AND json_valid(raw_artifact)), f AS (SELECT id, json_extract_string(j, '$.filename') AS name, json_extract_string(j, '$.path') AS path, json_extract_string(j, '$.sha256') AS sha, TRY_CAST(json_extract_string(j, '$.bytes') AS BIGINT) AS bytes FROM docs)
    SELECT id, CASE WHEN coalesce(name, '') = '' OR position('/' IN name) > 0 THEN 'name' WHEN coalesce(path, '') = '' OR path LIKE '/%' OR path LIKE '%..%' THEN 'path' WHEN bytes IS NULL OR bytes < 0 THEN 'bytes' WHEN NOT coalesce(regexp_matches(sha, '^[0-9a-f]{{64}}$'), false) THEN 'digest' ELSE 'valid' END AS verdict FROM f""")
def artifact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared artifacts, valid or the first rule they break."""
    from evidra.functions.ids import is_digest

    doc = _variant(F.col("raw_artifact"))
    rows = attempts(spark, sf_dir).where("raw_artifact IS NOT NULL").select("id", doc.alias("doc")).where("doc IS NOT NULL")
    f = rows.select("id", member_text(F.col("doc"), "$.filename").alias("name"), member_text(F.col("doc"), "$.path").alias("path"), member_text(F.col("doc"), "$.sha256").alias("sha"), whole_number(F.col("doc"), "$.bytes").alias("bytes"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = [(blank("name") | F.col("name").contains("/"), "name"), (blank("path") | F.col("path").startswith("/") | F.col("path").contains(".."), "path"), (F.col("bytes").isNull() | (F.col("bytes") < 0), "bytes"), (~is_digest(F.col("sha")), "digest")]
    return f.select("id", first_rule(rules, F.lit("valid")).alias("verdict"))


@query("""WITH docs AS (SELECT row_id, CASE WHEN json_type(normalized_content) = 'VARCHAR' THEN CAST(json_extract_string(normalized_content, '$') AS JSON) ELSE CAST(normalized_content AS JSON) END AS j FROM conversation_versions WHERE json_valid(normalized_content))
    SELECT row_id, json_extract_string(j, '$.post.title') AS title, CASE WHEN json_extract_string(j, '$.post.permalink') LIKE '/%' THEN 'https://threads.example' || json_extract_string(j, '$.post.permalink') END AS url, TRY_CAST(json_extract_string(j, '$.post.score') AS BIGINT) AS score FROM docs""")
def public_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that may be shown, by an allow-list, strictly typed."""
    rows = table(spark, sf_dir, "conversation_versions").select("row_id", _variant(F.col("normalized_content")).alias("doc")).where("doc IS NOT NULL")
    return rows.select("row_id", member_text(F.col("doc"), "$.post.title").alias("title"), text.site_url("https://threads.example", member_text(F.col("doc"), "$.post.permalink")).alias("url"), whole_number(F.col("doc"), "$.post.score").alias("score"))


@query(f"""WITH {ATTEMPTS} SELECT id, coalesce(nullif(concat_ws(', ', candidate_count || ' candidates', elapsed_ms || ' ms'), ''), '—') AS usage, concat_ws(' · ', nullif(trim(provider_variant), ''), nullif(trim(capability), ''), nullif(trim(status), '')) AS provenance FROM attempts""")
def attempt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured usage and provenance in words."""
    return attempts(spark, sf_dir).select("id", text.usage_label((F.col("candidate_count"), "candidates"), (F.col("elapsed_ms"), "ms")).alias("usage"), text.joined_line(F.col("provider_variant"), F.col("capability"), F.col("status")).alias("provenance"))


@query("""WITH b AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g') AS body FROM documents) SELECT doc_id, CASE WHEN body = '' OR regexp_matches(body, '(?i)unusual traffic|bot challenge|verify (?:you are|that you are) human|duckduckgo.*anomaly|whoa there, pardner|you(?:''ve| have) been blocked') THEN 0 WHEN length(body) < 80 THEN 1 WHEN length(body) < 400 THEN 2 WHEN position(chr(10) || chr(10) IN body) = 0 THEN 3 ELSE 4 END AS level FROM b""")
def content_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """how much each text holds."""
    return table(spark, sf_dir, "documents").select("doc_id", text.content_level(F.col("text")).alias("level"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]+'))) AS numbers FROM documents")
def distinct_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct matches of a pattern in each text."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([0-9]+)"), 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(found)).cast("long").alias("numbers"))


@query(f"""WITH {LATEST}, {FACTS} SELECT l.id, CASE WHEN l.analysis_id IS NULL OR f.id IS NULL THEN 'no subject' WHEN l.post_created_at IS NULL THEN 'no time' WHEN l.conversation_id IN (SELECT conversation_id FROM conversation_versions) THEN 'ready' ELSE 'no version' END AS check_result FROM latest l LEFT JOIN facts f ON l.analysis_id = f.id""")
def pre_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: cheap checks before a dear step, the first that fails."""
    f = facts(spark, sf_dir).select(F.col("id").alias("analysis_id"), F.lit(True).alias("subject"))
    v = table(spark, sf_dir, "conversation_versions").select("conversation_id").distinct().withColumn("version", F.lit(True))
    joined = latest(spark, sf_dir).join(f, "analysis_id", "left").join(v, "conversation_id", "left")
    rules = [(F.col("subject").isNull(), "no subject"), (F.col("post_created_at").isNull(), "no time"), (F.col("version"), "ready")]
    return joined.select("id", first_rule(rules, F.lit("no version")).alias("check_result"))


@query(f"""WITH {ATTEMPTS}, n AS (SELECT discovery_run_id, status, count(*) AS n FROM attempts WHERE status IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT DISTINCT discovery_run_id, 'reaped', 1 FROM attempts) SELECT discovery_run_id, string_agg(status || '=' || n, ',' ORDER BY status) AS metrics FROM n GROUP BY 1""")
def merged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flag merged into a map of metrics."""
    from evidra.operators.rollup import histogram_map

    rows = attempts(spark, sf_dir)
    counts = histogram_map(rows, ["discovery_run_id"], "status")
    runs = rows.select("discovery_run_id").distinct().join(counts, "discovery_run_id", "left")
    merged = F.map_concat(F.coalesce("counts", F.create_map().cast("map<string,bigint>")), F.create_map(F.lit("reaped"), F.lit(1).cast("long")))
    return runs.select("discovery_run_id", F.array_join(F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("metrics"))


@query(WALK + """, above AS (SELECT s.id, unnest(s.path) AS node FROM stops s JOIN linked t ON t.id = s.top WHERE t.ends IS NOT NULL), value AS (SELECT id, coalesce(score, 0) AS score FROM nodes)
    SELECT 't1_' || a.node AS id, count(*) AS comments, CAST(sum(v.score) AS BIGINT) AS score FROM above a JOIN value v ON a.id = v.id GROUP BY 1""")
def subtree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each comment the number and the scores of its whole subtree, itself included; cycles have none."""
    nodes = latest_nodes(table(spark, sf_dir, "deep_comments"), "id", "parent_id", "thread_id", "fetched_at", "row_id", "score")
    found = hierarchy(nodes, value="kept").where("chain_end <> 'cycle'")
    return found.select(F.concat(F.lit("t1_"), "node").alias("id"), (F.col("below") + 1).alias("comments"), F.col("total").alias("score"))


@query("SELECT name FROM workspaces ORDER BY name")
def workspace_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: names in order, for a filter."""
    return table(spark, sf_dir, "workspaces").select("name").orderBy("name")


@query(f"""WITH {LATEST}, {FACTS} SELECT l.id, '- ' || f.topic || ': ' || CASE WHEN length(regexp_replace(trim(f.rationale), '\\s+', ' ', 'g')) > 120 THEN substr(regexp_replace(trim(f.rationale), '\\s+', ' ', 'g'), 1, 119) || '…' ELSE regexp_replace(trim(f.rationale), '\\s+', ' ', 'g') END || ' (' || coalesce(f.persona, 'anyone') || ')' AS line FROM latest l JOIN facts f ON l.analysis_id = f.id WHERE f.topic IS NOT NULL AND f.rationale IS NOT NULL""")
def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of context for each opportunity, collapsed and clipped."""
    f = facts(spark, sf_dir).where("topic IS NOT NULL AND rationale IS NOT NULL").select(F.col("id").alias("analysis_id"), "topic", "rationale", "persona")
    line = F.concat(F.lit("- "), F.col("topic"), F.lit(": "), text.clip(text.collapse(F.col("rationale")), 120), F.lit(" ("), F.coalesce("persona", F.lit("anyone")), F.lit(")"))
    return latest(spark, sf_dir).join(f, "analysis_id").select("id", line.alias("line"))


QUERIES, SQL = query.queries, query.sql
