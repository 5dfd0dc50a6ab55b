"""Queries that write and read back, and those that put rows of several tables in their final shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import text, times
from evidra.functions.json_columns import member_text
from evidra.operators import dedupe, measures, validate
from evidra.plans.evidence import AS_OF, ATTEMPTS, CANDIDATES, FACTS, LATEST, attempts, candidates, facts, latest
from evidra.plans.records import _UNWRAPPED, _variant
from evidra.plans.registry import Registry
from evidra.plans.streams import scratch
from evidra.session import table
from evidra.sources import readers, writers

query = Registry()


@query(f"WITH {ATTEMPTS} SELECT discovery_run_id AS run, count(*) AS rows FROM attempts WHERE discovery_run_id IS NOT NULL GROUP BY 1")
def published_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table published under the digest of its content; publishing it again leaves it alone."""
    rows = attempts(spark, sf_dir).where("discovery_run_id IS NOT NULL").groupBy(F.col("discovery_run_id").alias("run")).agg(F.count("*").alias("rows"))
    digest = rows.agg(F.sha2(F.sum(F.xxhash64("run", "rows").cast("decimal(38,0)")).cast("string"), 256)).first()[0] or "empty"
    folder = scratch(spark, "published")
    for _ in range(2):
        target = writers.publish(rows, folder, digest)
    return writers.stored(spark, target)


@query(f"WITH {ATTEMPTS} SELECT id, status, true AS refused FROM attempts")
def exclusive_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON into a new place; a second write to it is refused."""
    from pyspark.errors import AnalysisException

    rows, path = attempts(spark, sf_dir).select("id", "status"), scratch(spark, "exclusive")
    writers.write_json(rows, path)
    refused = False
    try:
        writers.write_json(rows, path)
    except AnalysisException:
        refused = True
    return spark.read.schema("id string, status string").json(path).withColumn("refused", F.lit(refused))


@query(f"WITH {ATTEMPTS} SELECT coalesce(status, '') || chr(9) || count(*) AS line FROM attempts GROUP BY status")
def tsv_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary rows appended as tab-separated lines."""
    path = scratch(spark, "tsv")
    writers.write_tsv(attempts(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query(f"""WITH {ATTEMPTS}, files AS (SELECT discovery_run_id AS run, coalesce(provider_variant, 'x') || '-' || id || '.json' AS path, created_at AS seen, {_UNWRAPPED} AS j FROM attempts WHERE raw_artifact IS NOT NULL AND json_valid(raw_artifact) AND created_at IS NOT NULL AND discovery_run_id IS NOT NULL),
    good AS (SELECT * FROM files WHERE json_type(j) = 'OBJECT') SELECT run, path, (SELECT count(*) FROM good g WHERE g.run = o.run) AS readable FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY NOT starts_with(regexp_extract(path, '[^/]*$'), 'v1'), seen DESC, path) AS n FROM good) o WHERE n = 1""")
def recovered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run's documents the first that parses: own prefix first, then the newest, then by path."""
    rows = attempts(spark, sf_dir).where("raw_artifact IS NOT NULL AND created_at IS NOT NULL AND discovery_run_id IS NOT NULL")
    path = F.concat(F.coalesce("provider_variant", F.lit("x")), F.lit("-"), F.col("id"), F.lit(".json"))
    files = rows.select(F.col("discovery_run_id").alias("run"), path.alias("path"), F.col("created_at").alias("modificationTime"), _variant(F.col("raw_artifact")).alias("document"), F.lit("v1").alias("prefix")).where("document IS NOT NULL")
    return readers.recovered_by(files, "run", "prefix")


@query(f"""WITH {ATTEMPTS} SELECT id, coalesce(status, 'failed') AS status, substr(coalesce(failure_reason, ''), 1, 500) AS failure_reason, coalesce(candidate_count, 0) AS candidate_count, coalesce(evidence_state, 'none') AS evidence_state, CASE WHEN evidence_state = 'bundle' THEN 'bundle' WHEN failure_class IS NOT NULL THEN 'unclassified' WHEN status IS NOT NULL THEN 'no evidence' ELSE 'unknown' END AS route FROM attempts""")
def observation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as they are appended: one constructor with defaults, reasons redacted, and where each is routed."""
    c = F.col
    route = F.when(c("evidence_state") == "bundle", "bundle").when(c("failure_class").isNotNull(), "unclassified").when(c("status").isNotNull(), "no evidence").otherwise("unknown")
    return attempts(spark, sf_dir).select("id", F.coalesce("status", F.lit("failed")).alias("status"), text.redact(F.coalesce("failure_reason", F.lit(""))).alias("failure_reason"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"), F.coalesce("evidence_state", F.lit("none")).alias("evidence_state"), route.alias("route"))


@query(f"""WITH {CANDIDATES}, first AS (SELECT run, external_id, url FROM items WHERE external_id <> '' QUALIFY row_number() OVER (PARTITION BY run, external_id ORDER BY creation_order, pos) = 1), there AS (SELECT DISTINCT discovery_run_id AS run, external_source_id AS external_id FROM attempts WHERE capability = 'thread_fetch')
    SELECT f.run, f.external_id, f.url, 'failed' AS status, 'contract_violation' AS failure_class FROM first f WHERE NOT EXISTS (SELECT 1 FROM there t WHERE t.run = f.run AND t.external_id = f.external_id)""")
def refused_fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed rows for work items that were never fetched, the first url of each, written once."""
    found = dedupe.first_by(candidates(spark, sf_dir).where("external_id <> ''"), ["run", "external_id"], ["creation_order", "pos"])
    there = attempts(spark, sf_dir).where("capability = 'thread_fetch'").select(F.col("discovery_run_id").alias("run"), F.col("external_source_id").alias("external_id"))
    rows = found.join(there, ["run", "external_id"], "left_anti").select("run", "external_id", "url", F.lit("failed").alias("status"), F.lit("contract_violation").alias("failure_class"))
    path = scratch(spark, "refused")
    for _ in range(2):
        writers.append_once(rows, path, ["run", "external_id"], ["url"])
    return spark.read.parquet(path)


@query(f"""WITH {ATTEMPTS} SELECT id, CASE WHEN evidence_state = 'bundle' THEN 'bundle' WHEN evidence_state = 'none' THEN 'none' ELSE 'legacy' END AS state, CASE WHEN evidence_state = 'bundle' THEN CASE WHEN raw_artifact IS NULL THEN 0 ELSE 1 END END AS artifact_count, evidence_state = 'bundle' AND raw_artifact IS NULL AND capability = 'thread_fetch' AS bundle_missing FROM attempts""")
def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by its state with the number of artifacts; a bundle that is said to be there and is not is marked."""
    c = F.col
    bundle = c("evidence_state") == "bundle"
    return attempts(spark, sf_dir).select("id", F.when(bundle, "bundle").when(c("evidence_state") == "none", "none").otherwise("legacy").alias("state"), F.when(bundle, F.when(c("raw_artifact").isNull(), 0).otherwise(1)).alias("artifact_count"), (bundle & c("raw_artifact").isNull() & (c("capability") == "thread_fetch")).alias("bundle_missing"))


@query(f"""WITH {CANDIDATES}, fetched AS (SELECT discovery_run_id AS run, external_source_id AS external_id, status FROM attempts WHERE capability = 'thread_fetch' AND external_source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY discovery_run_id, external_source_id ORDER BY creation_order DESC) = 1),
    talks AS (SELECT json_extract_string(CASE WHEN json_type(normalized_content) = 'VARCHAR' THEN CAST(json_extract_string(normalized_content, '$') AS JSON) ELSE CAST(normalized_content AS JSON) END, '$.post.id') AS external_id, conversation_id, id AS version_id FROM conversation_versions WHERE json_valid(normalized_content) QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY delivered_at DESC NULLS LAST, row_id DESC) = 1)
    SELECT i.run, i.creation_order, i.pos, i.external_id, f.status AS fetch_status, t.conversation_id, t.version_id FROM items i LEFT JOIN fetched f ON f.run = i.run AND f.external_id = i.external_id LEFT JOIN talks t ON t.external_id = i.external_id""")
def candidate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in their order with the run's fetch, and the discussion and its current version of any run."""
    rows = attempts(spark, sf_dir).where("capability = 'thread_fetch' AND external_source_id IS NOT NULL")
    fetched = dedupe.last_by(rows, ["discovery_run_id", "external_source_id"], ["creation_order"]).select(F.col("discovery_run_id").alias("run"), F.col("external_source_id").alias("external_id"), F.col("status").alias("fetch_status"))
    versions = table(spark, sf_dir, "conversation_versions").select(member_text(_variant(F.col("normalized_content")), "$.post.id").alias("external_id"), "conversation_id", F.col("id").alias("version_id"), "delivered_at", "row_id").where("external_id IS NOT NULL")
    talks = dedupe.last_by(versions, ["external_id"], ["delivered_at", "row_id"]).drop("delivered_at", "row_id")
    return candidates(spark, sf_dir).select("run", "creation_order", "pos", "external_id").join(fetched, ["run", "external_id"], "left").join(talks, "external_id", "left")


_HOURS = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(post_created_at)) / 3.6e9"


@query(f"""WITH {LATEST} SELECT id, CASE WHEN post_created_at IS NULL THEN '—' WHEN {_HOURS} < 1 THEN '<1 h' WHEN {_HOURS} < 48 THEN CAST(floor({_HOURS}) AS BIGINT) || ' h' ELSE CAST(floor({_HOURS} / 24) AS BIGINT) || ' d' END AS age, floor(opportunity_score * 100) / 100 AS shown_score, greatest(0, least(100, round(opportunity_score * 100))) AS width FROM latest WHERE opportunity_score IS NOT NULL AND NOT isnan(opportunity_score)""")
def inbox_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age labels, scores cut (not rounded) to two digits, and the width of their bar."""
    hours = times.age_hours(F.col("post_created_at"), F.lit(AS_OF).cast("timestamp_ntz"))
    rows = latest(spark, sf_dir).where("opportunity_score IS NOT NULL AND NOT isnan(opportunity_score)")
    width = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(F.col("opportunity_score") * 100)))
    return rows.select("id", text.age_label(hours).alias("age"), (F.floor(F.col("opportunity_score") * 100) / 100).alias("shown_score"), width.alias("width"))


@query(f"""WITH {ATTEMPTS}, n AS (SELECT discovery_run_id AS run, count(CASE WHEN candidate_count > 0 THEN 1 END) AS with_candidates, count(*) AS queries, count(CASE WHEN status NOT IN ('success', 'no_results', 'incomplete') THEN 1 END) AS failed, CAST(sum(CASE WHEN candidates IS NULL THEN 0 ELSE len(list_filter(candidates, lambda c: c.url IS NULL OR NOT regexp_matches(c.url, '^(?i:https?)://[^/?#]+'))) END) AS BIGINT) AS invalid_urls FROM attempts WHERE capability = 'discovery' AND discovery_run_id IS NOT NULL GROUP BY 1)
    SELECT run, with_candidates, queries, invalid_urls, with_candidates * 2 >= queries AND invalid_urls = 0 AS passed FROM n""")
def discovery_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run the queries with candidates and the candidates without a valid address; a run passes with half of its queries and no such address."""
    rows = attempts(spark, sf_dir).where("capability = 'discovery' AND discovery_run_id IS NOT NULL")
    bad = F.size(F.filter(F.coalesce("candidates", F.array().cast(rows.schema["candidates"].dataType)), lambda c: c["url"].isNull() | ~c["url"].rlike("^(?i:https?)://[^/?#]+")))
    n = rows.groupBy(F.col("discovery_run_id").alias("run")).agg(F.count_if(F.col("candidate_count") > 0).alias("with_candidates"), F.count("*").alias("queries"), F.sum(bad).cast("long").alias("invalid_urls"))
    return n.withColumn("passed", (F.col("with_candidates") * 2 >= F.col("queries")) & (F.col("invalid_urls") == 0))


@query(f"WITH {LATEST}, {FACTS} SELECT l.id, 'Topic: ' || coalesce(f.topic, 'none') || '; persona: ' || coalesce(f.persona, 'anyone') || '; action: ' || coalesce(f.recommended_action, 'none') || '; age: ' || printf('%.1f', round({_HOURS}, 1)) || ' h; fit: ' || printf('%.1f', round(f.product_fit, 1)) AS block, md5(concat_ws('|', l.workspace_id, l.campaign_id, l.conversation_id, f.topic, f.persona, f.recommended_action, f.rationale, f.analysis_identity)) AS context FROM latest l JOIN facts f ON l.analysis_id = f.id WHERE post_created_at IS NOT NULL AND f.product_fit IS NOT NULL AND NOT isnan(f.product_fit)")
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a prompt with defaults and one digit after the point, and the digest of its context of eight fields."""
    f = facts(spark, sf_dir).where("product_fit IS NOT NULL AND NOT isnan(product_fit)").select(F.col("id").alias("analysis_id"), "topic", "persona", "recommended_action", "rationale", "analysis_identity", "product_fit")
    hours = times.age_hours(F.col("post_created_at"), F.lit(AS_OF).cast("timestamp_ntz"))
    tenth = lambda c: F.format_string("%.1f", F.round(c, 1))
    named = lambda label, c, other: F.concat(F.lit(label), F.coalesce(c, F.lit(other)))
    block = F.concat_ws("; ", named("Topic: ", "topic", "none"), named("persona: ", "persona", "anyone"), named("action: ", "recommended_action", "none"), F.concat(F.lit("age: "), tenth(hours), F.lit(" h")), F.concat(F.lit("fit: "), tenth(F.col("product_fit"))))
    context = F.md5(F.concat_ws("|", "workspace_id", "campaign_id", "conversation_id", "topic", "persona", "recommended_action", "rationale", "analysis_identity"))
    return latest(spark, sf_dir).where("post_created_at IS NOT NULL").join(f, "analysis_id").select("id", block.alias("block"), context.alias("context"))


@query("""WITH d AS (SELECT row_id, CASE WHEN json_type(normalized_content) = 'VARCHAR' THEN CAST(json_extract_string(normalized_content, '$') AS JSON) ELSE CAST(normalized_content AS JSON) END AS j FROM conversation_versions WHERE json_valid(normalized_content))
    SELECT row_id, CASE WHEN json_type(json_extract(j, '$.post.createdUtc')) IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(CAST(json_extract_string(j, '$.post.createdUtc') AS DOUBLE) AS BIGINT) END AS posted FROM d""")
def post_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: the post's time from the nested record; what is no number gives none."""
    rows = table(spark, sf_dir, "conversation_versions").select("row_id", _variant(F.col("normalized_content")).alias("doc")).where("doc IS NOT NULL")
    value = F.try_variant_get("doc", "$.post.createdUtc", "variant")
    kind = F.schema_of_variant(value)
    number = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return rows.select("row_id", F.when(number, F.round(F.try_variant_get("doc", "$.post.createdUtc", "double")).cast("long")).alias("posted"))


@query(f"""WITH {ATTEMPTS}, items AS (SELECT DISTINCT provider_variant AS provider, external_source_id AS item FROM attempts WHERE external_source_id IS NOT NULL), shared AS (SELECT item, count(*) AS k FROM items GROUP BY 1), o AS (SELECT provider, count(*) AS items, count(CASE WHEN k > 1 THEN 1 END) AS shared_items FROM items JOIN shared USING (item) GROUP BY 1),
    h AS (SELECT provider_variant AS provider, quantile_cont(elapsed_ms, 0.5) AS median_ms, count(CASE WHEN status IN ('success', 'incomplete') THEN 1 END) / count(*) AS usable_rate FROM attempts WHERE elapsed_ms IS NOT NULL GROUP BY 1) SELECT o.provider, o.items, o.shared_items, h.median_ms, h.usable_rate FROM o LEFT JOIN h ON h.provider = o.provider WHERE o.provider IS NOT NULL""")
def provider_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y2: per provider its unique items, those others have too, the median time and the rate of usable attempts."""
    rows = attempts(spark, sf_dir).withColumnRenamed("provider_variant", "provider")
    shared = measures.overlap(rows, "provider", "external_source_id").where("provider IS NOT NULL")
    timed = rows.where("elapsed_ms IS NOT NULL").groupBy("provider").agg(F.expr("percentile(elapsed_ms, 0.5)").alias("median_ms"), (F.count_if(F.col("status").isin("success", "incomplete")) / F.count("*")).alias("usable_rate"))
    return shared.join(timed, "provider", "left")


@query(f"""WITH {ATTEMPTS}, a AS (SELECT discovery_run_id AS run, {_UNWRAPPED} AS j FROM attempts WHERE raw_artifact IS NOT NULL AND json_valid(raw_artifact) AND discovery_run_id IS NOT NULL), n AS (SELECT run, json_extract_string(j, '$.filename') AS name, TRY_CAST(json_extract_string(j, '$.bytes') AS BIGINT) AS bytes, json_extract(j, '$.path') IS NOT NULL AND json_extract(j, '$.filename') IS NOT NULL AND json_extract(j, '$.bytes') IS NOT NULL AND json_extract(j, '$.sha256') IS NOT NULL AS keys FROM a)
    SELECT run, coalesce(bool_and(keys), false) AS all_keys, count(DISTINCT name) = count(*) AS unique_names, coalesce(sum(bytes), 0) <= 100000000 AS bounded FROM n GROUP BY 1""")
def manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests of runs: all keys there, names unique, the total bounded."""
    doc = _variant(F.col("raw_artifact"))
    rows = attempts(spark, sf_dir).where("raw_artifact IS NOT NULL AND discovery_run_id IS NOT NULL").select(F.col("discovery_run_id").alias("run"), doc.alias("doc")).where("doc IS NOT NULL")
    there = F.lit(True)
    for key in ("path", "filename", "bytes", "sha256"):
        there = there & F.try_variant_get("doc", f"$.{key}", "variant").isNotNull()
    from evidra.functions.json_columns import whole_number

    flat = rows.select("run", there.alias("keys"), member_text(F.col("doc"), "$.filename").alias("name"), whole_number(F.col("doc"), "$.bytes").alias("bytes"))
    return flat.groupBy("run").agg(F.coalesce(F.bool_and("keys"), F.lit(False)).alias("all_keys"), (F.count_distinct("name") == F.count("*")).alias("unique_names"), (F.coalesce(F.sum("bytes"), F.lit(0)) <= 100_000_000).alias("bounded"))


@query(f"WITH {ATTEMPTS}, items AS (SELECT creation_order, unnest(candidates) AS c, unnest(generate_series(1, len(candidates))) AS i FROM attempts WHERE capability = 'discovery' AND len(candidates) > 0), whole AS (SELECT creation_order, i, c.url AS url, c.title AS title, c.snippet AS snippet FROM items WHERE c.url IS NOT NULL AND c.title IS NOT NULL AND c.snippet IS NOT NULL) SELECT creation_order, CAST(row_number() OVER (PARTITION BY creation_order ORDER BY i) - 1 AS INTEGER) AS pos, url AS href FROM whole")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of result pages made of the candidates, in their places."""
    from evidra.plans.streams import html_rows

    return html_rows(spark, sf_dir).select("creation_order", "pos", "href")


@query()
def theme_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Themes as clusters of vectors, and how the share of each changes from one label to the next."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=8, seed=11, maxIter=20).fit(vectors)
    return measures.trend(model.transform(vectors).withColumnRenamed("prediction", "cluster"), "cluster", "label")


QUERIES, SQL = query.queries, query.sql
