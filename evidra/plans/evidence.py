"""Queries over attempts, candidates, opportunities, analyses, versions and comments. The inventory ids are in the docstrings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.functions import ids, text, times
from evidra.operators import dedupe, measures, paging, relations, rollup, sets, validate
from evidra.operators.hierarchy import reference_key
from evidra.plans.registry import Registry
from evidra.session import table

query = Registry()

AS_OF = "2026-10-01 00:00:00"
#: Repeated rows of an attempt are one attempt: the earliest created counts.
ATTEMPTS = "attempts AS (SELECT * FROM retrieval_observations QUALIFY row_number() OVER (PARTITION BY creation_order ORDER BY created_at NULLS LAST, id) = 1)"
LATEST = "latest AS (SELECT * FROM opportunities QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, creation_order DESC) = 1)"
FACTS = "facts AS (SELECT * FROM analyses QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, creation_order DESC) = 1)"
CANDIDATES = f"{ATTEMPTS}, found AS (SELECT discovery_run_id AS run, creation_order, candidates, unnest(generate_series(1, len(candidates))) AS i FROM attempts WHERE capability = 'discovery' AND len(candidates) > 0), items AS (SELECT run, creation_order, i - 1 AS pos, candidates[i].external_source_id AS external_id, candidates[i].url AS url, candidates[i].title AS title, candidates[i].snippet AS snippet, candidates[i].subreddit AS subreddit FROM found)"
SCORE = "0.375 * relevance + 0.1875 * pain_intensity + 0.125 * buying_intent + 0.1875 * replyability + 0.125 * product_fit"
VALID = " AND ".join(f"{n} BETWEEN 0 AND 1 AND NOT isnan({n})" for n, _ in times.WEIGHTS)
AGE = f"(epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(post_created_at)) / 3.6e9"
DECAY = f"exp(-ln(2.0) * greatest({AGE}, 0) / 480.0)"


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.first_by(table(spark, sf_dir, "retrieval_observations"), ["creation_order"], ["created_at", "id"])


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.last_by(table(spark, sf_dir, "opportunities"), ["id"], ["updated_at", "creation_order"])


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.last_by(table(spark, sf_dir, "analyses"), ["id"], ["created_at", "creation_order"])


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = attempts(spark, sf_dir).where("capability = 'discovery'")
    rows = found.select(F.col("discovery_run_id").alias("run"), "creation_order", F.posexplode("candidates").alias("pos", "c"))
    return rows.select("run", "creation_order", F.col("pos").cast("long").alias("pos"), F.col("c.external_source_id").alias("external_id"), "c.url", "c.title", "c.snippet", "c.subreddit")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = relations.inbox(latest(spark, sf_dir), facts(spark, sf_dir), table(spark, sf_dir, "conversation_versions").groupBy("conversation_id").agg(F.max("snapshot_no").alias("last_snapshot")))
    hours = times.age_hours(F.col("post_created_at"), F.lit(AS_OF).cast("timestamp_ntz"))
    valid = hours.isNotNull()
    for n, _ in times.WEIGHTS:
        valid = valid & times.in_unit(F.col(n))
    linear, decay = times.weighted_mean({n: F.col(n) for n, _ in times.WEIGHTS}), times.freshness(hours, 480.0)
    return joined.where(valid).withColumn("linear", F.round(linear, 6)).withColumn("decay", F.round(decay, 6)).withColumn("score", F.round(F.least(F.greatest(linear * decay, F.lit(0.0)), F.lit(1.0)), 6))


@query(f"""
    WITH {LATEST}, {FACTS}, snaps AS (SELECT conversation_id, max(snapshot_no) AS last_snapshot FROM conversation_versions GROUP BY 1)
    SELECT l.id AS opportunity_id, l.campaign_id, round(least(greatest(({SCORE}) * {DECAY}, 0), 1), 6) AS score, f.topic, s.last_snapshot
    FROM latest l JOIN facts f ON l.analysis_id = f.id LEFT JOIN snaps s ON l.conversation_id = s.conversation_id
    WHERE {VALID} AND post_created_at IS NOT NULL ORDER BY score DESC, l.creation_order DESC LIMIT 50""")
def k1_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked inbox."""
    rows = scored(spark, sf_dir)
    return paging.top_k(rows, [F.desc("score"), F.desc("creation_order")]).select(F.col("id").alias("opportunity_id"), "campaign_id", "score", "topic", "last_snapshot")


@query(f"""
    WITH {LATEST}, {FACTS} SELECT l.id AS opportunity_id, round({SCORE}, 6) AS linear, round({DECAY}, 6) AS decay, round(least(greatest(({SCORE}) * {DECAY}, 0), 1), 6) AS score
    FROM latest l JOIN facts f ON l.analysis_id = f.id WHERE {VALID} AND post_created_at IS NOT NULL""")
def score_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score with its parts."""
    return scored(spark, sf_dir).select(F.col("id").alias("opportunity_id"), "linear", "decay", "score")


@query("SELECT conversation_id, id AS version_id, snapshot_no FROM (SELECT *, row_number() OVER (PARTITION BY lower(conversation_id) ORDER BY delivered_at DESC, row_id DESC) AS n FROM conversation_versions) WHERE n = 1")
def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version delivered last, per discussion."""
    rows = table(spark, sf_dir, "conversation_versions").select("conversation_id", F.col("id").alias("version_id"), "snapshot_no", "delivered_at", "row_id", F.lower("conversation_id").alias("key"))
    return dedupe.last_by(rows, ["key"], ["delivered_at", "row_id"]).select("conversation_id", "version_id", "snapshot_no")


@query(f"""
    WITH {ATTEMPTS}, seen AS (SELECT v.conversation_id, v.normalizer_version, v.id AS version_id, coalesce(v.created_at, v.delivered_at) AS seen_at, v.row_id AS creation_order FROM conversation_versions v)
    SELECT conversation_id, version_id, creation_order FROM seen
    QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY seen_at DESC, creation_order DESC, normalizer_version DESC, version_id DESC) = 1""")
def current_by_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version with the newest evidence, chosen on narrow columns."""
    versions = table(spark, sf_dir, "conversation_versions")
    evidence = versions.select(F.col("row_id").alias("creation_order"), F.col("row_id").alias("version_row"), F.coalesce("created_at", "delivered_at").alias("seen_at"))
    keyed = versions.select("conversation_id", "normalizer_version", F.struct("id", "row_id").alias("id"))
    found = dedupe.current_versions(keyed, evidence.join(versions.select(F.struct("id", "row_id").alias("version_id"), F.col("row_id").alias("version_row")), "version_row").drop("version_row"))
    return found.select("conversation_id", F.col("version_id.id").alias("version_id"), "creation_order")


@query(f"WITH {CANDIDATES} SELECT run, external_id, url, creation_order, pos FROM items WHERE external_id <> '' QUALIFY row_number() OVER (PARTITION BY run, external_id ORDER BY creation_order, pos) = 1")
def first_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first url of each candidate of a run."""
    return dedupe.first_by(candidates(spark, sf_dir).where("external_id <> ''"), ["run", "external_id"], ["creation_order", "pos"]).select("run", "external_id", "url", "creation_order", "pos")


@query(f"WITH {ATTEMPTS} SELECT discovery_run_id AS run, external_source_id AS external_id, status, creation_order FROM attempts WHERE capability = 'thread_fetch' AND external_source_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY discovery_run_id, external_source_id ORDER BY creation_order DESC) = 1")
def last_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last fetch of each thread in a run."""
    rows = attempts(spark, sf_dir).where("capability = 'thread_fetch' AND external_source_id IS NOT NULL")
    return dedupe.last_by(rows, ["discovery_run_id", "external_source_id"], ["creation_order"]).select(F.col("discovery_run_id").alias("run"), F.col("external_source_id").alias("external_id"), "status", "creation_order")


_PATH = "regexp_replace(regexp_extract(url, '^(?i:https?)://[^/?#]+([^?#]*)', 1), '\\.json/?$', '', 'i')"
_CANONICAL = f"""
    shown AS (SELECT run, creation_order, pos, url, {_PATH} AS path, lower(regexp_extract(url, '^(?i:https?)://([^/?#:]+)', 1)) AS host FROM items),
    parts AS (SELECT *, lower(regexp_extract(path, '^/(?:r/([^/]+)/)?comments/([a-zA-Z0-9]+)(?:/([^/?#]+))?/?$', 2)) AS post, regexp_extract(path, '^/(?:r/([^/]+)/)?comments/([a-zA-Z0-9]+)(?:/([^/?#]+))?/?$', 1) AS sub, regexp_extract(path, '^/(?:r/([^/]+)/)?comments/([a-zA-Z0-9]+)(?:/([^/?#]+))?/?$', 3) AS slug FROM shown WHERE host IN ('threads.example', 'www.threads.example')),
    canonical AS (SELECT run, creation_order, pos, 't3_' || post AS external_id, nullif(sub, '') AS subreddit, 'https://threads.example' || CASE WHEN sub <> '' THEN '/r/' || sub ELSE '' END || '/comments/' || post || '/' || CASE WHEN slug <> '' THEN slug ELSE '_' END || '/' AS url FROM parts WHERE post <> '')"""


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.thread_url(F.col("url"), ("threads.example", "www.threads.example"), "https://threads.example")
    return candidates(spark, sf_dir).select("run", "creation_order", "pos", t.alias("t")).where("t IS NOT NULL").select("run", "creation_order", "pos", "t.external_id", "t.subreddit", "t.url")


@query(f"WITH {CANDIDATES}, {_CANONICAL} SELECT run, creation_order, pos, external_id, subreddit, url FROM canonical")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thread urls in canonical form; others drop out."""
    return _canonical(spark, sf_dir)


@query(f"""WITH {CANDIDATES}, {_CANONICAL}, kept AS (SELECT * FROM canonical QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY creation_order, pos) = 1)
    SELECT row_number() OVER (ORDER BY creation_order, pos) AS rank, external_id, url FROM kept QUALIFY rank <= 50""")
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First of each thread over all runs, ranked densely, up to fifty."""
    return dedupe.ranked_survivors(_canonical(spark, sf_dir), "external_id", ["creation_order", "pos"], 50).select(F.col("rank").cast("long").alias("rank"), "external_id", "url")


@query(f"""WITH {ATTEMPTS} SELECT discovery_run_id, count(*) AS attempts,
    CASE WHEN bool_and(status IN ('success', 'no_results')) THEN 'succeeded' WHEN NOT bool_or(status IN ('success', 'no_results', 'incomplete')) THEN 'failed' ELSE 'partial' END AS run_status,
    CAST(sum(coalesce(elapsed_ms, 0)) AS BIGINT) AS total_elapsed_ms, CAST(sum(CASE WHEN candidate_count >= 0 THEN candidate_count END) AS BIGINT) AS request_count FROM attempts GROUP BY 1""")
def run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, A4: the outcome of each run over all its attempts; unmeasured counts stay null."""
    return rollup.run_rollup(attempts(spark, sf_dir), requests="candidate_count")


@query(f"WITH {ATTEMPTS} SELECT discovery_run_id, status, count(*) AS n FROM attempts GROUP BY 1, 2")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: attempts by status per run."""
    return rollup.histogram(attempts(spark, sf_dir), ["discovery_run_id"], "status")


@query(f"WITH {ATTEMPTS}, n AS (SELECT discovery_run_id, status, count(*) AS n FROM attempts WHERE status IS NOT NULL GROUP BY 1, 2) SELECT discovery_run_id, string_agg(status || '=' || n, ',' ORDER BY status) AS counts FROM n GROUP BY 1")
def status_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: the same as one sorted map per run, shown as text."""
    m = rollup.histogram_map(attempts(spark, sf_dir), ["discovery_run_id"], "status")
    return m.select("discovery_run_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query(f"WITH {ATTEMPTS} SELECT failure_class, count(*) AS n, min(creation_order) AS first_seen FROM attempts WHERE failure_class IS NOT NULL GROUP BY 1")
def failure_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure classes by frequency, ties by first occurrence."""
    return rollup.by_frequency(attempts(spark, sf_dir), "failure_class", "creation_order")


@query(f"WITH {ATTEMPTS} SELECT capability, coalesce(status, 'unknown') AS status, count(*) AS n FROM attempts WHERE status IS NULL OR status <> 'success' GROUP BY 1, 2")
def non_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What went wrong, over both kinds of attempts."""
    rows = attempts(spark, sf_dir)
    both = sets.pooled(rows.where("capability = 'discovery'"), rows.where("capability <> 'discovery'"))
    return both.where("status IS NULL OR status <> 'success'").groupBy("capability", F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


@query(f"""WITH {CANDIDATES}, c AS (SELECT DISTINCT run, external_id FROM items WHERE external_id <> ''), f AS (SELECT DISTINCT discovery_run_id AS run, external_source_id AS external_id FROM attempts WHERE capability = 'thread_fetch' AND external_source_id IS NOT NULL),
    d AS (SELECT DISTINCT thread_id AS external_id FROM deep_comments)
    SELECT c.run, count(*) AS expected, count(f.external_id) AS fetched, count(d.external_id) AS normalized, count(*) = count(f.external_id) AS complete FROM c LEFT JOIN f ON c.run = f.run AND c.external_id = f.external_id LEFT JOIN d ON c.external_id = d.external_id GROUP BY 1""")
def run_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected, fetched and normalized threads per run."""
    c = candidates(spark, sf_dir).where("external_id <> ''").select("run", "external_id").distinct()
    f = attempts(spark, sf_dir).where("capability = 'thread_fetch' AND external_source_id IS NOT NULL").select(F.col("discovery_run_id").alias("run"), F.col("external_source_id").alias("external_id")).distinct()
    d = table(spark, sf_dir, "deep_comments").select(F.col("thread_id").alias("external_id")).distinct()
    return rollup.transitions(c, f, d)


@query(f"WITH {ATTEMPTS} SELECT discovery_run_id, count(*) FILTER (capability = 'discovery' AND status = 'success') AS baseline_successes, count(*) FILTER (status = 'parse_failed') AS invalid, count(*) FILTER (failure_class IS NOT NULL) AS mismatches, count(*) FILTER (capability = 'discovery' AND status = 'success') >= 1 AND count(*) FILTER (status = 'parse_failed') = 0 AND count(*) FILTER (failure_class IS NOT NULL) = 0 AS passed FROM attempts GROUP BY 1")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each run passes the gate."""
    return rollup.gate(attempts(spark, sf_dir), "discovery_run_id", F.col("capability") == "discovery", F.col("status") == "success", F.col("status") == "parse_failed", F.col("failure_class").isNotNull(), 1)


@query(f"WITH {LATEST} SELECT l.id, CASE WHEN l.analysis_id IS NULL THEN 'none' WHEN a.id IS NULL THEN 'dangling' ELSE 'linked' END AS state, a.topic FROM latest l LEFT JOIN (SELECT DISTINCT id, topic FROM analyses) a ON l.analysis_id = a.id")
def evidence_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each opportunity with its analysis, none, or a dangling reference."""
    a = table(spark, sf_dir, "analyses").select(F.col("id").alias("analysis_id"), "topic", F.lit(True).alias("there")).distinct()
    joined = latest(spark, sf_dir).join(a, "analysis_id", "left")
    return joined.select("id", F.when(F.col("analysis_id").isNull(), "none").when(F.col("there").isNull(), "dangling").otherwise("linked").alias("state"), "topic")


@query(f"WITH {LATEST} SELECT id FROM latest l WHERE EXISTS (SELECT 1 FROM conversation_versions v WHERE v.conversation_id = l.conversation_id)")
def candidate_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunities whose discussion has a version."""
    return relations.present(latest(spark, sf_dir), table(spark, sf_dir, "conversation_versions"), ["conversation_id"]).select("id")


@query(f"WITH {LATEST} SELECT id FROM latest l WHERE NOT EXISTS (SELECT 1 FROM conversation_versions v WHERE v.conversation_id = l.conversation_id)")
def unrecorded_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunities whose discussion has none."""
    return relations.absent(latest(spark, sf_dir), table(spark, sf_dir, "conversation_versions"), ["conversation_id"]).select("id")


@query(f"WITH {LATEST}, owners AS (SELECT conversation_id, min(workspace_id) AS workspace_id FROM conversation_versions GROUP BY 1) SELECT l.id, l.workspace_id, o.workspace_id AS parent_owner FROM latest l JOIN owners o ON l.conversation_id = o.conversation_id WHERE l.workspace_id <> o.workspace_id")
def ownership_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunities of another workspace than their discussion."""
    owners = table(spark, sf_dir, "conversation_versions").groupBy("conversation_id").agg(F.min("workspace_id").alias("workspace_id"))
    return relations.mismatched_owners(latest(spark, sf_dir), owners, "conversation_id", "workspace_id").select("id", "workspace_id", "parent_owner")


_AUDIT = "audit AS (SELECT id AS event, 'analysis' AS target_type, analysis_id AS target_id FROM latest UNION ALL SELECT id, 'workspace', workspace_id FROM latest UNION ALL SELECT id, 'draft', conversation_id FROM latest)"


@query(f"WITH {LATEST}, {_AUDIT} SELECT event, target_type, target_id FROM audit x WHERE NOT (target_type = 'analysis' AND EXISTS (SELECT 1 FROM analyses a WHERE a.id = target_id)) AND NOT (target_type = 'workspace' AND EXISTS (SELECT 1 FROM workspaces w WHERE w.id = target_id))")
def polymorphic_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows whose target does not exist or is of an unknown kind."""
    rows = latest(spark, sf_dir)
    audit = sets.pooled(*[rows.select(F.col("id").alias("event"), F.lit(kind).alias("target_type"), F.col(c).alias("target_id")) for kind, c in (("analysis", "analysis_id"), ("workspace", "workspace_id"), ("draft", "conversation_id"))])
    return relations.unresolved_targets(audit, "target_type", "target_id", {"analysis": (table(spark, sf_dir, "analyses"), "id"), "workspace": (table(spark, sf_dir, "workspaces"), "id")}).select("event", "target_type", "target_id")


@query("WITH s AS (SELECT thread_id, min(subreddit) AS found FROM deep_comments WHERE thread_id IS NOT NULL GROUP BY 1) SELECT doc_id, coalesce(subreddit, found) AS subreddit FROM documents d LEFT JOIN s ON d.thread_id = s.thread_id")
def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing subreddit looked up through the thread."""
    from evidra.sources.writers import backfilled

    found = table(spark, sf_dir, "deep_comments").where("thread_id IS NOT NULL").groupBy("thread_id").agg(F.min("subreddit").alias("found"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "subreddit", F.col("thread_id").alias("target_id"))
    return backfilled(rows, "subreddit", (F.lit(True), found, "thread_id", "found")).select("doc_id", "subreddit")


@query(f"""WITH {ATTEMPTS}, p AS (SELECT discovery_run_id, capability, id, row_number() OVER (PARTITION BY discovery_run_id, capability ORDER BY creation_order) AS ordinal FROM attempts)
    SELECT coalesce(d.discovery_run_id, f.discovery_run_id) AS discovery_run_id, coalesce(d.ordinal, f.ordinal) AS ordinal, d.id AS discovery, f.id AS fetch FROM (SELECT * FROM p WHERE capability = 'discovery') d FULL JOIN (SELECT * FROM p WHERE capability = 'thread_fetch') f ON d.discovery_run_id = f.discovery_run_id AND d.ordinal = f.ordinal""")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th discovery beside the n-th fetch of a run."""
    from pyspark.sql import Window

    w = Window.partitionBy("discovery_run_id", "capability").orderBy("creation_order")
    p = attempts(spark, sf_dir).withColumn("ordinal", F.row_number().over(w).cast("long"))
    side = lambda kind, name: p.where(F.col("capability") == kind).select("discovery_run_id", "ordinal", F.col("id").alias(name))
    return relations.zipped(side("discovery", "discovery"), side("thread_fetch", "fetch"), ["discovery_run_id"], "ordinal")


@query(f"WITH {LATEST} SELECT l.id, coalesce(w.name, 'Workspace ' || substr(l.workspace_id, 1, 8)) AS workspace FROM latest l LEFT JOIN workspaces w ON l.workspace_id = w.id")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workspace's name, or a name made of its id."""
    names = table(spark, sf_dir, "workspaces").select(F.col("id").alias("workspace_id"), "name")
    return relations.lookup(latest(spark, sf_dir), names, "workspace_id", "name", F.concat(F.lit("Workspace "), F.substring("workspace_id", 1, 8)), "workspace").select("id", "workspace")


_KEY = "nullif(regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '^t[0-9]+_', ''), '')"


@query(f"""WITH c AS (SELECT row_id, {_KEY.format(c="id")} AS id, {_KEY.format(c="parent_id")} AS parent, {_KEY.format(c="thread_id")} AS thread FROM deep_comments)
    SELECT row_id FROM c WHERE parent IS NOT NULL AND parent <> thread AND NOT EXISTS (SELECT 1 FROM c p WHERE p.thread = c.thread AND p.id = c.parent)""")
def missing_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments whose parent is not among the comments of their thread."""
    c = table(spark, sf_dir, "deep_comments").select("row_id", reference_key(F.col("id")).alias("id"), reference_key(F.col("parent_id")).alias("parent"), reference_key(F.col("thread_id")).alias("thread"))
    children = c.where("parent IS NOT NULL AND parent <> thread").select("row_id", "thread", "parent")
    return relations.absent(children, c.select("thread", F.col("id").alias("parent")), ["thread", "parent"]).select("row_id")


_TOKEN = "rtrim(translate(to_base64(encode('opportunities:' || {c})), '+/', '-_'), '=')"


@query(f"WITH {LATEST}, p AS (SELECT id, creation_order, row_number() OVER (ORDER BY creation_order) AS n FROM latest WHERE creation_order > 100) SELECT id, creation_order, CASE WHEN n = 50 AND (SELECT count(*) FROM p) > 50 THEN {_TOKEN.format(c='creation_order')} END AS next_cursor FROM p WHERE n <= 50")
def page_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K4: the page after a cursor."""
    cursor = "b3Bwb3J0dW5pdGllczoxMDA"
    return paging.page(latest(spark, sf_dir), "creation_order", "opportunities", cursor, 50).select("id", "creation_order", "next_cursor")


@query(f"WITH {LATEST}, p AS (SELECT id, creation_order, row_number() OVER (ORDER BY creation_order DESC) AS n FROM latest) SELECT id, creation_order, CASE WHEN n = 20 AND (SELECT count(*) FROM p) > 20 THEN {_TOKEN.format(c='creation_order')} END AS next_cursor FROM p WHERE n <= 20")
def page_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3, K4: the newest page."""
    return paging.page(latest(spark, sf_dir), "creation_order", "opportunities", None, 20, descending=True).select("id", "creation_order", "next_cursor")


@query("""SELECT thread_id, row_id, place, CASE WHEN length(body) > 80 THEN substr(body, 1, 79) || '…' ELSE body END AS body FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY coalesce(score, 0) DESC, row_id) AS place FROM deep_comments WHERE NOT (coalesce(author, '') = '[deleted]' OR coalesce(body, '') IN ('[deleted]', '[removed]'))) WHERE place <= 20""")
def top_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best visible comments of each thread, clipped."""
    from pyspark.sql import Window

    seen = table(spark, sf_dir, "deep_comments").where(rollup.visibility(F.col("author"), F.col("body")) == "visible")
    placed = seen.withColumn("place", F.row_number().over(Window.partitionBy("thread_id").orderBy(F.coalesce("score", F.lit(0)).desc(), "row_id")).cast("long"))
    return placed.where("place <= 20").select("thread_id", "row_id", "place", text.clip(F.col("body"), 80).alias("body"))


@query(f"WITH {CANDIDATES}, t AS (SELECT creation_order, trim(subreddit) AS s, min(pos) AS p FROM items WHERE trim(subreddit) <> '' GROUP BY 1, 2) SELECT creation_order, string_agg(s, ',' ORDER BY p) AS subreddits FROM t GROUP BY 1")
def tidy_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subreddits of each search, trimmed, in order, without repeats."""
    rows = attempts(spark, sf_dir).where("capability = 'discovery'").select("creation_order", sets.tidy_list(F.transform("candidates", lambda c: c["subreddit"])).alias("s"))
    return rows.where(F.size("s") > 0).select("creation_order", F.array_join("s", ",").alias("subreddits"))


@query(f"WITH {LATEST} SELECT DISTINCT conversation_id FROM latest WHERE conversation_id IS NOT NULL AND conversation_id NOT IN (SELECT conversation_id FROM conversation_versions)")
def uncovered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discussions that only one side has."""
    return sets.difference(latest(spark, sf_dir).where("conversation_id IS NOT NULL"), table(spark, sf_dir, "conversation_versions"), ["conversation_id"])


@query("SELECT id, count(*) AS copies FROM opportunities GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that occur more than once."""
    return dedupe.repeated(table(spark, sf_dir, "opportunities"), ["id"])


@query("SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY thread_id, id ORDER BY row_id) AS n FROM deep_comments) WHERE n = 2")
def duplicate_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row at which a repeated comment is first noticed."""
    return dedupe.second_places(table(spark, sf_dir, "deep_comments").select("row_id", "thread_id", "id"), "thread_id", "id", "row_id").select("row_id")


@query(f"WITH {ATTEMPTS} SELECT status, string_agg(DISTINCT failure_class, ',' ORDER BY failure_class) AS classes FROM attempts WHERE failure_class IS NOT NULL GROUP BY 1")
def failure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct failure classes of each status."""
    return attempts(spark, sf_dir).where("failure_class IS NOT NULL").groupBy("status").agg(F.array_join(F.array_sort(F.collect_set("failure_class")), ",").alias("classes"))


_RULES = {"workspace": "workspace_id IS NOT NULL", "score": "opportunity_score BETWEEN 0 AND 1", "times": "updated_at >= created_at", "formula": "formula_version <> ''"}


@query("SELECT id, creation_order, updated_at, rule FROM (" + " UNION ALL ".join(f"SELECT id, creation_order, updated_at, '{n}' AS rule FROM opportunities WHERE NOT coalesce({r}, false)" for n, r in _RULES.items()) + ")")
def rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8, P16, section 1.6: one row for each rule a row breaks."""
    return validate.violations(table(spark, sf_dir, "opportunities"), ["id", "creation_order", "updated_at"], {n: F.expr(r) for n, r in _RULES.items()})


@query(f"WITH {ATTEMPTS}, good AS (SELECT discovery_run_id FROM attempts GROUP BY 1 HAVING bool_and(coalesce(elapsed_ms >= 0, false))) SELECT id FROM attempts WHERE discovery_run_id IN (SELECT discovery_run_id FROM good)")
def page_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs in which every attempt was measured; one bad row rejects all of its run."""
    return validate.all_or_nothing(attempts(spark, sf_dir), ["discovery_run_id"], F.col("elapsed_ms") >= 0).select("id")


@query(f"""WITH {ATTEMPTS} SELECT id, CASE WHEN schema_version IS NULL OR schema_version <> 1 THEN 'unknown_observation_schema' WHEN status IS NULL OR status NOT IN ('success', 'no_results', 'incomplete', 'blocked', 'rate_limited', 'auth_required', 'forbidden', 'upstream_unavailable', 'parse_failed', 'transport_failed', 'runtime_verification_failed', 'failed') THEN 'unknown_observation_status'
    WHEN elapsed_ms IS NULL OR candidate_count < 0 THEN 'contract_violation' ELSE status END AS outcome FROM attempts""")
def classify_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version, then status, then shape; the first rule that fails decides."""
    known = F.col("status").isin("success", "no_results", "incomplete", "blocked", "rate_limited", "auth_required", "forbidden", "upstream_unavailable", "parse_failed", "transport_failed", "runtime_verification_failed", "failed")
    rules = [(~F.coalesce(F.col("schema_version") == 1, F.lit(False)), "unknown_observation_schema"), (~F.coalesce(known, F.lit(False)), "unknown_observation_status"), (F.col("elapsed_ms").isNull() | F.coalesce(F.col("candidate_count") < 0, F.lit(False)), "contract_violation")]
    return attempts(spark, sf_dir).select("id", validate.first_rule(rules, F.col("status")).alias("outcome"))


@query(f"WITH {ATTEMPTS} SELECT capability, count(elapsed_ms) AS n, round(quantile_cont(elapsed_ms, 0.5), 6) AS median, round(quantile_cont(elapsed_ms, 0.95), 6) AS p95 FROM attempts WHERE elapsed_ms IS NOT NULL GROUP BY 1")
def latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile of the time taken."""
    found = measures.latency(attempts(spark, sf_dir), "capability", "elapsed_ms")
    return found.select("capability", "n", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


_JUDGED = f"{LATEST}, {FACTS}, judged AS (SELECT l.campaign_id, f.relevance, row_number() OVER (PARTITION BY l.campaign_id ORDER BY l.opportunity_score DESC NULLS LAST, l.creation_order DESC) AS rank FROM latest l JOIN facts f ON l.analysis_id = f.id WHERE f.relevance BETWEEN 0 AND 1 AND NOT isnan(f.relevance) AND l.campaign_id IS NOT NULL)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    f = facts(spark, sf_dir).where("relevance BETWEEN 0 AND 1").select(F.col("id").alias("analysis_id"), "relevance")
    rows = latest(spark, sf_dir).where("campaign_id IS NOT NULL").join(f, "analysis_id")
    return rows.select("campaign_id", "relevance", F.row_number().over(Window.partitionBy("campaign_id").orderBy(F.desc_nulls_last("opportunity_score"), F.desc("creation_order"))).alias("rank"))


@query(f"WITH {_JUDGED} SELECT campaign_id, round(count(*) FILTER (relevance >= 0.5) / 5.0, 6) AS precision FROM judged WHERE rank <= 5 GROUP BY 1")
def precision_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevant among the first five of each campaign."""
    return measures.precision_at(_judged(spark, sf_dir), "campaign_id", "rank", F.col("relevance") >= 0.5, 5).select("campaign_id", F.round("precision", 6).alias("precision"))


@query(f"""WITH {_JUDGED}, i AS (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY relevance DESC, rank) AS ideal FROM judged), s AS (SELECT campaign_id, sum(CASE WHEN rank <= 10 THEN relevance / log2(rank + 1) END) AS dcg, sum(CASE WHEN ideal <= 10 THEN relevance / log2(ideal + 1) END) AS best FROM i GROUP BY 1)
    SELECT campaign_id, round(CASE WHEN best > 0 THEN coalesce(dcg, 0) / best ELSE 0 END, 6) AS ndcg FROM s""")
def ndcg_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounted gain of the first ten of each campaign."""
    return measures.ndcg_at(_judged(spark, sf_dir), "campaign_id", "rank", "relevance", 10).select("campaign_id", F.round("ndcg", 6).alias("ndcg"))


@query(f"WITH {CANDIDATES}, p AS (SELECT DISTINCT run, external_id FROM items WHERE external_id IS NOT NULL), s AS (SELECT external_id, count(*) AS k FROM p GROUP BY 1) SELECT run, count(*) AS items, count(*) FILTER (k > 1) AS shared_items FROM p JOIN s USING (external_id) GROUP BY 1")
def run_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y2: threads of a run that other runs found too."""
    return measures.overlap(candidates(spark, sf_dir), "run", "external_id")


@query("SELECT thread_id, min(created_utc) AS first_seen, max(created_utc) AS last_seen, count(*) AS times_seen FROM deep_comments GROUP BY 1")
def thread_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last comment of each thread."""
    return measures.seen_range(table(spark, sf_dir, "deep_comments"), "thread_id", "created_utc")


@query("WITH n AS (SELECT subreddit, strftime(fetched_at, '%Y-%m') AS month, count(*) AS n FROM deep_comments GROUP BY 1, 2) SELECT subreddit, month, n, n - lag(n) OVER (PARTITION BY subreddit ORDER BY month) AS delta FROM n")
def subreddit_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments per month and the change."""
    return measures.trend(table(spark, sf_dir, "deep_comments").select("subreddit", F.date_format("fetched_at", "yyyy-MM").alias("month")), "subreddit", "month")


@query("""SELECT thread_id, count(*) AS comments, count(*) FILTER (coalesce(author, '') = '[deleted]' OR coalesce(body, '') = '[deleted]') AS deleted, count(*) FILTER (NOT (coalesce(author, '') = '[deleted]' OR coalesce(body, '') = '[deleted]') AND coalesce(body, '') = '[removed]') AS removed, max(depth) AS max_depth, count(DISTINCT id) AS unique_ids FROM deep_comments GROUP BY 1""")
def thread_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, visibility and depth of each thread. Distinct ids are counted in two aggregations, so a hot thread is spread."""
    rows = table(spark, sf_dir, "deep_comments").withColumn("seen", rollup.visibility(F.col("author"), F.col("body")))
    per_id = rows.groupBy("thread_id", "id").agg(F.count("*").alias("n"), F.count_if(F.col("seen") == "deleted").alias("d"), F.count_if(F.col("seen") == "removed").alias("r"), F.max("depth").alias("deepest"))
    return per_id.groupBy("thread_id").agg(F.sum("n").alias("comments"), F.sum("d").alias("deleted"), F.sum("r").alias("removed"), F.max("deepest").alias("max_depth"), F.count("id").alias("unique_ids"))


@query(f"WITH {CANDIDATES} SELECT run, creation_order, pos, 'https://search.example/?q=' || replace(url_encode('site:threads.example/r/' || subreddit || ' ' || external_id), '%20', '+') AS search FROM items WHERE subreddit ~ '^[a-z]+$' AND external_id ~ '^[a-z0-9_]+$'")
def search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a scoped search for each candidate."""
    rows = candidates(spark, sf_dir).where("subreddit RLIKE '^[a-z]+$' AND external_id RLIKE '^[a-z0-9_]+$'")
    return rows.select("run", "creation_order", "pos", text.search_url("https://search.example/", F.col("external_id"), F.array("subreddit"), "threads.example").alias("search"))


@query("SELECT DISTINCT conversation_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || CASE WHEN substr(d, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(d, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(d, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS discussion_id, 'thread_' || substr(sha256(conversation_id), 1, 32) AS work_item, 'analysis:' || workspace_id || ':' || conversation_id AS job FROM (SELECT conversation_id, workspace_id, sha1(unhex('a63645745df246aea1bd1a135f12b4c5') || encode(workspace_id || chr(0) || 'forum' || chr(0) || conversation_id)) AS d FROM opportunities WHERE workspace_id IS NOT NULL AND conversation_id IS NOT NULL)")
def derived_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that follow from their content."""
    rows = table(spark, sf_dir, "opportunities").where("workspace_id IS NOT NULL AND conversation_id IS NOT NULL").select("conversation_id", "workspace_id").distinct()
    return rows.select("conversation_id", ids.discussion_id(F.col("workspace_id"), F.lit(" Forum "), F.col("conversation_id")).alias("discussion_id"), ids.work_item_id(F.col("conversation_id")).alias("work_item"), ids.job_id("analysis", F.col("workspace_id"), F.col("conversation_id")).alias("job"))


QUERIES, SQL = query.queries, query.sql
