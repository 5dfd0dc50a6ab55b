"""Queries of the general data problems: snapshot changes, nested records, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators.hierarchy import all_descendants, back_edges, hierarchy, latest_nodes
from evidra.operators.nested import flatten, subtype_tables
from evidra.operators.snapshots import COMMENT_FIELDS, MORE_FIELDS, POST_FIELDS, snapshot_changes
from evidra.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = snapshot_changes(table(spark, sf_dir, "conversation_versions"), "snapshot_no", "conversation_id", "normalized_content", "delivered_at", "row_id")
    return changes.select(F.col("snapshot").alias("snapshot_no"), F.col("key").alias("conversation_id"), "change_kind")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = flatten(table(spark, sf_dir, "conversation_versions"), "version", "row_id", "normalized_content")
    observations = flatten(table(spark, sf_dir, "retrieval_observations"), "observation", "creation_order", "raw_artifact")
    return versions.unionByName(observations)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtype_tables(_nodes(spark, sf_dir))["node"]


def p4_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of comments of both sources."""
    return subtype_tables(_nodes(spark, sf_dir))["comment"]


def p4_placeholders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of placeholders of both sources."""
    return subtype_tables(_nodes(spark, sf_dir))["more"]


def p4_child_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table of the ids that placeholders stand for."""
    return subtype_tables(_nodes(spark, sf_dir))["more_child"]


def p4_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes each state, that is each structural variant down to the leaves, has, per owner and kind."""
    return _nodes(spark, sf_dir).groupBy("owner", "node_kind", "variant", "state").agg(F.count("*").alias("nodes"))


def _latest_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_nodes(table(spark, sf_dir, "deep_comments"), "id", "parent_id", "thread_id", "fetched_at", "row_id", "depth")


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(_latest_comments(spark, sf_dir))


def _with_kind(kind: str, c: str):
    return F.concat(F.lit(kind), F.col(c))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _comments(spark, sf_dir)
    wrong = (F.col("chain_end") == "post") & F.col("kept").isNotNull() & (F.col("kept") != F.col("real_depth"))
    state = F.when(F.col("chain_end") != "post", F.col("chain_end")).when(wrong, "depth")
    root = F.when(F.col("chain_end") == "post", _with_kind("t3_", "scope")).otherwise(_with_kind("t1_", "root"))
    return found.select(_with_kind("t1_", "node").alias("id"), root.alias("root_id"), "real_depth", state.alias("state")).where("state IS NOT NULL")


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comment with root, depth, path and number of descendants; below a cycle, paths start at the ring."""
    whole = hierarchy(_latest_comments(spark, sf_dir), True, rings_as_heads=True)
    return whole.select(_with_kind("t3_", "scope").alias("thread_id"), _with_kind("t1_", "node").alias("id"), _with_kind("t1_", "root").alias("root_id"), "real_depth", "chain_end", F.array_join("path", "/").alias("path"), F.col("below").alias("descendants"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every comment with each comment below it and how far below."""
    pairs = all_descendants(_latest_comments(spark, sf_dir))
    return pairs.select(_with_kind("t3_", "scope").alias("thread_id"), _with_kind("t1_", "ancestor").alias("ancestor_id"), _with_kind("t1_", "descendant").alias("descendant_id"), "distance")


def p5_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cycle with the back edge that closes it, the nodes on it, and all whose chain leads into it."""
    found = back_edges(_comments(spark, sf_dir))
    return found.select(_with_kind("t3_", "scope").alias("thread_id"), _with_kind("t1_", "node").alias("id"), _with_kind("t1_", "back_to").alias("back_to"), "ring_nodes", "nodes")


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p4_comments": p4_comments, "p4_placeholders": p4_placeholders, "p4_child_ids": p4_child_ids, "p4_variants": p4_variants, "p5_found": p5_found, "p5_hierarchy": p5_hierarchy, "p5_descendants": p5_descendants, "p5_cycles": p5_cycles}


def _fields(names: tuple[str, ...]) -> str:
    """The content fields of ``x`` as one text: numbers by value, a missing field like null."""
    parts = []
    for f in names:
        value = f"json_extract_string(x, '$.{f}')"
        if f in ("createdUtc", "depth", "count"):
            value = f"CAST(TRY_CAST({value} AS DOUBLE) AS VARCHAR)"
        elif f == "childIds":
            value = "CAST(json_extract(x, '$.childIds') AS VARCHAR)"
        parts.append(f"coalesce({value}, chr(1))")
    return f"concat_ws(chr(2), {', '.join(parts)})"


def _texts(name: str, fields: tuple[str, ...]) -> str:
    """The elements of an array as one text per document."""
    array = f"json_extract(j, '$.{name}[*]')"
    return f"SELECT snapshot_no, k, string_agg(c, chr(3) ORDER BY i) AS texts FROM (SELECT snapshot_no, k, i, {_fields(fields)} AS c FROM (SELECT snapshot_no, k, unnest({array}) AS x, generate_subscripts({array}, 1) AS i FROM docs)) GROUP BY 1, 2"


_SNAPSHOTS = f"""
    WITH last AS (SELECT snapshot_no, lower(conversation_id) AS k, normalized_content AS j FROM conversation_versions WHERE snapshot_no IS NOT NULL AND conversation_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY snapshot_no, lower(conversation_id) ORDER BY delivered_at DESC NULLS LAST, row_id DESC) = 1),
    docs AS (SELECT snapshot_no, k, CASE WHEN json_type(j) = 'VARCHAR' THEN CAST(json_extract_string(j, '$') AS JSON) ELSE CAST(j AS JSON) END AS j FROM last),
    posts AS (SELECT snapshot_no, k, {_fields(POST_FIELDS)} AS texts FROM (SELECT snapshot_no, k, json_extract(j, '$.post') AS x FROM docs)),
    comments AS ({_texts("comments", COMMENT_FIELDS)}),
    more AS ({_texts("unresolvedMore", MORE_FIELDS)}),
    content AS (SELECT p.snapshot_no, p.k, concat_ws(chr(4), p.texts, coalesce(c.texts, ''), coalesce(m.texts, '')) AS content FROM posts p LEFT JOIN comments c ON p.snapshot_no = c.snapshot_no AND p.k = c.k LEFT JOIN more m ON p.snapshot_no = m.snapshot_no AND p.k = m.k),
    numbers AS (SELECT snapshot_no, lead(snapshot_no) OVER (ORDER BY snapshot_no) AS following FROM (SELECT DISTINCT snapshot_no FROM content)),
    old AS (SELECT n.following AS snapshot_no, k, content FROM content c JOIN numbers n ON c.snapshot_no = n.snapshot_no WHERE n.following IS NOT NULL),
    new AS (SELECT * FROM content WHERE snapshot_no > (SELECT min(snapshot_no) FROM content))
    SELECT CAST(coalesce(n.snapshot_no, o.snapshot_no) AS INTEGER) AS snapshot_no, coalesce(n.k, o.k) AS conversation_id, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
    FROM old o FULL JOIN new n ON o.snapshot_no = n.snapshot_no AND o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.content <> n.content
"""
_NODES = """
    WITH RECURSIVE v AS (SELECT row_id, CASE WHEN json_valid(normalized_content) THEN CASE WHEN json_type(normalized_content) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(normalized_content, '$')) THEN CAST(json_extract_string(normalized_content, '$') AS JSON) END ELSE CAST(normalized_content AS JSON) END END AS j FROM conversation_versions),
    vc AS (SELECT row_id, unnest(json_extract(j, '$.comments[*]')) AS x, generate_subscripts(json_extract(j, '$.comments[*]'), 1) - 1 AS pos FROM v),
    vm AS (SELECT row_id, unnest(json_extract(j, '$.unresolvedMore[*]')) AS x, generate_subscripts(json_extract(j, '$.unresolvedMore[*]'), 1) - 1 AS pos FROM v),
    vk AS (SELECT row_id, coalesce(json_extract_string(x, '$.id'), '') AS own, unnest(json_extract(x, '$.childIds[*]')) AS c, generate_subscripts(json_extract(x, '$.childIds[*]'), 1) - 1 AS pos FROM vm),
    a AS (SELECT DISTINCT creation_order, raw_artifact FROM retrieval_observations WHERE raw_artifact IS NOT NULL AND json_valid(raw_artifact)),
    d AS (SELECT creation_order, CASE WHEN json_type(raw_artifact) = 'VARCHAR' THEN CAST(json_extract_string(raw_artifact, '$') AS JSON) ELSE CAST(raw_artifact AS JSON) END AS j FROM a),
    t AS (SELECT creation_order, CASE WHEN json_type(json_extract(j, '$.content')) = 'VARCHAR' THEN CAST(json_extract_string(j, '$.content') AS JSON) ELSE json_extract(j, '$.content') END AS j FROM d WHERE json_extract(j, '$.content') IS NOT NULL),
    p AS (SELECT creation_order, coalesce(json_extract_string(j, '$[0].data.children[0].data.name'), 't3_' || json_extract_string(j, '$[0].data.children[0].data.id')) AS post, json_extract(j, '$[1].data.children') AS children FROM t WHERE json_type(j) = 'ARRAY'),
    n AS (
        SELECT creation_order, post AS parent, unnest(json_extract(children, '$[*]')) AS x, generate_subscripts(json_extract(children, '$[*]'), 1) - 1 AS pos FROM p
        UNION ALL
        SELECT creation_order, coalesce(json_extract_string(x, '$.data.name'), 't1_' || json_extract_string(x, '$.data.id')), unnest(json_extract(x, '$.data.replies.data.children[*]')), generate_subscripts(json_extract(x, '$.data.replies.data.children[*]'), 1) - 1
        FROM n WHERE json_extract_string(x, '$.kind') = 't1' AND json_type(json_extract(x, '$.data.id')) = 'VARCHAR' AND json_extract_string(x, '$.data.id') <> ''
    ),
    m AS (SELECT creation_order, parent, pos, x, coalesce(json_extract_string(x, '$.data.id'), '') AS own FROM n WHERE json_extract_string(x, '$.kind') = 'more' AND len(json_keys(json_extract(x, '$.data'))) > 0),
    mk AS (SELECT creation_order, own, unnest(json_extract(x, '$.data.children[*]')) AS c, generate_subscripts(json_extract(x, '$.data.children[*]'), 1) - 1 AS pos FROM m)
    SELECT DISTINCT owner, owner_key, node_kind, node_id, parent_id, CAST(pos AS INTEGER) AS pos FROM (
        SELECT 'version' AS owner, row_id AS owner_key, 'comment' AS node_kind, coalesce(json_extract_string(x, '$.id'), '') AS node_id, coalesce(json_extract_string(x, '$.parentId'), '') AS parent_id, pos FROM vc
        UNION ALL SELECT 'version', row_id, 'more', coalesce(json_extract_string(x, '$.id'), ''), coalesce(json_extract_string(x, '$.parentId'), ''), pos FROM vm
        UNION ALL SELECT 'version', row_id, 'more_child', coalesce(json_extract_string(c, '$'), ''), own, pos FROM vk
        UNION ALL SELECT 'observation', creation_order, 'comment', coalesce(json_extract_string(x, '$.data.name'), 't1_' || json_extract_string(x, '$.data.id')), parent, pos FROM n WHERE json_extract_string(x, '$.kind') = 't1' AND json_type(json_extract(x, '$.data.id')) = 'VARCHAR' AND json_extract_string(x, '$.data.id') <> ''
        UNION ALL SELECT 'observation', creation_order, 'more', own, parent, pos FROM m
        UNION ALL SELECT 'observation', creation_order, 'more_child', coalesce(json_extract_string(c, '$'), ''), own, pos FROM mk)
"""

_KEY = "nullif(regexp_replace(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), '^t[0-9]+_', ''), '')"
WALK = f"""
    WITH RECURSIVE keyed AS (SELECT {_KEY.format(c="id")} AS id, {_KEY.format(c="parent_id")} AS parent, {_KEY.format(c="thread_id")} AS thread, depth, score, fetched_at, row_id FROM deep_comments),
    nodes AS (SELECT * FROM keyed WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST, row_id DESC) = 1),
    linked AS (SELECT n.id, n.thread, n.depth, n.parent, CASE WHEN n.parent = n.thread THEN 'post' WHEN p.id IS NULL THEN 'orphan' END AS ends FROM nodes n LEFT JOIN nodes p ON n.thread = p.thread AND n.parent = p.id),
    walk AS (SELECT id, id AS node, [id] AS path FROM linked
        UNION ALL SELECT w.id, l.parent, list_append(w.path, l.parent) FROM walk w JOIN linked l ON l.id = w.node WHERE l.ends IS NULL AND NOT list_contains(w.path, l.parent)),
    stops AS (SELECT id, arg_max(node, len(path)) AS top, arg_max(path, len(path)) AS path FROM walk GROUP BY id),
    found AS (SELECT s.id, o.thread, o.depth, t.ends, s.top, len(s.path) - 1 AS above, list_slice(s.path, list_position(s.path, t.parent), len(s.path)) AS ring FROM stops s JOIN linked o ON o.id = s.id JOIN linked t ON t.id = s.top)
"""
SQL: dict[str, str] = {
    "p2_found": _SNAPSHOTS,
    "p4_found": _NODES,
    "p5_cycles": WALK + """
        SELECT 't3_' || f.thread AS thread_id, 't1_' || list_min(f.ring) AS id, 't1_' || min(h.parent) AS back_to, min(len(f.ring)) AS ring_nodes, count(*) AS nodes
        FROM found f JOIN linked h ON h.id = list_min(f.ring) WHERE f.ends IS NULL GROUP BY 1, 2
    """,
    "p5_hierarchy": WALK + """,
        onring AS (SELECT id, path, ring, ends, thread, above, top, list_position(ring, id) > 0 AS on_ring FROM (SELECT f.*, s.path FROM found f JOIN stops s ON s.id = f.id)),
        ways AS (SELECT id, thread, ends, above, top, ring, CASE WHEN ends IS NULL THEN list_slice(path, 1, greatest(1, len(path) - len(ring) + 1)) ELSE path END AS way FROM onring),
        below AS (SELECT u AS id, count(*) AS n FROM (SELECT id, unnest(way) AS u FROM ways) WHERE u <> id GROUP BY 1),
        rings AS (SELECT list_min(ring) AS least, count(*) - 1 AS n FROM found WHERE ends IS NULL GROUP BY 1)
        SELECT 't3_' || coalesce(w.thread, '') AS thread_id, 't1_' || w.id AS id, 't1_' || CASE WHEN w.ends IS NULL THEN list_min(w.ring) ELSE w.top END AS root_id, CAST(CASE WHEN w.ends IS NULL THEN -1 ELSE w.above END AS INTEGER) AS real_depth,
        coalesce(w.ends, 'cycle') AS chain_end, array_to_string(list_reverse(w.way), '/') AS path, coalesce(CASE WHEN w.ends IS NULL AND list_contains(w.ring, w.id) THEN r.n ELSE b.n END, 0) AS descendants
        FROM ways w LEFT JOIN below b ON b.id = w.id LEFT JOIN rings r ON w.ends IS NULL AND r.least = list_min(w.ring)
    """,
    "p5_descendants": WALK + """
        SELECT 't3_' || o.thread AS thread_id, 't1_' || a.above AS ancestor_id, 't1_' || a.id AS descendant_id, CAST(a.place - 1 AS INTEGER) AS distance
        FROM (SELECT id, unnest(path) AS above, generate_subscripts(path, 1) AS place FROM stops) a JOIN linked o ON o.id = a.id WHERE a.place > 1
    """,
    "p5_found": WALK + """
        SELECT 't1_' || id AS id, CASE WHEN ends IS NULL THEN 't1_' || list_min(ring) WHEN ends = 'orphan' THEN 't1_' || top ELSE 't3_' || thread END AS root_id,
        CAST(CASE WHEN ends IS NULL THEN -1 ELSE above END AS INTEGER) AS real_depth, CASE WHEN ends IS NULL THEN 'cycle' WHEN ends = 'orphan' THEN 'orphan' ELSE 'depth' END AS state
        FROM found WHERE ends IS NULL OR ends = 'orphan' OR (depth IS NOT NULL AND depth <> above)
    """,
}
