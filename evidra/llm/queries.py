"""Queries of the training-data problems, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.llm.abuse import score_texts
from evidra.llm.encoding import repair_texts
from evidra.llm.mixing import mix, source_key
from evidra.llm.pii import mentions, replace_all, surrogate_checks, types_present
from evidra.llm.tokenizer import encode
from evidra.llm.topn import top_n
from evidra.session import table


#: Sources of documents that are written by the product's own side, and how many of their texts train the classifier of problem 1.
OWN_SIDE, MOST_OWN_SIDE = ("search_snippet", "analysis_rationale", "draft_reply", "campaign_brief", "field_note"), 1500


def _scored(spark: SparkSession, sf_dir: str, key: tuple[str, ...] = ("row_id",)) -> DataFrame:
    examples = [(r["text"], int(r["verdict"] != "none")) for r in table(spark, sf_dir, "moderation_examples").where("text IS NOT NULL AND verdict IS NOT NULL").orderBy("example_id").collect()]  # a fixed, reviewed table
    # Texts the product's own side wrote are harmless by origin: a bounded sample, the same one whatever the files' order. A
    # threshold on the hash leaves about twice as many as wanted, so that no task sends more than its share to the driver.
    own_side = table(spark, sf_dir, "documents").where(source_key(F.col("source")).isin(*OWN_SIDE) & F.col("text").isNotNull()).select("text")
    share = min(1.0, 2 * MOST_OWN_SIDE / max(1, own_side.count()))
    own_side = own_side.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(F.xxhash64("text"), "text").limit(MOST_OWN_SIDE)
    harmless = [r["text"] for r in own_side.collect()]
    comments = table(spark, sf_dir, "deep_comments").select(F.struct(*key).alias("row"), "body")
    return score_texts(comments, "row", "body", examples, harmless).select("row.*", "score")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("score > 0").select("row_id")


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to review per source, of all rows of the source."""
    bad = F.count_if(F.col("score") > 0)
    return _scored(spark, sf_dir, ("subreddit",)).groupBy("subreddit").agg(F.count("*").alias("rows"), bad.alias("to_review"), (bad / F.count("*")).alias("rate"))


#: The key of the surrogates of problem 3; whoever holds it can undo them, so a user passes an own one.
SECRET = b"evidra-surrogates"


def p3_found(spark: SparkSession, sf_dir: str, secret: bytes = SECRET) -> DataFrame:
    found = types_present(table(spark, sf_dir, "deep_comments"), "row_id", ["body"], ["author"], secret)
    return found.select(F.col("key").alias("row_id"), "field_name", "pii_type")


def p3_replaced(spark: SparkSession, sf_dir: str, secret: bytes = SECRET) -> DataFrame:
    """Every body and author with typed placeholders, and with surrogates."""
    return replace_all(table(spark, sf_dir, "deep_comments"), "row_id", ["body"], ["author"], secret).withColumnRenamed("key", "row_id")


def p3_checks(spark: SparkSession, sf_dir: str, secret: bytes = SECRET) -> DataFrame:
    """Per type the entities and surrogates of the whole table, and how many break distinctness or coreference."""
    return surrogate_checks(mentions(table(spark, sf_dir, "deep_comments"), "row_id", ["body"], ["author"], secret))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    opportunities = table(spark, sf_dir, "opportunities").groupBy("id").agg(F.max(F.struct("updated_at", "creation_order", "campaign_id", "analysis_id")).alias("last")).select("id", "last.*").where("campaign_id IS NOT NULL")
    analyses = table(spark, sf_dir, "analyses").where("relevance BETWEEN 0 AND 1").groupBy(F.col("id").alias("analysis_id")).agg(F.max("relevance").alias("relevance"))
    best = top_n(opportunities.join(analyses, "analysis_id"), "campaign_id", "id", "relevance", "creation_order", 3)
    return best.select(F.col("grp").alias("campaign_id"), F.col("item").alias("opportunity_id"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sized = encode(table(spark, sf_dir, "documents"), "doc_id", "text", counts_only=True, keep="source")
    targets = [tuple(r) for r in table(spark, sf_dir, "mix_targets").select("source", "target_share", "max_repeats").collect()]
    return mix(sized, "doc_id", "source", "tokens", targets)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_texts(table(spark, sf_dir, "documents"), "doc_id", "text").where("garbled").select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents with what could be restored."""
    return repair_texts(table(spark, sf_dir, "documents"), "doc_id", "text").where("garbled").select("doc_id", "restored", "steps")


QUERIES = {"p1_found": p1_found, "p1_scores": p1_scores, "p1_rates": p1_rates, "p3_found": p3_found, "p3_replaced": p3_replaced, "p3_checks": p3_checks, "p6_found": p6_found, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_report": p8_report, "p9_found": p9_found, "p9_restored": p9_restored}
SQL = {
    "p6_found": """
        WITH latest AS (SELECT * FROM opportunities QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, creation_order DESC) = 1),
        valid AS (SELECT id, max(relevance) AS relevance FROM analyses WHERE relevance BETWEEN 0 AND 1 AND NOT isnan(relevance) GROUP BY id)
        SELECT campaign_id, o.id AS opportunity_id FROM latest o JOIN valid a ON o.analysis_id = a.id WHERE campaign_id IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY relevance DESC, o.creation_order DESC, o.id) <= 3
    """,
}
