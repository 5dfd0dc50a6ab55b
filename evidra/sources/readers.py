"""Sources: workspace tables, query plans, observation documents, artifacts, result pages, reports."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.session import map_arrow

PLAN_SCHEMA = "schemaVersion int, frozenAt string, campaignContext string, queries array<struct<id: string, pattern: string, query: string, subreddits: array<string>>>"


def workspace_table(spark: SparkSession, path: str, workspace: str) -> DataFrame:
    """A table's rows of one workspace; the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col("workspace_id") == workspace)


def point(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == value).limit(1)


def query_plans(spark: SparkSession, path: str) -> DataFrame:
    """One row per query of each plan file, with ``problem`` by the first rule it breaks."""
    from evidra.operators.validate import first_rule

    plans = spark.read.schema(PLAN_SCHEMA + ", _bad string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("file", F.input_file_name())
    rows = plans.select("file", "schemaVersion", "_bad", F.size("queries").alias("planned"), F.expr("size(array_distinct(transform(queries, q -> q.id)))").alias("ids"), F.posexplode_outer("queries").alias("pos", "q"))
    problem = first_rule([
        (F.col("_bad").isNotNull(), "unreadable"), (~F.col("schemaVersion").eqNullSafe(F.lit(1)), "schema version"), (F.col("ids") != F.col("planned"), "repeated id"),
        (~F.coalesce(F.col("q.id").rlike("^[A-Za-z0-9_-]{1,64}$"), F.lit(False)), "id"), (F.coalesce(F.trim("q.query"), F.lit("")) == "", "empty query"),
    ])
    return rows.select("file", "pos", "q.*", problem.alias("problem"))


def documents(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """JSON files below a folder: path, time, digest of the exact bytes, and the parsed value, null if it is no JSON."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "modificationTime", "length", F.sha2("content", 256).alias("sha256"), F.try_parse_json(F.decode("content", "UTF-8")).alias("document"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def located(stdout: Column) -> Column:
    """Where an attempt's output says its evidence lies: the folder, or null."""
    return F.try_variant_get(F.try_parse_json(stdout), "$.evidenceDirectory", "string")


def document_source(stdout: Column, on_disk: Column) -> Column:
    """disk, disk_unreadable, no_evidence_pointer or none."""
    parsed = F.try_parse_json(stdout)
    return F.when(parsed.isNull(), "none").when(located(stdout).isNull(), "no_evidence_pointer").when(on_disk.isNull(), "disk_unreadable").otherwise("disk")


def recovered(files: DataFrame, prefix: str) -> DataFrame:
    """Of a timed-out attempt's files, the first that parses: own prefix first, then the newest, then by path."""
    good = files.where(F.schema_of_variant("document").startswith("OBJECT"))
    own = F.element_at(F.split("path", "/"), -1).startswith(prefix)
    return good.select(F.min_by(F.struct("path", "sha256", "document"), F.struct((~own).alias("other"), (-F.unix_micros(F.col("modificationTime").cast("timestamp"))).alias("age"), "path")).alias("best")).where("best IS NOT NULL").select("best.*")


def recovered_by(files: DataFrame, group: str, prefix: str) -> DataFrame:
    """``recovered`` for many attempts at once: of each group's files the first that parses; ``prefix`` is a column."""
    good = files.where(F.schema_of_variant("document").startswith("OBJECT"))
    foreign = ~F.coalesce(F.element_at(F.split("path", "/"), -1).startswith(F.col(prefix)), F.lit(False))
    order = F.struct(foreign.alias("other"), (-F.unix_micros(F.col("modificationTime").cast("timestamp"))).alias("age"), "path")
    return good.groupBy(group).agg(F.min(F.struct(order.alias("place"), F.col("path").alias("found"))).alias("best"), F.count("*").alias("readable")).select(group, F.col("best.found").alias("path"), "readable")


class _Results(HTMLParser):
    """Rows of a result page: each link of the result class, with the text that follows until the next one."""

    def __init__(self, link_class: str):
        super().__init__(convert_charrefs=True)
        self.link_class, self.rows, self.inside, self.kind = link_class, [], None, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "a" and (self.link_class in classes if self.link_class else a.get("href")):
            self.rows.append({"href": a.get("href") or "", "title": "", "snippet": "", "displayedUrl": ""})
            self.inside = "title"
        elif self.rows:
            self.kind = "snippet" if "result-snippet" in classes else "displayedUrl" if "link-text" in classes else self.kind

    def handle_endtag(self, tag):
        if tag == "a":
            self.inside = None
        elif tag in ("td", "span"):
            self.kind = None

    def handle_data(self, data):
        if self.rows:
            where = self.inside or self.kind
            if where:
                self.rows[-1][where] += data


def _extracting(link_class: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, page in zip(b.column("key").to_pylist(), b.column("page").to_pylist()):
                if page:
                    parser = _Results(link_class)
                    parser.feed(page)
                    out += [(key, i, r["href"], r["title"].strip(), " ".join(r["snippet"].split()), r["displayedUrl"].strip()) for i, r in enumerate(parser.rows)]
            types = [b.schema.field("key").type, pa.int32(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 6, types)], ["key", "pos", "href", "title", "snippet", "displayed_url"])

    return run


def result_rows(df: DataFrame, key: str, page: str, link_class: str = "result-link") -> DataFrame:
    """Result links of HTML pages; with an empty class every link with a target."""
    kind = df.schema[key].dataType.simpleString()
    rows = map_arrow(df.select(F.col(key).alias("key"), F.col(page).alias("page")), _extracting(link_class), f"key {kind}, pos int, href string, title string, snippet string, displayed_url string")
    return rows.withColumnRenamed("key", key)
