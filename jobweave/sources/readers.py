"""Landed answers of board systems as item rows, and the registry of sources.

Answers land as files (one JSON line {"slug", "payload"} for each, and {"key", "payload"} for details); live HTTP is not the engine's work. A malformed
answer gives no items and stops nobody else. Titles are looked at before details are joined, so few details are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobweave.operators.rules import FilterConfig, passes_gate, title_fails
from jobweave.sources import normalise

#: Sources in order of priority, what holds a source's items, and how many of a slug are read.
REGISTRY = ["greenhouse", "lever", "ashby", "workday", "workable", "smartrecruiters", "jibe", "oracle", "remoteok", "weworkremotely", "hackernews", "ycombinator"]
ENVELOPES = {"greenhouse": "jobs", "lever": None, "ashby": "jobs", "workday": "jobPostings", "workable": "results", "smartrecruiters": "content", "jibe": "jobs", "remoteok": None, "hackernews": "children"}
CAPS = {"workday": 100, "workable": 200, "smartrecruiters": 200, "jibe": 1000, "oracle": 4000, "ycombinator": 250}
ANSWER = "slug string, payload string, page int"


def landed(spark: SparkSession, path: str) -> DataFrame:
    """slug, payload, page of landed answers; corrupt lines are dropped."""
    return spark.read.schema(ANSWER).json(path).where("slug is not null and payload is not null")


def enabled_slugs(boards: DataFrame, source: str) -> DataFrame:
    return boards.where((F.col("source") == source) & F.col("enabled")).select("slug").orderBy("slug")


def items(answers: DataFrame, source: str) -> DataFrame:
    """slug, item, place: the items of all pages, each as a JSON string, up to the source's cap for each slug."""
    envelope = ENVELOPES.get(source)
    if source == "oracle":
        listed = normalise.oracle_page(F.col("payload"))["items"]
    elif source == "jibe":  # items are wrapped as {"data": {...}}, or bare
        listed = F.transform(F.from_json("payload", "jobs array<string>")["jobs"], lambda j: F.coalesce(F.get_json_object(j, "$.data"), j))
    elif envelope is None:
        listed = F.from_json("payload", "array<string>")
    else:
        listed = F.from_json("payload", f"{envelope} array<string>")[envelope]
    page = F.coalesce("page", F.lit(0)) if "page" in answers.columns else F.lit(0)
    rows = answers.select("slug", page.alias("page"), F.posexplode(listed).alias("k", "item")).withColumn("place", F.struct("page", "k"))
    if source in CAPS:
        rank = F.row_number().over(Window.partitionBy("slug").orderBy("place"))
        rows = rows.withColumn("r", rank).where(F.col("r") <= CAPS[source])
    return rows.select("slug", "item", "place")


def once(rows: DataFrame, key: str) -> DataFrame:
    """Items whose key (a JSON path) comes first within its slug; those without a key go."""
    value = F.get_json_object("item", key)
    rank = F.row_number().over(Window.partitionBy("slug", "key").orderBy("place"))
    return rows.withColumn("key", value).where("key is not null").withColumn("r", rank).where("r = 1").drop("r")


def with_details(rows: DataFrame, details: DataFrame, title: str, key: str, config: FilterConfig | None = None, gate: bool = False, required: bool = True) -> DataFrame:
    """Items whose title may pass, joined with their details (slug, key, detail)."""
    name = F.get_json_object("item", title)
    likely = passes_gate(name) if gate else ~title_fails(name, config)
    return once(rows.where(likely), key).join(details, ["slug", "key"], "inner" if required else "left")


def hiring_threads(threads: DataFrame, newest: int = 2) -> DataFrame:
    """The newest threads (id, title, created) about who is hiring."""
    return threads.where(F.contains(F.lower("title"), F.lit("who is hiring"))).orderBy(F.desc("created"), F.desc("id")).limit(newest)


def feed(spark: SparkSession, path: str) -> DataFrame:
    """A feed's items as the struct column i."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(normalise.FEED_ITEM).load(path)
    return rows.select(F.struct(*rows.columns).alias("i"))


def all_postings(tables: dict[str, DataFrame]) -> DataFrame:
    """The records of all sources, with source_rank, the order in which equal postings win. tables: items by source."""
    out = None
    for rank, source in enumerate(REGISTRY):
        if source in tables:
            rows = getattr(normalise, source)(tables[source]).withColumn("source_rank", F.lit(rank))
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no known source")
    return out


def resume_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modified, content of resume files; their text comes from an extractor of the caller's."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"), "content")


def draft_files(spark: SparkSession, path: str) -> DataFrame:
    """job_id, files, modified: which draft files a job has, and when the last was changed. Paths are <job_id>/<kind>.<ending>."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    job, kind = (F.regexp_extract("path", r"/(\d+)/((?:resume|cover_letter)\.(?:md|pdf))$", k) for k in (1, 2))
    return files.select(job.alias("job_id"), kind.alias("kind"), "modificationTime").where("kind <> ''").groupBy("job_id").agg(F.sort_array(F.collect_set("kind")).alias("files"), F.max("modificationTime").alias("modified"))


def personal_files(paths: DataFrame) -> DataFrame:
    """Paths of a tree that hold personal data: databases, resumes, drafts."""
    return paths.where(F.col("path").rlike(r"(?i)\.(db|sqlite3?)(-wal|-shm|-journal)?$|(^|/)resumes/[^/]+|(^|/)applications/\d+(/|$)"))
