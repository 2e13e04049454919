"""Reading boards page by page and source by source, over pages and records made of the tables."""

import uuid

from pyspark.sql import functions as F

from jobweave.operators.lineage import cut_lineage, shared_folder
from jobweave.operators.numbering import numbered
from jobweave.plans.binding import POSTINGS, sql_one_of, table
from jobweave.plans.queries_sources import DEEP, deep_items
from jobweave.plans.queries_text import USED, made_items
from jobweave.plans.registry import query
from jobweave.sources import landing, normalise, paging
from jobweave.sources.readers import REGISTRY, items

LANDED = "jobweave.sources.paging:landed_row"


def folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def boards(spark, sf_dir, limit):
    """slug, place, page and a row's item: customers as the postings of five boards."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("b"), F.pmod("c_custkey", F.lit(5)).cast("string")).alias("slug"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    rows = numbered(rows, ["id"], ["slug"]).withColumn("page", F.floor(F.col("place") / limit))
    return rows.groupBy("slug", "page").agg(F.sort_array(F.collect_list(F.struct("place", "id", "name"))).alias("own"), F.count("*").alias("n"))


def laid(spark, pages, name):
    """Pages (slug, key, payload) written in order into a fixed number of files, and the slugs by which they are asked for."""
    path = folder(spark, name)
    bucket = F.pmod(F.crc32(F.encode(F.concat_ws("\n", "slug", "key"), "UTF-8")), F.lit(paging.BUCKETS)).cast("int")
    rows = pages.select("slug", F.col("key").cast("string").alias("key"), "payload", bucket.alias("bucket")).repartition(paging.BUCKETS, "bucket")
    rows.sortWithinPartitions("bucket", "slug", "key").write.partitionBy("bucket").parquet(path)
    return [f"{path}|b{k}" for k in range(5)]


def own_slug(column):
    return F.substring_index(column, "|", -1)


BOARDS = "(SELECT 'b' || (c_custkey % 5) AS slug, c_custkey AS id, row_number() OVER (PARTITION BY c_custkey % 5 ORDER BY c_custkey) AS place FROM customer)"


@query(f"SELECT slug, id::VARCHAR AS id FROM {BOARDS} WHERE place <= 200")
def paged_offsets(spark, sf_dir):
    """Boards that tell no usable total: pages by offset until one is empty or the source's cap is met."""
    plan = paging.PAGING["smartrecruiters"]
    own = F.transform("own", lambda r: F.struct(r["id"].cast("string").alias("id"), r["name"].alias("name")))
    made = boards(spark, sf_dir, plan.limit).select("slug", (F.col("page") * plan.limit).alias("key"), F.to_json(F.struct(F.lit("many").alias("totalFound"), own.alias("content"))).alias("payload"))
    answers = paging.pages(spark, LANDED, laid(spark, made, "offsets"), plan).where("error is null or error <> 'status 404'")
    return items(answers, "smartrecruiters").select(own_slug("slug").alias("slug"), F.get_json_object("item", "$.id").alias("id"))


@query(f"SELECT slug, id::VARCHAR AS id, ((place - 1) // 40)::INTEGER AS page FROM {BOARDS} WHERE place <= 200")
def paged_tokens(spark, sf_dir):
    """Boards of which each answer names the next page, read as a stream, one page of each to a micro-batch."""
    limit, plan = 40, paging.PAGING["workable"]
    own = F.transform("own", lambda r: F.struct(r["id"].cast("string").alias("shortcode"), r["name"].alias("title")))
    made = cut_lineage(boards(spark, sf_dir, limit))
    last = made.groupBy("slug").agg(F.max("page").alias("last"))
    made = made.join(last, "slug").withColumn("next", F.when(F.col("page") < F.col("last"), F.concat(F.lit("t"), (F.col("page") + 1).cast("string"))))
    made = made.select("slug", F.when(F.col("page") == 0, "0").otherwise(F.concat(F.lit("t"), F.col("page").cast("string"))).alias("key"), F.to_json(F.struct(own.alias("results"), F.col("next").alias("nextPage"))).alias("payload"))
    root = folder(spark, "crawl")
    stream = paging.page_stream(spark, LANDED, laid(spark, made, "tokens"), plan, f"{root}/places", wait=0)
    run = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").start()
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    answers = spark.read.schema(stream.schema).parquet(f"{root}/out").where("error is null")
    found = items(answers, "workable")
    return found.select(own_slug("slug").alias("slug"), F.get_json_object("item", "$.shortcode").alias("id"), F.col("place.page").alias("page"))


@query(f"SELECT slug, t AS term, id::VARCHAR AS id FROM {BOARDS}, (VALUES ('software engineer'), ('node')) v(t) WHERE place <= 100")
def paged_terms(spark, sf_dir):
    """Boards that are asked for each search term, so many postings of each; two terms find nothing."""
    plan = paging.PAGING["workday"]
    own = F.transform("own", lambda r: F.struct(r["name"].alias("title"), r["id"].cast("string").alias("externalPath")))
    made = boards(spark, sf_dir, plan.limit).withColumn("term", F.explode(F.array(F.lit("software engineer"), F.lit("node"))))
    made = made.select("slug", F.concat_ws("~", "term", (F.col("page") * plan.limit).cast("string")).alias("key"), F.to_json(F.struct(own.alias("jobPostings"))).alias("payload"))
    none = spark.range(5).select(F.concat(F.lit("b"), F.col("id").cast("string")).alias("slug"), F.explode(F.array(F.lit("typescript~0"), F.lit("javascript~0"))).alias("key"), F.lit('{"jobPostings": []}').alias("payload"))
    # A board whose postings fill their last page answers with an empty one.
    over = boards(spark, sf_dir, plan.limit).groupBy("slug").agg(F.sum("n").alias("n")).where(F.col("n") % plan.limit == 0).select("slug", F.explode(F.array(F.lit("software engineer"), F.lit("node"))).alias("term"), "n")
    over = over.select("slug", F.concat_ws("~", "term", F.col("n").cast("string")).alias("key"), F.lit('{"jobPostings": []}').alias("payload"))
    answers = paging.pages(spark, LANDED, laid(spark, made.unionByName(none).unionByName(over), "terms"), plan)
    listed = answers.where("error is null").select("slug", "term", F.explode(F.from_json("payload", "jobPostings array<string>")["jobPostings"]).alias("item"))
    return listed.select(own_slug("slug").alias("slug"), "term", F.get_json_object("item", "$.externalPath").alias("id"))


ALL = f"SELECT {sql_one_of(USED, 'id')} AS source FROM ({POSTINGS}) UNION ALL SELECT ({DEEP})[1 + id % 5] FROM ({POSTINGS})"


@query(
    f"SELECT r.source, r.k::INTEGER AS source_rank, CASE WHEN r.source = 'lever' THEN 0 ELSE count(a.source) END AS fetched, r.source = 'lever' AS failed, CASE WHEN r.source = 'lever' THEN 0 ELSE count(a.source) END AS landed "
    f"FROM (SELECT unnest({REGISTRY}) AS source, unnest(range(0, 12)) AS k) r LEFT JOIN ({ALL}) a ON a.source = r.source GROUP BY r.source, r.k"
)
def isolated_sources(spark, sf_dir):
    """All twelve sources, one of which raises at one of its rows: it has none, the others have all of theirs."""
    tables = made_items(spark, sf_dir) | deep_items(spark, sf_dir)

    def source(name):
        def read(_):
            rows = tables[name]
            if name == "lever":
                broken = F.get_json_object("item", "$.id").endswith("7")
                rows = rows.withColumn("item", F.when(broken, F.raise_error(F.lit("no answer")).cast("string")).otherwise(F.col("item")))
            return getattr(normalise, name)(rows)

        return read

    done = landing.landed(spark, {name: source(name) for name in REGISTRY})
    rows = done.records.withColumn("outcome", F.lit("landed"))
    return landing.by_source(done.report, rows, ["landed"]).select("source", "source_rank", "fetched", F.col("error").isNotNull().alias("failed"), "landed")
