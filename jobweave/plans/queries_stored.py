"""What later batches find of earlier ones: fingerprints in an index or in a stream's state, companies by name, tables that change while they are read; and order-dependent plans of which one key holds all rows."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from jobweave.functions.text import normal_title
from jobweave.operators import batching, companies, dedupe, listing, state
from jobweave.operators.changelog import ChangeLog
from jobweave.operators.ledger import Ledger
from jobweave.operators.lineage import cut_lineage, shared_folder
from jobweave.operators.print_index import PrintIndex
from jobweave.operators.search_index import SearchIndex
from jobweave.plans.binding import table
from jobweave.plans.ingest import ingested, remembered, stats
from jobweave.plans.queries_dedupe import DIGESTS, DISTANCE, prints
from jobweave.plans.queries_rules import CONFIG
from jobweave.plans.registry import query
from jobweave.plans.structured import BATCH_SCORES, structured
from jobweave.sources import sinks
from jobweave.streaming import lookback


def folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    f"""{DIGESTS}, old AS (SELECT * FROM prints WHERE id % 3 < 2 AND (id % 60) >= 20)
    SELECT a.id, min(b.id) AS first, arg_min(CASE WHEN b.id % 5 = 0 THEN b.id - 1 ELSE b.id END, b.id) AS root FROM prints a JOIN old b ON {DISTANCE} <= 3 WHERE a.id % 3 = 2 GROUP BY a.id"""
)
def index_links(spark, sf_dir):
    """Fingerprints of two batches in an index, then looked up for a third one, within a window. Each ends at what its stored row is linked to."""
    rows = prints(spark, sf_dir).withColumn("at", F.date_add(F.lit("2000-01-01").cast("date"), F.pmod("id", F.lit(60)).cast("int")))
    rows = rows.withColumn("root", F.when(F.pmod("id", F.lit(5)) == 0, F.col("id") - 1))
    index = PrintIndex(spark, folder(spark, "prints"))
    for k in (0, 1):
        index.add(rows.where(F.pmod("id", F.lit(3)) == k), f"batch-{k}")
    asked = rows.where(F.pmod("id", F.lit(3)) == 2)
    found = index.first_near(asked.select("print"), F.lit("2000-01-21").cast("timestamp"))
    return asked.select(F.col("id").alias("own"), "print").join(found.select("print", F.col("id").alias("first"), F.col("root").alias("end")), "print").select(F.col("own").alias("id"), "first", F.col("end").alias("root"))


WORDS = "array_to_string(list_transform(range(1, 61), lambda i: 'skill' || ((p_partkey % 37 + 1) * i % 97)), ' ')"
LINKS = f"""WITH r AS (SELECT p_partkey AS id, {WORDS} AS t, p_partkey % 28 <= 14 AS recent FROM part), old AS (SELECT * FROM r WHERE id % 4 = 0 AND recent), new AS (SELECT * FROM r WHERE id % 4 <> 0),
hit AS (SELECT n.id, min(o.id) AS stored, (SELECT min(m.id) FROM new m WHERE m.t = n.t AND m.id < n.id) AS earlier FROM new n LEFT JOIN old o ON o.t = n.t GROUP BY n.id, n.t)"""


def described(spark, sf_dir):
    """Postings that no rule drops and no key repeats, a third of a hundred descriptions among them."""
    k = F.col("p_partkey")
    words = F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("skill"), F.pmod((F.pmod(k, F.lit(37)) + 1) * i, F.lit(97)).cast("string")))
    return table(spark, sf_dir, "part").select(
        k.alias("ord"),
        F.lit("s").alias("source"),
        k.cast("string").alias("source_id"),
        F.concat(F.lit("https://example.org/"), k.cast("string")).alias("url"),
        F.concat(F.lit("Senior Software Engineer "), k.cast("string")).alias("title"),
        F.concat(F.lit("Firm"), k.cast("string")).alias("company_name"),
        F.concat(F.array_join(words, " ")).alias("description"),
        F.lit("Remote, US").alias("location"),
        F.lit(True).alias("remote"),
        F.array(F.lit("react")).alias("tags"),
        F.lit("2000-05-01").cast("date").alias("posted_at"),
    )


def linked(spark, sf_dir):
    """The ingest plan against stored postings whose fingerprints are in an index."""
    rows, now = described(spark, sf_dir), F.lit("2000-05-20").cast("timestamp")
    old = rows.where(F.pmod("ord", F.lit(4)) == 0)
    none = F.lit(None).cast("string")
    # What is stored comes by the same plan, its fingerprints go to the index.
    empty = spark.createDataFrame([], "id long, dedupe_hash string, title_key string, cross_source_hash string, jd_fingerprint string, ingested_at timestamp, duplicate_of long")
    before = ingested(old, empty, now, CONFIG)
    at = now - F.make_interval(days=F.pmod("ord", F.lit(28)).cast("int"))
    stored = cut_lineage(before.new.select(F.col("ord").alias("id"), "dedupe_hash", "title_key", "cross_source_hash", "jd_fingerprint", at.alias("ingested_at"), F.lit(None).cast("long").alias("duplicate_of")))
    index = PrintIndex(spark, folder(spark, "prints"))
    remembered(index, stored, "before")
    return ingested(rows.where(F.pmod("ord", F.lit(4)) != 0), stored.withColumn("jd_fingerprint", none), now, CONFIG, index=index)


@query(f"{LINKS} SELECT id, stored AS duplicate_of, CASE WHEN stored IS NULL THEN earlier END AS duplicate_of_ord FROM hit")
def ingest_links(spark, sf_dir):
    """New postings linked to stored ones by their fingerprints, else to the first new one like them. The stored table's own column is empty: the index alone knows them."""
    return linked(spark, sf_dir).new.select(F.col("ord").alias("id"), "duplicate_of", "duplicate_of_ord")


@query(f"{LINKS} SELECT count(*) AS fetched, count(*) AS inserted, 0::BIGINT AS dropped_filter, count(*) FILTER (stored IS NOT NULL OR earlier IS NOT NULL) AS flagged_jd_similar, count(*) AS passed_filter FROM hit")
def ingest_stats(spark, sf_dir):
    return stats(linked(spark, sf_dir)).select("fetched", "inserted", "dropped_filter", "flagged_jd_similar", "passed_filter")


@query(
    f"""{DIGESTS}, d AS (SELECT id, print, TIMESTAMP '2000-01-01' + id * INTERVAL 2 HOUR AS at FROM prints)
    SELECT a.id, arg_min(b.id, (b.at, b.id)) AS parent FROM d a JOIN d b ON b.id < a.id AND a.at - b.at <= INTERVAL 14 DAY AND {DISTANCE} <= 3 GROUP BY a.id"""
)
def stream_lookback(spark, sf_dir):
    """Links within two weeks, out of a stream's state, in three micro-batches."""
    rows = prints(spark, sf_dir).withColumn("at", F.lit("2000-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("id") * 2).cast("int")))
    root, third = folder(spark, "lookback"), (rows.agg(F.max("id")).first()[0] or 0) // 3 + 1
    for k in range(3):
        rows.where(F.floor(F.col("id") / third) == k).write.mode("append").parquet(f"{root}/in")
        lookback.linked(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), f"{root}/links", f"{root}/state").awaitTermination()
    return sinks.current(spark, f"{root}/links").select("id", "parent")


NAMES = "(SELECT DISTINCT l_returnflag || ' ' || l_partkey % 50 AS name, l_returnflag = 'N' AS early FROM lineitem)"


@query(f"SELECT name, (row_number() OVER (ORDER BY NOT early, name))::BIGINT AS id FROM {NAMES}")
def company_ids(spark, sf_dir):
    """Companies in two batches, and all of them once more: each keeps the number that it got first."""
    name = F.concat_ws(" ", "l_returnflag", F.pmod("l_partkey", F.lit(50)).cast("string")).alias("name")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", name)
    held = Ledger(spark, folder(spark, "companies"))
    companies.get_or_create(rows.where("l_returnflag = 'N'"), held, "early")
    companies.get_or_create(rows, held, "late")
    return companies.get_or_create(rows, held, "again").select("name", "id")


@query(
    """WITH RECURSIVE r AS (SELECT doc_id, coalesce(n_chars, 0)::BIGINT AS v, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
    s(k, b, n, t) AS (SELECT 1::BIGINT, 0::BIGINT, 1::BIGINT, v FROM r WHERE k = 1
      UNION ALL SELECT r.k, CASE WHEN s.n >= 8 OR s.t + v > 24000 THEN b + 1 ELSE b END, CASE WHEN s.n >= 8 OR s.t + v > 24000 THEN 1 ELSE s.n + 1 END, CASE WHEN s.n >= 8 OR s.t + v > 24000 THEN v ELSE s.t + v END
      FROM s JOIN r ON r.k = s.k + 1)
    SELECT doc_id, b AS batch FROM s JOIN r USING (k)"""
)
def chunk_pack_one_key(spark, sf_dir):
    """One key with all rows, packed over all tasks."""
    rows = table(spark, sf_dir, "documents").select(F.lit("all").alias("key"), "doc_id", "n_chars")
    return batching.packed(rows, "key", "doc_id", "n_chars").select("doc_id", "batch")


@query("SELECT (count(*) OVER (ORDER BY s_name, s_suppkey ROWS UNBOUNDED PRECEDING))::BIGINT AS rank, s_name AS key FROM supplier QUALIFY rank <= 25")
def blacklist_listing(spark, sf_dir):
    """Blacklisted names by key."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("key"), F.col("s_suppkey").alias("id"))
    page = listing.page(rows, listing.order_of("blacklist"), 25)
    return page.select("key", F.row_number().over(Window.orderBy(*listing.order_of("blacklist"))).cast("long").alias("rank"))  # of one page


@query("SELECT n_name AS slug, row_number() OVER (ORDER BY n_regionkey DESC, n_nationkey)::BIGINT AS rank FROM nation QUALIFY rank <= 10")
def watched_listing(spark, sf_dir):
    """Watched boards, newest first, out of seeds and found ones."""
    k = F.col("n_nationkey")
    boards = table(spark, sf_dir, "nation").select(F.lit("lever").alias("source"), F.col("n_name").alias("slug"), k.alias("id"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("n_regionkey").cast("int")).alias("added_at"))
    page = listing.page(boards, listing.order_of("watched"), 10)
    return page.select("slug", F.row_number().over(Window.orderBy(*listing.order_of("watched"))).cast("long").alias("rank"))  # of one page


@query("SELECT doc_id, text AS markdown FROM documents")
def appended_texts(spark, sf_dir):
    """A log that two batches are appended to, each in its own folder by day."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("markdown"), F.pmod("doc_id", F.lit(2)).cast("int").alias("day"))
    path = folder(spark, "log")
    for k in (0, 1):
        sinks.appended(rows.where(F.col("day") == k), path, ["day"])
    return spark.read.schema(rows.schema).parquet(path).select("doc_id", "markdown")


@query("SELECT p_brand, count(*) AS members, min(p_partkey) AS keeper FROM part GROUP BY p_brand")
def hot_keepers(spark, sf_dir):
    """Keepers of groups that hold a large share of all rows."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.lit(False).alias("archived"), normal_title(F.col("p_name")).alias("title"))
    kept = dedupe.keepers(rows, ["p_brand"], "archived", "p_partkey")
    return kept.groupBy("p_brand").agg(F.count("*").alias("members"), F.min(F.when(F.col("keeper"), F.col("p_partkey"))).alias("keeper"))


@query("SELECT l_orderkey, array_to_string(list(l_partkey ORDER BY k), ',') AS parts FROM (SELECT l_orderkey, l_partkey, min((l_linenumber, l_partkey)) AS k FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY ALL) GROUP BY l_orderkey")
def known_ids_in_order(spark, sf_dir):
    """Ids as they were asked for: each once, unknown ones left out."""
    asked = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("ids"))
    known = table(spark, sf_dir, "part").where("p_size < 40").select(F.col("p_partkey").alias("id"))
    return state.known_ids(asked, "l_orderkey", "ids", known).select("l_orderkey", F.array_join("ids", ",").alias("parts"))


TERMS = ["brand#1", "brand#23", "re", "e", "zzz", "#", "tion", "part", "brand#55"]
RANKED = "CASE WHEN n = t OR b = t THEN 0 WHEN n LIKE t || '%' OR b LIKE t || '%' THEN 1 ELSE 2 END::INTEGER"


@query(f"SELECT t AS term, p_partkey AS id, {RANKED} AS rank FROM (SELECT p_partkey, lower(p_name) AS n, lower(p_brand) AS b FROM part), (SELECT unnest({TERMS}) AS t) WHERE contains(n, t) OR contains(b, t)")
def search_index_hits(spark, sf_dir):
    """Parts by name and brand out of the index alone, in two batches, for terms of one letter and more."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand")
    index = SearchIndex(spark, folder(spark, "search"))
    for k in (0, 1):
        index.add(rows.where(F.pmod("id", F.lit(2)) == k), f"batch-{k}", ["p_name", "p_brand"])
    out = None
    for term in TERMS:
        found = index.search(term).select(F.lit(term).alias("term"), "id", "rank")
        out = found if out is None else out.unionByName(found)
    return out


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'changed' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 3 <> 0 THEN floor(c_acctbal)::BIGINT END AS balance, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 4 = 0 THEN c_name END AS note
    FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 10 = 0"""
)
def changelog_reads(spark, sf_dir):
    """A table of appended changes: rows, rows over them, rows that go, a compaction, rows with a new column, and some that come back."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"), F.floor("c_acctbal").alias("balance"), "c_name")
    log = ChangeLog(spark, folder(spark, "changes"), ["c_custkey"])
    own, k = rows.drop("c_name"), F.col("c_custkey")
    changed = own.withColumns({"segment": F.lit("changed"), "balance": F.lit(None).cast("long")})
    log.change(own, "all")
    log.change(changed.where(k % 3 == 0), "third")
    log.change(own.where(k % 5 == 0), "fifth", gone=True)
    log.compact()
    noted = rows.where((k % 3 == 0) & (k % 4 == 0) & (k % 5 != 0)).select("c_custkey", F.lit("changed").alias("segment"), F.lit(None).cast("long").alias("balance"), F.col("c_name").alias("note"))
    log.change(noted, "noted")
    back = F.when((k % 3 == 0) & (k % 4 == 0), F.col("c_name"))
    returned = rows.where(k % 10 == 0).select("c_custkey", F.when(k % 3 == 0, "changed").otherwise(F.col("segment")).alias("segment"), F.when(k % 3 != 0, F.col("balance")).alias("balance"), back.alias("note"))
    log.change(returned, "back")
    log.change(returned, "back")  # the same batch once more
    return log.read()


@query(
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 6 < 2 THEN p_partkey % 101 END::BIGINT AS score, CASE p_partkey % 6 WHEN 1 THEN 2 WHEN 0 THEN 1 WHEN 4 THEN 1 ELSE 2 END AS attempts,
    CASE p_partkey % 6 WHEN 2 THEN 'invalid JSON after retry: $.results[0].score: is over 100' WHEN 3 THEN 'invalid JSON after retry: $.results[0].id: is missing; $.results[0].rubric.fit.points: is string, not integer'
      WHEN 4 THEN 'RuntimeError: no such model' WHEN 5 THEN 'invalid JSON after retry: $.results: is object, not array' END AS error FROM part"""
)
def structured_answers(spark, sf_dir):
    """Answers of a model that are right, right at the second time, wrong in three ways, or do not come."""

    def model(prompt):
        k = int(prompt.split()[1])
        good = f'{{"results": [{{"id": {k}, "score": {k % 101}}}]}}'
        if k % 6 == 4:
            raise RuntimeError("no such model")
        return [
            f"Sure:\n```json\n{good}\n```",
            good if "holds no JSON object" in prompt else "I cannot say.",
            f'{{"results": [{{"id": {k}, "score": 400}}]}}',
            '{"results": [{"score": 4, "rubric": {"fit": {"points": "9"}}}]}',
            "",
            f'{{"results": {{"id": {k}}}}}',
        ][k % 6]

    prompts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("job "), F.col("p_partkey").cast("string")).alias("prompt"))
    out = structured(prompts, model, BATCH_SCORES)
    return out.select("id", F.get_json_object("answer", "$.results[0].score").cast("long").alias("score"), "attempts", "error")


@query("SELECT o AS id FROM (SELECT p_partkey AS o FROM part) WHERE (o - (SELECT min(p_partkey) FROM part)) % 2 = 0")
def greedy_chain(spark, sf_dir):
    """One chain of all rows, each of which shares a key with the next: every second one stays."""
    low = F.lit(table(spark, sf_dir, "part").agg(F.min("p_partkey")).first()[0] or 0)
    k = F.col("p_partkey") - low
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("a"), F.floor(k / 2).cast("string")).alias("a"), F.concat(F.lit("b"), F.floor((k + 1) / 2).cast("string")).alias("b"))
    return dedupe.first_wins(rows, ["a", "b"], "id").select("id")
