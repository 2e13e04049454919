"""Listings, search, facets, follow-ups and counts over jobs made of orders."""

from pyspark.sql import functions as F

from jobweave.functions.dates import days_overdue, overdue_label, relative_label
from jobweave.operators import listing
from jobweave.plans.binding import JOBS, NOW, jobs, table
from jobweave.plans.registry import query

TODAY = NOW[:10]


@query(f"SELECT id, source, score, status FROM ({JOBS}) WHERE filter_status = 'passed' AND duplicate_of IS NULL AND score >= 40 ORDER BY ingested_at DESC, id LIMIT 100 OFFSET 50")
def queue_page(spark, sf_dir):
    rows = listing.listed(jobs(spark, sf_dir), least_score=40)
    return listing.page(rows, [F.desc("ingested_at"), F.asc("id")], 100, 50).select("id", "source", "score", "status")


@query(
    f"""SELECT j.id, c_name AS company, CASE WHEN score IS NULL THEN NULL ELSE id % 4 END AS resume, coalesce(CASE WHEN score IS NOT NULL THEN id % 4 END <> 2, false) AS stale
    FROM ({JOBS}) j LEFT JOIN customer ON company_id = c_custkey"""
)
def job_summaries(spark, sf_dir):
    rows = jobs(spark, sf_dir)
    companies = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    scores = rows.where("score is not null").select(F.col("id").alias("job_id"), "score", F.pmod("id", F.lit(4)).alias("resume_id"))
    applications = rows.where("status is not null").select(F.col("id").alias("job_id"), F.col("status").alias("app_status"))
    resumes = spark.createDataFrame([(k, f"cv{k}.pdf") for k in range(4)], "id long, filename string")
    out = listing.summaries(rows.select("id", "company_id"), companies, scores, applications, resumes, 2)
    return out.select("id", F.col("company.name").alias("company"), F.col("score.resume_id").alias("resume"), F.coalesce("score.stale", F.lit(False)).alias("stale"))


RANK = "CASE WHEN lower(p_name) = 'bolt' OR lower(p_brand) = 'bolt' THEN 0 WHEN lower(p_name) LIKE 'bolt%' OR lower(p_brand) LIKE 'bolt%' THEN 1 WHEN lower(p_name) LIKE '%bolt%' OR lower(p_brand) LIKE '%bolt%' THEN 2 END"


@query(f"SELECT p_partkey, p_name, p_brand, r::INTEGER AS rank FROM (SELECT *, {RANK} AS r FROM part) WHERE r IS NOT NULL ORDER BY r, p_retailprice DESC, p_partkey LIMIT 50")
def like_search_ranked(spark, sf_dir):
    return listing.searched(table(spark, sf_dir, "part"), " Bolt", ["p_name", "p_brand"], [F.desc("p_retailprice"), F.asc("p_partkey")], 500).select("p_partkey", "p_name", "p_brand", "rank")


SORTS = {"score_desc": "coalesce(score, -1) DESC", "score_asc": "coalesce(score, 999)", "ingested_desc": "ingested_at DESC", "title": "title"}


@query(" UNION ALL ".join(f"(SELECT '{k}' AS sort, id, row_number() OVER (ORDER BY {v}, id) AS place FROM ({JOBS}) WHERE coalesce(status, 'none') IN ('none', 'applied') AND ease = 'easy' ORDER BY {v}, id LIMIT 20)" for k, v in SORTS.items()))
def facet_filter_sort(spark, sf_dir):
    from pyspark.sql import Window

    rows = listing.faceted(jobs(spark, sf_dir), statuses=["none", "applied"], eases=["easy"])
    out = None
    for name, order in listing.sort_orders().items():
        if name in SORTS:
            best = rows.orderBy(*order).limit(20).select(F.lit(name).alias("sort"), "id", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))
            out = best if out is None else out.unionByName(best)
    return out


@query(
    f"""SELECT 'status' AS facet, coalesce(status, 'none') AS value, count(*) AS n FROM ({JOBS}) GROUP BY ALL UNION ALL SELECT 'ease', ease, count(*) FROM ({JOBS}) GROUP BY ALL
    UNION ALL SELECT 'source', source, count(*) FROM ({JOBS}) GROUP BY ALL UNION ALL SELECT 'unscored', (score IS NULL)::VARCHAR, count(*) FROM ({JOBS}) GROUP BY ALL"""
)
def facet_counts(spark, sf_dir):
    rows = jobs(spark, sf_dir).withColumns({"status": listing.facet_status(F.col("status")), "unscored": F.col("score").isNull()})
    return listing.facet_counts(rows, ["status", "ease", "source", "unscored"])


@query("SELECT DISTINCT source FROM (SELECT source FROM documents WHERE source IS NOT NULL UNION ALL SELECT 'picked')")
def source_facet_union(spark, sf_dir):
    return listing.source_values(table(spark, sf_dir, "documents").where("source is not null"), ["picked"])


@query(
    f"""SELECT count(*) AS jobs, count(score) AS scored, count(*) FILTER (score IS NULL) AS pending, count(*) FILTER (score >= 80) AS strong, count(*) FILTER (status = 'applied') AS applied,
    count(*) FILTER (status = 'rejected') AS rejected, count(*) FILTER (coalesce(status, 'new') = 'new') AS unreviewed, floor(avg(score) + 0.5)::BIGINT AS average,
    count(*) FILTER (coalesce(next_followup_at <= DATE '{TODAY}', false) AND coalesce(outcome, '') = '') AS followups
    FROM (SELECT * FROM ({JOBS}) WHERE filter_status = 'passed' ORDER BY ingested_at DESC, id LIMIT 500) WHERE status IS DISTINCT FROM 'archived'"""
)
def kpi_dashboard(spark, sf_dir):
    return listing.kpis(jobs(spark, sf_dir), [F.desc("ingested_at"), F.asc("id")], 500, F.lit(TODAY).cast("date"))


@query(
    f"""SELECT band, count(score) AS n FROM (VALUES ('strong'), ('good'), ('weak')) b(band)
    LEFT JOIN (SELECT score, CASE WHEN score >= 80 THEN 'strong' WHEN score >= 65 THEN 'good' ELSE 'weak' END AS own FROM ({JOBS}) WHERE score IS NOT NULL) ON own = band GROUP BY band"""
)
def score_histogram(spark, sf_dir):
    return listing.histogram(jobs(spark, sf_dir), F.col("score"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def counts_by_source(spark, sf_dir):
    return listing.counted(table(spark, sf_dir, "documents"), "source")


@query("SELECT s_nationkey, count(*) AS total, count(*) FILTER (s_acctbal > 0) AS enabled FROM supplier GROUP BY ROLLUP (s_nationkey)")
def coverage(spark, sf_dir):
    return listing.coverage(table(spark, sf_dir, "supplier"), "s_nationkey", F.col("s_acctbal") > 0)


@query("SELECT source, lang, place, doc_id FROM (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS place FROM documents) WHERE place <= 5")
def diagnostic_samples(spark, sf_dir):
    return listing.samples(table(spark, sf_dir, "documents"), ["source", "lang"], "doc_id", ["doc_id"])


@query(
    f"""SELECT id, d AS days, CASE WHEN d <= 0 THEN 'due today' ELSE d || 'd overdue' END AS label
    FROM (SELECT id, greatest(0, DATE '{TODAY}' - next_followup_at)::BIGINT AS d FROM ({JOBS}) WHERE status IN ('applied', 'screening', 'interviewing') AND outcome IS NULL AND next_followup_at <= DATE '{TODAY}')"""
)
def followups_due(spark, sf_dir):
    now = F.lit(TODAY).cast("date")
    days = days_overdue(F.col("next_followup_at"), now)
    return listing.due(jobs(spark, sf_dir), now).select("id", days.alias("days"), overdue_label(days).alias("label"))


@query(
    f"""SELECT id, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN '1 day ago' WHEN d < 30 THEN d || ' days ago' WHEN d // 30 = 1 THEN '1 month ago' ELSE (d // 30) || ' months ago' END AS label
    FROM (SELECT id, greatest(0, DATE '{TODAY}' - ingested_at) AS d FROM ({JOBS}))"""
)
def relative_labels(spark, sf_dir):
    return jobs(spark, sf_dir).select("id", relative_label(days_overdue(F.col("ingested_at"), F.lit(TODAY).cast("date"))).alias("label"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL OR coalesce(l.quality <> 1, false)")
def pending_selection(spark, sf_dir):
    posted = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    scores = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_id"), F.col("quality").alias("resume_id"))
    return listing.pending(posted, scores, 1, True).select(F.col("id").alias("doc_id"))


@query("SELECT count(*) FILTER (coalesce(quality <> 1, false)) AS stale FROM labels")
def stale_count(spark, sf_dir):
    return listing.stale_scores(table(spark, sf_dir, "labels").select(F.col("quality").alias("resume_id")), 1)


@query(f"SELECT id, CASE WHEN id % 10 = 0 THEN 100 ELSE greatest(0, least(100, floor(score / (id % 10 * 10.0)::DOUBLE * 100 + 0.5)))::BIGINT END AS percent FROM ({JOBS}) WHERE score IS NOT NULL")
def progress_percent(spark, sf_dir):
    from jobweave.functions.hashes import percent

    weight = F.pmod("id", F.lit(10)) * 10
    return jobs(spark, sf_dir).where("score is not null").select("id", F.when(weight == 0, F.lit(100).cast("long")).otherwise(percent(F.col("score"), weight)).alias("percent"))
