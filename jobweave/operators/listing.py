"""Reading postings: listings, search, facets, follow-ups, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.hashes import half_up, score_band
from jobweave.functions.text import either

#: Application statuses in the order of the pipeline; those that wait for an answer.
STATUSES = ["new", "interested", "drafted", "applied", "screening", "interviewing", "rejected", "archived"]
WAITING = ["applied", "screening", "interviewing"]


def summaries(postings: DataFrame, companies: DataFrame, scores: DataFrame, applications: DataFrame, resumes: DataFrame, active_resume: int | None) -> DataFrame:
    """postings with company, score and application structs (null where there is none); a score is stale if another resume is active now."""
    names = resumes.select(F.col("id").alias("_resume"), F.col("filename").alias("resume_filename"))
    stale = F.lit(False) if active_resume is None else F.coalesce(F.col("resume_id") != active_resume, F.lit(False))
    scored = scores.join(names, scores["resume_id"] == names["_resume"], "left").drop("_resume").withColumn("stale", stale)
    as_struct = lambda df, key, name: df.select(F.col(key).alias(f"_{name}"), F.struct(*df.columns).alias(name))
    out = postings
    for df, key, own, name in ((companies, "id", "company_id", "company"), (scored, "job_id", "id", "score"), (applications, "job_id", "id", "application")):
        side = as_struct(df, key, name)
        out = out.join(side, out[own] == side[f"_{name}"], "left").drop(f"_{name}")
    return out


def listed(rows: DataFrame, filter_status: str | None = "passed", status: str | None = None, least_score: int | None = None, unscored: bool = False, duplicates: bool = False) -> DataFrame:
    """The rows of a listing, before paging. rows: filter_status, duplicate_of, status and score (null without application or score)."""
    out = rows
    if filter_status is not None:
        out = out.where(F.col("filter_status") == filter_status)
    if not duplicates:
        out = out.where(F.col("duplicate_of").isNull())
    if status is not None:
        out = out.where(F.col("status") == status)
    if least_score is not None:
        out = out.where(F.col("score") >= least_score)
    return out.where(F.col("score").isNull()) if unscored else out


def order_of(listing: str) -> list[Column]:
    """The orders of plain listings: companies by name, blacklisted names by key, watched boards newest first; ties by id."""
    return {"companies": [F.asc("name")], "blacklist": [F.asc("key")], "watched": [F.desc("added_at")]}[listing] + [F.asc("id")]


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page: a bounded top-k in each partition, then of those."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def search_rank(term: str, columns: list[Column]) -> Column:
    """0 for a column equal to the term, 1 for one that begins with it, 2 for one that holds it, null for none; by small letters."""
    term = term.strip().lower()
    lower = [F.lower(F.coalesce(c, F.lit(""))) for c in columns]
    any_of = lambda test: F.greatest(*[test(c) for c in lower], F.lit(False))
    return F.when(any_of(lambda c: c == term), 0).when(any_of(lambda c: c.startswith(term)), 1).when(any_of(lambda c: c.contains(term)), 2)


def searched(rows: DataFrame, term: str, columns: list[str], order: list[Column], limit: int = 20) -> DataFrame:
    """Best matches first, then by order; a term under two letters finds nothing. The limit is kept within 1 and 50."""
    if len(term.strip()) < 2:
        return rows.withColumn("rank", F.lit(0)).limit(0)
    found = rows.withColumn("rank", search_rank(term, [F.col(c) for c in columns])).where("rank is not null")
    return found.orderBy("rank", *order).limit(min(50, max(1, limit)))


def facet_status(status: Column) -> Column:
    return F.coalesce(status, F.lit("none"))


def faceted(rows: DataFrame, statuses: list[str] | None = None, sources: list[str] | None = None, eases: list[str] | None = None, unscored: bool = False, least: int | None = None) -> DataFrame:
    """All facets hold together, any value within one; a missing score counts as -1."""
    out = rows
    for column, wanted in ((facet_status(F.col("status")), statuses), (F.col("source"), sources), (F.col("ease"), eases)):
        if wanted:
            out = out.where(column.isin(*wanted))
    if unscored:
        out = out.where(F.col("score").isNull())
    return out.where(F.coalesce(F.col("score"), F.lit(-1)) >= least) if least is not None else out


def sort_orders(tie: str = "id") -> dict[str, list[Column]]:
    """The five orders of the queue, with ties by id."""
    tie_ = F.col(tie).asc()
    epoch = F.timestamp_seconds(F.lit(0))
    return {
        "score_desc": [F.coalesce(F.col("score"), F.lit(-1)).desc(), tie_],
        "score_asc": [F.coalesce(F.col("score"), F.lit(999)).asc(), tie_],
        "posted_desc": [F.coalesce(F.col("posted_at").cast("timestamp"), epoch).desc(), tie_],
        "ingested_desc": [F.coalesce(F.col("ingested_at").cast("timestamp"), epoch).desc(), tie_],
        "title": [F.collate("title", "UNICODE").asc(), tie_],
    }


def facet_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n: the counts of each column's values, all in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(pairs).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def source_values(rows: DataFrame, selected: list[str]) -> DataFrame:
    """The sources of the data and those selected, sorted."""
    chosen = rows.sparkSession.createDataFrame([(s,) for s in selected], "source string")
    return rows.select("source").unionByName(chosen).distinct().orderBy("source")


def due(rows: DataFrame, now: Column) -> DataFrame:
    """Applications that wait for an answer and whose next follow-up has come; the most overdue first."""
    return rows.where(F.col("status").isin(*WAITING) & F.col("outcome").isNull() & (F.col("next_followup_at") <= now)).orderBy("next_followup_at", "id")


def due_in_client(next_at: Column, outcome: Column, now: Column) -> Column:
    """The same without looking at the status; an empty outcome is none."""
    return F.coalesce(next_at <= now, F.lit(False)) & (F.coalesce(outcome, F.lit("")) == "")


def is_untriaged(status: Column) -> Column:
    return F.coalesce(status, F.lit("new")) == "new"


def is_active(status: Column) -> Column:
    return ~status.eqNullSafe(F.lit("archived"))


def pending(postings: DataFrame, scores: DataFrame, active_resume: int | None = None, include_stale: bool = False) -> DataFrame:
    """Postings without a score, and with include_stale those whose score is of another resume; hidden and archived ones too."""
    own = scores.select(F.col("job_id").alias("_job"), F.col("resume_id").alias("_resume"))
    joined = postings.join(own, postings["id"] == own["_job"], "left")
    stale = F.coalesce(F.col("_resume") != active_resume, F.lit(False)) if include_stale and active_resume is not None else F.lit(False)
    return joined.where(F.col("_job").isNull() | stale).drop("_job", "_resume")


def pending_page(rows: DataFrame, order: list[Column], limit: int = 25) -> DataFrame:
    """The first of the pending, as many as one run takes."""
    return page(rows, order, limit)


def with_canonical(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with canonical: those columns of the posting that a duplicate points to, null for others."""
    target = rows.select(F.col("id").alias("_canonical"), F.struct("id", *columns).alias("canonical"))
    # Rows that point nowhere are most, and would all meet in the partition of null.
    pointing = rows.where(F.col("duplicate_of").isNotNull())
    found = pointing.join(target, pointing["duplicate_of"] == target["_canonical"], "left").drop("_canonical")
    return found.unionByName(rows.where(F.col("duplicate_of").isNull()).withColumn("canonical", F.lit(None).cast(found.schema["canonical"].dataType)))


def top_matches(rows: DataFrame, n: int = 6) -> DataFrame:
    """The best scored of what nobody has looked at."""
    return rows.where(F.col("score").isNotNull() & is_untriaged(F.col("status"))).orderBy(F.desc("score"), "id").limit(n)


def shell_counts(rows: DataFrame, order: list[Column], now: Column, newest: int = 500) -> DataFrame:
    """One row over the newest postings: active, unreviewed and strong of the active, and follow-ups that are due."""
    recent = rows.orderBy(*order).limit(newest).where(is_active(F.col("status")))
    due_ = due_in_client(F.col("next_followup_at"), F.col("outcome"), now)
    return recent.agg(F.count("*").alias("active"), F.count_if(is_untriaged(F.col("status"))).alias("unreviewed"), F.count_if(F.col("score") >= 80).alias("strong"), F.count_if(due_).alias("followups"))


def overdue_count(rows: DataFrame, days: Column, least: int = 14) -> DataFrame:
    """overdue: how many follow-ups have waited for so many days."""
    return rows.agg(F.count_if(days >= least).alias("overdue"))


def bar_scale(counts: DataFrame, n: str = "n") -> DataFrame:
    """most: the largest count of a histogram, 1 at least, for the scale of its bars."""
    return counts.agg(F.greatest(F.lit(1), F.coalesce(F.max(n), F.lit(1))).cast("long").alias("most"))


def matching_commands(commands: DataFrame, term: Column) -> DataFrame:
    """Commands (label, category) that hold the term in either, by small letters; all for an empty term."""
    return commands.where(F.contains(F.lower(F.concat_ws(" ", "label", "category")), F.lower(F.trim(term))))


def rubric_entries(scores: DataFrame, key: str, rubric: str = "rubric") -> DataFrame:
    """key, bucket, points, note: a row for each part of a score; no rows for a score without parts."""
    return scores.select(key, F.explode(F.map_entries(rubric)).alias("e")).select(key, F.col("e.key").alias("bucket"), F.col("e.value.points").alias("points"), F.col("e.value.note").alias("note"))


def stale_scores(scores: DataFrame, active_resume: int | None) -> DataFrame:
    """stale: how many scores are of another resume than the active one; 0 without one."""
    other = F.lit(False) if active_resume is None else F.coalesce(F.col("resume_id") != active_resume, F.lit(False))
    return scores.agg(F.count_if(other).alias("stale"))


def kpis(rows: DataFrame, order: list[Column], newest: int, now: Column) -> DataFrame:
    """One row of counts over the newest rows (filter_status, status, score, next_followup_at, outcome)."""
    recent = rows.where(F.col("filter_status") == "passed").orderBy(*order).limit(newest).where(is_active(F.col("status")))
    score, status = F.col("score"), F.col("status")
    return recent.agg(
        F.count("*").alias("jobs"),
        F.count("score").alias("scored"),
        F.count_if(score.isNull()).alias("pending"),
        F.count_if(score >= 80).alias("strong"),
        F.count_if(status == "applied").alias("applied"),
        F.count_if(status == "rejected").alias("rejected"),
        F.count_if(is_untriaged(status)).alias("unreviewed"),
        half_up(F.avg("score")).cast("long").alias("average"),
        F.count_if(due_in_client(F.col("next_followup_at"), F.col("outcome"), now)).alias("followups"),
    )


def histogram(rows: DataFrame, score: Column) -> DataFrame:
    """band, n: of the three bands, empty ones included; rows without a score are left out."""
    bands = rows.sparkSession.createDataFrame([("strong",), ("good",), ("weak",)], "band string")
    counted = rows.where(score.isNotNull()).groupBy(score_band(score).alias("band")).agg(F.count("*").alias("n"))
    return bands.join(counted, "band", "left").select("band", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def counted(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def coverage(boards: DataFrame, source: str, enabled: Column) -> DataFrame:
    """source, total, enabled of each source, and of all (a null source)."""
    return boards.rollup(source).agg(F.count("*").alias("total"), F.count_if(enabled).alias("enabled"))


def bucket_counts(rows: DataFrame, source: str) -> DataFrame:
    """source, bucket ("status:reason", ok for no reason), n."""
    bucket = F.concat_ws(":", "filter_status", F.coalesce("filter_reason", F.lit("ok")))
    return rows.groupBy(source, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def status_pivot(rows: DataFrame, source: str) -> DataFrame:
    return rows.groupBy(source).agg(*[F.count_if(F.col("filter_status") == s).alias(s) for s in ("passed", "manual", "dropped")]).orderBy(source)


def drop_totals(rows: DataFrame) -> DataFrame:
    """reason, n of dropped rows, the most frequent first."""
    return rows.where("filter_status = 'dropped'").groupBy(F.col("filter_reason").alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def samples(rows: DataFrame, by: list[str], order: str, columns: list[str], n: int = 5) -> DataFrame:
    """The first n rows of each bucket, in scan order."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("place", rank).where(F.col("place") <= n).select(*by, "place", *columns)


def report(pivot: DataFrame, drops: DataFrame) -> DataFrame:
    """line: the diagnostic as text, a line for each source and each reason."""
    sources = pivot.select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("o"), F.format_string("%s: passed %d, manual %d, dropped %d", pivot.columns[0], "passed", "manual", "dropped").alias("line"))
    reasons = drops.select(F.lit(1).alias("part"), (-F.col("n")).alias("o"), F.format_string("%6d  %s", "n", "reason").alias("line"))
    return sources.unionByName(reasons).orderBy("part", "o", "line").select("line")


def display_name(label: Column, slug: Column) -> Column:
    return either(label, F.substring_index(slug, "|", 1))
