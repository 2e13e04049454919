"""Profiles, watched boards, patches, pages of listings, and the refresh and draft plans."""

import json

from pyspark.sql import functions as F

from jobweave.functions import dates, hashes, payloads, text
from jobweave.operators import boards, dedupe, listing, profile, rules, state
from jobweave.operators.lineage import cut_lineage, shared_folder
from jobweave.plans import drafting, ingest, refresh
from jobweave.plans.binding import JOBS, NOW, POSTINGS, jobs, one_of, postings, sql_one_of, table
from jobweave.plans.registry import query
from jobweave.sources import normalise, readers, sinks

TODAY = NOW[:10]


def day(value):
    return F.lit(value).cast("date")


def mod(column, n):
    return F.pmod(F.col(column), F.lit(n))


@query(f"SELECT a.id, b.title AS canonical_title FROM ({JOBS}) a LEFT JOIN ({JOBS}) b ON a.duplicate_of = b.id")
def canonical_lookup(spark, sf_dir):
    return listing.with_canonical(jobs(spark, sf_dir), ["title"]).select("id", F.col("canonical.title").alias("canonical_title"))


@query(f"SELECT id, score FROM ({JOBS}) WHERE score IS NOT NULL AND coalesce(status, 'new') = 'new' ORDER BY score DESC, id LIMIT 6")
def top_matches(spark, sf_dir):
    return listing.top_matches(jobs(spark, sf_dir)).select("id", "score")


@query(
    f"""SELECT count(*) AS active, count(*) FILTER (coalesce(status, 'new') = 'new') AS unreviewed, count(*) FILTER (score >= 80) AS strong, count(*) FILTER (next_followup_at <= DATE '1998-01-01' AND coalesce(outcome, '') = '') AS followups
    FROM (SELECT * FROM ({JOBS}) ORDER BY ingested_at DESC, id DESC LIMIT 500) WHERE status IS DISTINCT FROM 'archived'"""
)
def shell_counts(spark, sf_dir):
    return listing.shell_counts(jobs(spark, sf_dir), [F.desc("ingested_at"), F.desc("id")], day("1998-01-01"))


@query(f"SELECT count(*) AS overdue FROM ({JOBS}) WHERE status IN ('applied', 'screening', 'interviewing') AND outcome IS NULL AND next_followup_at <= DATE '1998-01-01' AND DATE '1998-01-01' - next_followup_at >= 14")
def overdue_count(spark, sf_dir):
    due = listing.due(jobs(spark, sf_dir), day("1998-01-01"))
    return listing.overdue_count(due, dates.days_overdue(F.col("next_followup_at"), day("1998-01-01")))


@query(f"SELECT greatest(1, max(n)) AS most FROM (SELECT count(*) AS n FROM ({JOBS}) WHERE score IS NOT NULL GROUP BY CASE WHEN score >= 80 THEN 2 WHEN score >= 65 THEN 1 ELSE 0 END)")
def histogram_scale(spark, sf_dir):
    return listing.bar_scale(listing.histogram(jobs(spark, sf_dir), F.col("score")))


STORED_TEXT = "SELECT doc_id AS id, coalesce(text, '') AS description, coalesce(source, '') AS raw, DATE '2000-01-01' + (doc_id % 170)::INTEGER AS ingested_at FROM documents"
PRUNE = f"""SELECT d.*, coalesce(s.status IN ('archived', 'rejected'), false) OR (ingested_at < DATE '{TODAY}' - 14 AND s.status IS DISTINCT FROM 'applied') AS prune
  FROM ({STORED_TEXT}) d LEFT JOIN (SELECT id, status FROM ({JOBS}) WHERE status IS NOT NULL) s USING (id)"""


def stored_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("description"), F.coalesce("source", F.lit("")).alias("raw"), F.date_add(day("2000-01-01"), mod("doc_id", 170).cast("int")).alias("ingested_at")
    )


@query(f"SELECT count(*) AS scanned, count(*) FILTER (prune AND length(description) + length(raw) > 0) AS lightened, coalesce(sum(length(description) + length(raw)) FILTER (prune), 0)::BIGINT AS bytes_freed FROM ({PRUNE})")
def prune_stats(spark, sf_dir):
    return state.prune_stats(pruned(spark, sf_dir))


@query(f"SELECT id, CASE WHEN prune THEN 0 ELSE length(description) END::BIGINT AS left_chars, prune AND length(description) + length(raw) > 0 AS printed FROM ({PRUNE})")
def prune_apply(spark, sf_dir):
    return pruned(spark, sf_dir).select("id", F.length("description").cast("long").alias("left_chars"), F.col("jd_fingerprint").isNotNull().alias("printed"))


def pruned(spark, sf_dir):
    apps = jobs(spark, sf_dir).where("status is not null").select(F.col("id").alias("job_id"), "status")
    rows = state.with_statuses(stored_texts(spark, sf_dir), apps).withColumn("jd_fingerprint", F.lit(None).cast("string"))
    prune = state.prunable(F.col("status"), F.lit(None).cast("date"), F.col("ingested_at"), day(TODAY))
    return state.pruned(rows, prune, F.md5("description"))


@query("SELECT count(*) FILTER (length(lower(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g'))) >= 200 AND len(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g')), '[a-z0-9]+')) >= 3) AS fingerprinted FROM documents")
def backfill_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text").alias("description"), F.date_add(day("2000-01-01"), mod("doc_id", 60).cast("int")).alias("ingested_at"), F.lit(None).cast("string").alias("jd_fingerprint"), F.lit(None).cast("long").alias("duplicate_of")
    )
    return state.backfill_stats(rows, cut_lineage(ingest.fingerprint_backfill(rows))).select("fingerprinted")


@query("SELECT DISTINCT lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS key FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 9 <> 0")
def blacklist_changes(spark, sf_dir):
    """Names are added (some twice), then some are taken off again."""
    names = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    key = text.normal_company(F.col("name"))
    third = names.where(mod("c_custkey", 3) == 0).select("name")
    empty = spark.createDataFrame([("q",)], "name string").select("name", F.lit("").alias("key")).limit(0)
    added = state.listed_names(state.listed_names(empty, third, key), third.unionByName(spark.createDataFrame([("?",)], "name string")), key)
    return state.unlisted(added, names.where(mod("c_custkey", 9) == 0), key).select("key")


@query("SELECT s_name AS name, s_suppkey % 4 = 0 AS refused FROM supplier")
def blacklist_guard(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    black = names.where(mod("s_suppkey", 4) == 0).select(text.normal_company(F.col("name")).alias("key"))
    return state.guarded(names.select("name"), black, boards.company_keys(F.col("name")))


BOARD = "source string, slug string, added_by string, label string, added_at date, enabled boolean"


@query(
    f"""SELECT 'lever' AS source, s_name AS slug, CASE WHEN s_suppkey % 2 = 0 THEN 'seed' ELSE 'user' END AS added_by, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 3 = 0 ELSE true END AS enabled
    FROM supplier WHERE (s_suppkey % 2 = 0 OR s_suppkey % 3 = 0) AND NOT (s_suppkey % 2 = 1 AND s_suppkey % 5 = 0)"""
)
def watch_changes(spark, sf_dir):
    """Half are seeds that are disabled; every third board is watched, every fifth unwatched again: seeds stay."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.lit("lever").alias("source"), F.col("s_name").alias("slug"))
    stored = rows.where(mod("s_suppkey", 2) == 0).select("source", "slug", F.lit("seed").alias("added_by"), F.lit(None).cast("string").alias("label"), day("2000-01-01").alias("added_at"), F.lit(False).alias("enabled"))
    added = rows.where(mod("s_suppkey", 3) == 0).select("source", "slug", F.col("slug").alias("label"))
    after = state.watched(stored, added.unionByName(added), day(TODAY))
    return state.unwatched(after, rows.where(mod("s_suppkey", 5) == 0)).select("source", "slug", "added_by", "enabled")


@query("SELECT rank, c_name FROM (SELECT row_number() OVER (ORDER BY c_name, c_custkey) AS rank, c_name FROM customer) WHERE rank <= 25")
def company_listing(spark, sf_dir):
    from pyspark.sql import Window

    first = listing.page(table(spark, sf_dir, "customer"), [F.asc("c_name"), F.asc("c_custkey")], 25)
    return first.select(F.row_number().over(Window.orderBy("c_name", "c_custkey")).cast("long").alias("rank"), "c_name")


@query(f"SELECT id FROM ({JOBS}) WHERE score IS NULL ORDER BY ingested_at DESC, id LIMIT 25")
def pending_page(spark, sf_dir):
    rows = jobs(spark, sf_dir)
    scores = rows.where("score is not null").select(F.col("id").alias("job_id"), F.lit(1).alias("resume_id"))
    return listing.pending_page(listing.pending(rows, scores), [F.desc("ingested_at"), F.asc("id")]).select("id")


@query("SELECT p_partkey FROM part WHERE lower(p_name || ' ' || p_brand) LIKE '%brand#1%' OR lower(p_name || ' ' || p_brand) LIKE '%brand1%'")
def command_match(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("label"), F.col("p_brand").alias("category"))
    return listing.matching_commands(rows, F.lit(" BRAND#1 ")).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, b.bucket, CASE b.bucket WHEN 'skills_overlap' THEN l_quantity::INTEGER ELSE l_linenumber::INTEGER END AS points, 'n' || l_linenumber AS note FROM lineitem, (VALUES ('skills_overlap'), ('role_fit')) b(bucket) WHERE l_linenumber <> 3")
def rubric_entries(spark, sf_dir):
    part = lambda c: F.struct(F.col(c).cast("int").alias("points"), F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("note"))
    made = F.create_map(F.lit("skills_overlap"), part("l_quantity"), F.lit("role_fit"), part("l_linenumber"))
    stored = F.from_json(F.to_json(F.when(F.col("l_linenumber") != 3, made)), "map<string,struct<points:int,note:string>>")
    rows = table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("k"), stored.alias("rubric"))
    return listing.rubric_entries(rows, "k").select("k.l_orderkey", "k.l_linenumber", "bucket", "points", "note")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS required, c_custkey % 3 <> 0 OR c_custkey % 2 = 0 AS using_defaults FROM customer")
def profile_dto(spark, sf_dir):
    tech = F.when(mod("c_custkey", 3) == 0, '["go", "c++"]').when(mod("c_custkey", 3) == 1, "no json")
    rows = table(spark, sf_dir, "customer").select("c_custkey", tech.alias("required_tech"), F.when(mod("c_custkey", 2) == 0, "[]").otherwise('["senior"]').alias("seniority_terms"))
    return profile.shown(profile.from_json_lists(rows)).select("c_custkey", F.size("required_tech").cast("long").alias("required"), "using_defaults")


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS required_tech FROM customer")
def profile_changes(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.array(F.lit("old")).alias("required_tech"))
    after = profile.put(rows, rows.where(mod("key", 2) == 0).withColumn("required_tech", F.array(F.lit("new"))))
    return profile.cleared(after, mod("key", 4) == 0).select("key", F.array_join("required_tech", ",").alias("required_tech"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'own' WHEN c_custkey % 3 = 0 THEN 'provider' ELSE 'general' END AS model FROM customer")
def model_choice(spark, sf_dir):
    own, default = F.when(mod("c_custkey", 2) == 0, " own ").otherwise(" "), F.when(mod("c_custkey", 3) == 0, "provider")
    return table(spark, sf_dir, "customer").select("c_custkey", profile.model_choice(own, default, F.lit("general")).alias("model"))


@query("SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment || ' worker' END AS headline, upper(substr(c_name, 1, 1)) || CASE WHEN c_name LIKE '% %' THEN upper(substr(split_part(c_name, ' ', 2), 1, 1)) ELSE '' END AS initials FROM customer")
def shell_profiles(spark, sf_dir):
    resume = F.concat(F.lit("=====\n  RESUME\n\n"), "c_name", F.lit("\n"), F.when(mod("c_custkey", 3) == 0, "Experience:\n").otherwise(""), "c_mktsegment", F.lit(" worker\nSkills\nmore"))
    return table(spark, sf_dir, "customer").select("c_custkey", profile.shell_profile(resume).alias("p")).select("c_custkey", "p.*")


@query(f"SELECT id, CASE WHEN id % 2 = 0 THEN 'note' ELSE outcome END AS outcome, CASE WHEN id % 2 = 0 THEN DATE '{TODAY}' END AS updated_at FROM ({JOBS}) WHERE status IS NOT NULL")
def notes_patch(spark, sf_dir):
    """Patches of jobs without an application do nothing."""
    rows = jobs(spark, sf_dir)
    apps = rows.where("status is not null").select(F.col("id").alias("job_id"), "outcome", F.lit(None).cast("date").alias("updated_at"))
    changes = rows.where(mod("id", 2) == 0).select(F.col("id").alias("job_id"), F.lit("note").alias("outcome"))
    return state.patched(apps, changes, day(TODAY)).withColumnRenamed("job_id", "id")


@query("SELECT user_id AS job_id, arg_max(floor(value)::BIGINT, (ts, event_id)) AS score, arg_max(CASE WHEN event_type = 'view' THEN 7 ELSE -1 END, (ts, event_id))::BIGINT AS resume_id FROM events GROUP BY user_id")
def score_log(spark, sf_dir):
    """Scores appended to a log: baseline ones carry the active resume; the view of the last of each job."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.floor("value").cast("long").alias("score"), F.when(F.col("event_type") == "view", "baseline").otherwise("tailored").alias("kind"), F.struct("ts", "event_id").alias("at"))
    empty = rows.limit(0).withColumn("resume_id", F.lit(None).cast("long"))
    return state.latest(state.with_score(empty, rows, 7), ["job_id"], ["at"]).select("job_id", "score", F.coalesce("resume_id", F.lit(-1).cast("long")).alias("resume_id"))


@query(f"SELECT id, status, CASE WHEN id % 3 = 0 THEN true ELSE false END AS used FROM (SELECT id, coalesce(status, 'new') AS status FROM ({JOBS}) WHERE status IS NOT NULL OR id % 3 = 0)")
def unemployment_marks(spark, sf_dir):
    rows = jobs(spark, sf_dir)
    apps = rows.where("status is not null").select(F.col("id").alias("job_id"), "status", F.lit(None).cast("boolean").alias("used_for_unemployment"), F.lit(None).cast("timestamp").alias("used_for_unemployment_at"))
    ids = rows.where(mod("id", 3) == 0).select(F.col("id").alias("job_id"))
    out = state.unemployment_marked(apps, ids, True, F.lit(NOW).cast("timestamp"))
    return out.select(F.col("job_id").alias("id"), "status", F.col("used_for_unemployment").alias("used"))


@query("SELECT s_suppkey AS id, s_suppkey = 3 OR s_suppkey = 5 AS is_blocked, s_suppkey = 7 AS is_active, coalesce(CASE WHEN s_suppkey % 2 = 0 THEN 'x' END, 'default') AS note FROM supplier")
def rows_migrated(spark, sf_dir):
    """Companies blocked one by one, a resume made the active one, and columns that older rows lack."""
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") == 5).alias("is_blocked"), F.when(mod("s_suppkey", 2) == 0, "x").alias("note"))
    out = state.resume_activated(state.blocked(rows, 3), 7)
    return state.migrated(out, {"note": F.lit("default"), "is_blocked": F.lit(False)}).select("id", "is_blocked", "is_active", "note")


@query("SELECT n_name AS key, CASE WHEN n_name = 'NATION_6' THEN 'set' ELSE n_regionkey::VARCHAR END AS value FROM nation UNION ALL SELECT 'theme', 'dark'")
def settings_kv(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    return state.setting(state.setting(state.setting(rows, "NATION_6", "set"), "theme", "light"), "theme", "dark")


@query(
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_millis, strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_seconds, strftime(ts + INTERVAL 7 DAY, '%Y-%m-%d') AS follow_up, coalesce(strftime(CASE WHEN event_id % 2 = 0 THEN ts END, '%Y-%m-%d'), '—') AS shown,
    ts < TIMESTAMP '2024-02-15' - INTERVAL 30 DAY AS stale, coalesce(date_diff('day', (CASE WHEN event_id % 2 = 0 THEN ts END)::DATE, DATE '2024-02-15') >= 30, true) AS recheck FROM events"""
)
def date_forms(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    show = lambda c, f="yyyy-MM-dd HH:mm:ss": F.date_format(c, f)
    at, now = F.when(mod("event_id", 2) == 0, ts), F.lit("2024-02-15 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id",
        show(dates.millis_time((F.unix_timestamp(ts) * 1000).cast("string"))).alias("from_millis"),
        show(dates.epoch_or_iso(F.unix_timestamp(ts))).alias("from_seconds"),
        show(dates.followup_default(ts), "yyyy-MM-dd").alias("follow_up"),
        dates.day_or_dash(at).alias("shown"),
        dates.is_stale(ts, now).alias("stale"),
        dates.needs_check(at, now).alias("recheck"),
    )


@query("SELECT p_partkey, (p_size * 3)::BIGINT AS whole, CASE WHEN p_size > 25 THEN 100 ELSE floor(p_size / 25.0 * 100 + 0.5) END::BIGINT AS percent, p_partkey % 2 = 0 AS limited, CASE WHEN p_partkey % 2 = 0 THEN '5pm' END AS resets_at FROM part")
def counts_and_limits(spark, sf_dir):
    told = F.when(mod("p_partkey", 2) == 0, "Usage limit reached; resets at 5pm.").otherwise("fine")
    typed = F.concat(F.lit(" "), (F.col("p_size") * 3).cast("string"), F.lit(" "))
    limit = text.usage_limit(told)
    return table(spark, sf_dir, "part").select(
        "p_partkey", payloads.whole_numbers(typed).alias("whole"), F.least(F.lit(100), hashes.progress(F.col("p_size"), F.lit(25))).cast("long").alias("percent"), limit["limited"].alias("limited"), limit["resets_at"].alias("resets_at")
    )


@query("SELECT page_id, 'Job ' || page_id AS title, 'Org ' || (page_id % 7) AS company FROM pages WHERE page_id % 3 <> 0")
def ld_pages(spark, sf_dir):
    """A JobPosting block in each page, alone, in a list or in a graph; every third page has another type only."""
    own = F.to_json(F.struct(F.when(mod("page_id", 3) == 0, "Article").otherwise("JobPosting").alias("@type"), F.concat(F.lit("Job "), F.col("page_id").cast("string")).alias("title"), F.concat(F.lit("Org "), mod("page_id", 7).cast("string")).alias("org")))
    wrapped = F.when(mod("page_id", 2) == 0, F.concat(F.lit('[{"@type": "Thing"}, '), own, F.lit("]"))).when(mod("page_id", 5) == 0, F.concat(F.lit('{"@graph": ['), own, F.lit("]}"))).otherwise(own)
    page = F.concat(F.coalesce("html", F.lit("")), F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">'), wrapped, F.lit("</script>"))
    ld = payloads.job_posting_ld(page)
    return table(spark, sf_dir, "pages").select("page_id", ld.alias("ld")).where("ld is not null").select("page_id", F.get_json_object("ld", "$.title").alias("title"), F.get_json_object("ld", "$.org").alias("company"))


@query("SELECT s_suppkey, s_suppkey % 3 <> 1 AS ok, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS slug_key, 'Org' || s_suppkey AS company, 'https://x.org/' || s_suppkey AS first_url FROM supplier")
def slug_checks(spark, sf_dir):
    third, host = mod("s_suppkey", 3), F.concat(F.lit("jobs.org"), F.col("s_suppkey").cast("string"), F.lit(".com"))
    slug = F.when(third == 0, "t|wd1|Site").when(third == 1, "t||Site").otherwise(F.concat(F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", "")), F.lit("|wd5|Careers")))
    comment = F.concat(F.lit("see https://x.org/"), F.col("s_suppkey").cast("string"), F.lit(" or http://y.org"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", boards.is_valid_slug(F.lit("workday"), slug).alias("ok"), boards.slug_key(F.concat("s_name", F.lit("|x"))).alias("slug_key"), boards.company_from_host(host).alias("company"), boards.first_url(comment).alias("first_url"))


@query("SELECT s_name AS name, s_suppkey AS id, 'lever' AS source FROM supplier WHERE s_suppkey % 2 = 0")
def name_to_board(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    stored = rows.where(mod("s_suppkey", 2) == 0).select(F.col("s_suppkey").alias("id"), F.lit("lever").alias("source"), F.regexp_replace("s_name", "[^A-Za-z0-9]+", "-").alias("slug"))
    return boards.by_name(rows.select(F.col("s_name").alias("name")), stored).select("name", "id", "source")


@query("SELECT s_name AS name, 'lever' AS source, lower(array_to_string(regexp_extract_all(s_name, '[A-Za-z0-9]+'), '-')) AS slug, s_suppkey AS job_count FROM supplier WHERE s_suppkey % 2 = 0")
def probe_boards(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    hyphen = F.array_join(F.regexp_extract_all(F.lower("s_name"), F.lit("([a-z0-9]+)"), F.lit(1)), "-")
    verified = rows.select(F.lit("lever").alias("source"), hyphen.alias("slug"), (mod("s_suppkey", 2) == 0).alias("ok"), F.col("s_suppkey").alias("job_count"))
    return boards.probes(rows.select(F.col("s_name").alias("name")), verified)


@query("SELECT 'lever' AS source, 's' || r_regionkey AS slug FROM region UNION ALL SELECT 'oracle', 'h|s|a' FROM region WHERE r_regionkey = 0")
def seed_boards(spark, sf_dir):
    """Sources that have boards get no seeds, and packed slugs must be whole."""
    k = F.col("r_regionkey").cast("string")
    rows = table(spark, sf_dir, "region")
    seeds = rows.select(F.lit("lever").alias("source"), F.concat(F.lit("s"), k).alias("slug")).unionByName(rows.select(F.lit("ashby").alias("source"), k.alias("slug")))
    seeds = seeds.unionByName(rows.select(F.lit("oracle").alias("source"), F.when(F.col("r_regionkey") == 0, "h|s|a").otherwise("h| |a").alias("slug")))
    return boards.seeded(spark.createDataFrame([("ashby", "x")], "source string, slug string"), seeds)


REFRESH = """
WITH feed AS (SELECT DISTINCT lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS slug, s_suppkey AS k FROM supplier),
fresh AS (SELECT * FROM feed WHERE k % 2 = 1), old AS (SELECT * FROM feed WHERE k % 2 = 0 AND k % 8 <> 0)
"""


@query(
    f"""{REFRESH} SELECT 'lever' AS source, (SELECT count(*) FROM fresh) AS candidates, (SELECT count(*) FROM fresh WHERE k % 3 = 0) AS added, (SELECT count(*) FROM old) AS reverified, (SELECT count(*) FROM old WHERE k % 3 <> 0) AS disabled"""
)
def refresh_stats(spark, sf_dir):
    return refreshed(spark, sf_dir).stats


@query(f"{REFRESH} SELECT slug, CASE WHEN k % 2 = 1 THEN 'refresh' ELSE 'seed' END AS added_by, k % 8 <> 0 AND k % 3 = 0 AS enabled FROM feed WHERE k % 2 = 0 OR k % 3 = 0")
def refresh_boards(spark, sf_dir):
    return refreshed(spark, sf_dir).boards.select("slug", "added_by", "enabled")


def refreshed(spark, sf_dir):
    """Half of the feed's boards are stored (every eighth disabled); verification finds every third."""
    slug = F.lower(F.regexp_replace("s_name", "[^A-Za-z0-9]", ""))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), slug.alias("slug"), F.lit("lever").alias("source"))
    nothing = {"last_job_count": F.lit(None).cast("long"), "last_error": F.lit(None).cast("string"), "last_fetched_at": F.lit(None).cast("date")}
    stored = rows.where("k % 2 = 0").withColumns({"added_by": F.lit("seed"), **nothing, "enabled": F.col("k") % 8 != 0}).drop("k")
    feed = rows.select(F.col("k").alias("place"), F.concat(F.lit("https://jobs.lever.co/"), "slug", F.lit("/1")).alias("url"))

    def verify(asked):
        ok = F.col("k") % 3 == 0
        return asked.join(rows, ["source", "slug"]).select("source", "slug", ok.alias("ok"), F.when(ok, F.col("k")).alias("job_count"), F.when(~ok, "gone").alias("error"))

    return refresh.refreshed(feed, stored, verify, day(TODAY))


@query(
    f"""SELECT id, CASE WHEN id % 5 = 0 THEN 'new' WHEN id % 4 = 0 THEN 'applied' ELSE 'drafted' END AS status FROM ({POSTINGS}) WHERE id % 4 = 0 OR id % 5 <> 0"""
)
def draft_statuses(spark, sf_dir):
    """Every fifth cover letter fails; every fourth job has an application, applied if its number is no multiple of five."""
    out, _ = drafted(spark, sf_dir)
    return out.applications.withColumnRenamed("job_id", "id")


@query(f"SELECT id AS job_id, 'resume' AS kind, 'Dear Acme - see Home (http://a.b) of ' || title AS markdown FROM ({POSTINGS}) UNION ALL SELECT id, 'cover_letter', 'Dear Acme - see Home (http://a.b) of ' || title FROM ({POSTINGS}) WHERE id % 5 <> 0")
def draft_texts(spark, sf_dir):
    out, _ = drafted(spark, sf_dir)
    return out.drafts


def drafted(spark, sf_dir):
    rows = postings(spark, sf_dir).select("id", "title", "company_name", "description")

    def writer(kind, prompt):
        number, title = prompt.split("\n")[0].split("|")
        if kind == "cover_letter" and int(number) % 5 == 0:
            raise RuntimeError("refused")
        return f"Dear Acme — see [Home](http://a.b) of {title}"

    apps = rows.where("id % 4 = 0").select(F.col("id").alias("job_id"), F.when(F.col("id") % 5 == 0, "new").otherwise("applied").alias("status"))
    asked = rows.withColumn("title", F.concat_ws("|", F.col("id").cast("string"), "title"))
    return drafting.generated(asked, apps, "{{title}}\n{{company_name}}: {{description}}", writer, "n0nce"), rows


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids, sum(floor(value))::BIGINT AS total FROM events")
def stream_ingest(spark, sf_dir):
    """Events land twice; each is stored once."""
    import uuid

    from jobweave.plans.queries_streams import events
    from jobweave.sources import sinks
    from jobweave.streaming import streams

    root = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    for k in range(2):
        streams.ingest(events(spark, sf_dir), lambda batch, _: batch.select("event_id", "value").dropDuplicates(["event_id"]), f"{root}/table", "event_id", f"{root}/state-{k}").awaitTermination()
    return sinks.current(spark, f"{root}/table").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"), F.sum(F.floor("value")).cast("long").alias("total"))


@query("SELECT p_partkey AS job_id, '<!doctype html><html><head><meta charset=''utf-8''><title>resume</title></head><body><h1>' || p_name || '</h1>' || chr(10) || '<p>a <strong>b</strong> &lt;c&gt; ' || p_brand || '</p></body></html>' AS html FROM part")
def print_pages(spark, sf_dir):
    markdown = F.concat(F.lit("# "), "p_name", F.lit("\na **b** <c> ["), "p_brand", F.lit("](http://x.y)"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("job_id"), F.lit("resume").alias("kind"), markdown.alias("markdown"))
    return sinks.print_html(rows).select("job_id", "html")


@query("SELECT r_regionkey, '{\"name\":\"' || r_name || '\",\"n\":' || n || '}' AS json FROM (SELECT r_regionkey, r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL)")
def stats_json(spark, sf_dir):
    counts = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey", "r_name").agg(F.count("*").alias("n"))
    told = sinks.stats_json(counts.select(F.col("r_name").alias("name"), "n"))
    return told.select("json", F.get_json_object("json", "$.name").alias("name")).join(counts, F.col("name") == F.col("r_name")).select("r_regionkey", "json")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'slug' END AS shown FROM supplier")
def board_names(spark, sf_dir):
    label = F.when(mod("s_suppkey", 2) == 0, F.col("s_name")).otherwise("")
    return table(spark, sf_dir, "supplier").select("s_suppkey", listing.display_name(label, F.lit("slug|x|y")).alias("shown"))
