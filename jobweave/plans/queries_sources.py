"""Sources whose answers nest, and rules and cleaning over real texts and pages."""

import uuid

from pyspark.sql import functions as F

from jobweave.functions import text
from jobweave.operators import rules
from jobweave.operators.lineage import dealt, shared_folder
from jobweave.plans.binding import DESCRIPTIONS, LOCATIONS, POSTINGS, TAGS, TITLES, one_of, postings, sql_one_of, table
from jobweave.plans.ingest import ingested, keyed
from jobweave.plans.queries_dedupe import COMPANY, CROSS, TITLE
from jobweave.plans.queries_rules import CASCADE, CONFIG, cascade_sql
from jobweave.plans.registry import query
from jobweave.sources import readers, sinks
from jobweave.sources.readers import all_postings, items

DEEP = ["workday", "oracle", "weworkremotely", "hackernews", "ycombinator"]


def obj(**columns):
    return F.struct(*[c.alias(k) for k, c in columns.items()])


def deep_items(spark, sf_dir):
    """Answers of the five sources whose items come with details, pages, feeds or threads, made of postings and read by the engine's own readers."""
    p = dealt(postings(spark, sf_dir), "id").withColumn("turn", F.pmod("id", F.lit(5)))
    of = lambda k: p.where(F.col("turn") == k)
    key, title, place, body = F.col("id").cast("string"), F.col("title"), F.coalesce("location", F.lit("")), F.col("description")
    posted, work = F.date_format("posted_at", "yyyy-MM-dd"), F.when(F.col("remote"), "Remote").otherwise("")
    made = {}
    # A list answer holds one item here; the item's detail comes beside it.
    payload = F.to_json(obj(jobPostings=F.array(obj(title=title, externalPath=F.concat(F.lit("/job/"), key), locationsText=place))))
    detail = F.to_json(obj(jobPostingInfo=obj(jobReqId=key, title=title, jobDescription=body, location=place, timeType=F.lit("Full time"), remoteType=work, startDate=posted)))
    lists = of(0).select(F.concat(F.lit("acme|wd5|Ext"), F.when(F.pmod(F.floor(F.col("id") / 200), F.lit(2)) == 1, "2").otherwise("")).alias("slug"), payload.alias("payload"), F.col("id").cast("int").alias("page"))
    # The cap of a slug is 100 items: each posting has a slug of its own page here, so none is cut.
    lists = lists.withColumn("slug", F.concat("slug", F.col("page").cast("string")))
    details = of(0).select(F.concat(F.lit("/job/"), key).alias("path"), detail.alias("detail"))
    listed = items(lists, "workday")
    made["workday"] = listed.join(details, F.get_json_object("item", "$.externalPath") == F.col("path")).select("slug", "item", "detail")
    payload = F.to_json(obj(items=F.array(obj(TotalJobsCount=F.lit(1), requisitionList=F.array(obj(Id=key, Title=title, PrimaryLocation=place, PostedDate=posted))))))
    detail = F.to_json(obj(items=F.array(obj(Id=key, ExternalDescriptionStr=body, WorkplaceTypeCode=F.when(F.col("remote"), "ORA_REMOTE").otherwise("ORA_ONSITE"), WorkerType=F.lit("Regular"), JobFamily=F.lit("Eng")))))
    lists = of(1).select(F.concat(F.lit("acme.fa.oraclecloud.com|CX|https://acme.org/"), key, F.lit("|Acme Oracle")).alias("slug"), payload.alias("payload"), detail.alias("detail"))
    made["oracle"] = items(lists, "oracle").join(lists.select("slug", "detail"), "slug").select("slug", "item", "detail")
    link = F.concat(F.lit("https://example.org/rss/"), key)
    html = F.concat(F.lit("<a href=\"https://jobs.lever.co/acme/"), key, F.lit("\">apply</a> "), body)
    made["weworkremotely"] = of(2).select(obj(title=F.concat(F.lit("Acme Feed: "), title), link=link, guid=link, description=html, region=place, category=F.lit("Programming"), pubDate=F.concat(F.date_format("posted_at", "EEE, dd MMM yyyy"), F.lit(" 08:09:10 +0000"))).alias("i"))
    comment = F.concat(F.lit("Acme Thread | Lead Engineer "), key, F.lit(" | REMOTE | Berlin<p>Apply at https:&#x2F;&#x2F;acme.org&#x2F;"), key, F.lit(" now"))
    payload = F.to_json(obj(children=F.array(obj(id=key, text=comment, author=F.lit("x"), created_at_i=F.lit("946684800")))))
    threads = of(3).select(key.alias("slug"), payload.alias("payload"))
    made["hackernews"] = items(threads, "hackernews").withColumn("thread_created", F.lit("2000-01-01 00:00:00").cast("timestamp"))
    ld = F.to_json(obj(**{"@type": F.lit("JobPosting"), "title": title, "description": body, "hiringOrganization": obj(name=F.lit("Acme Page")), "jobLocationType": F.when(F.col("remote"), "TELECOMMUTE"), "employmentType": F.lit("FULL_TIME"), "datePosted": posted, "jobLocation": obj(address=obj(addressLocality=place, addressCountry=F.lit("US")))}))
    url = F.concat(F.lit("https://www.ycombinator.com/companies/acme/jobs/"), key)
    made["ycombinator"] = of(4).select(F.to_json(obj(url=url, title=F.lit("Acme (YC S21) is hiring a Dev"))).alias("item"), F.concat(F.lit('<html><script type="application/ld+json">'), ld, F.lit("</script></html>")).alias("page"))
    return made


BODY = "CASE WHEN id % 5 = 3 THEN 'Acme Thread | Lead Engineer ' || id || ' | REMOTE | Berlin' || chr(10) || 'Apply at https://acme.org/' || id || ' now' WHEN id % 5 = 2 THEN '<a href=\"https://jobs.lever.co/acme/' || id || '\">apply</a> ' || description ELSE description END"


@query(
    f"""SELECT s AS source, CASE s WHEN 'workday' THEN 'acme:' || id WHEN 'oracle' THEN 'acme.fa.oraclecloud.com:' || id WHEN 'weworkremotely' THEN 'https://example.org/rss/' || id WHEN 'hackernews' THEN id::VARCHAR ELSE 'acme:' || id END AS source_id,
    CASE s WHEN 'workday' THEN 'https://acme.wd5.myworkdayjobs.com/Ext' || CASE WHEN (id // 200) % 2 = 1 THEN '2' ELSE '' END || id || '/job/' || id WHEN 'oracle' THEN 'https://acme.org/' || id || '/job/' || id WHEN 'weworkremotely' THEN 'https://jobs.lever.co/acme/' || id
      WHEN 'hackernews' THEN 'https://acme.org/' || id ELSE 'https://www.ycombinator.com/companies/acme/jobs/' || id END AS url,
    CASE s WHEN 'hackernews' THEN 'Lead Engineer ' || id ELSE title END AS title,
    CASE s WHEN 'workday' THEN 'Acme' WHEN 'oracle' THEN 'Acme Oracle' WHEN 'weworkremotely' THEN 'Acme Feed' WHEN 'hackernews' THEN 'Acme Thread' ELSE 'Acme Page' END AS company_name, {BODY} AS description,
    CASE s WHEN 'weworkremotely' THEN coalesce(location, 'Remote') WHEN 'hackernews' THEN 'Berlin' WHEN 'ycombinator' THEN concat_ws(', ', location, 'US') ELSE location END AS location,
    CASE s WHEN 'workday' THEN remote OR coalesce(location, '') ILIKE '%remote%' WHEN 'oracle' THEN remote OR coalesce(location, '') ILIKE '%remote%' OR description ILIKE '%work from home%' OR title ILIKE '%(remote)%' WHEN 'ycombinator' THEN remote ELSE true END AS remote,
    CASE s WHEN 'workday' THEN 'Full time' WHEN 'oracle' THEN 'Regular' WHEN 'ycombinator' THEN 'FULL_TIME' END AS employment_type, CASE s WHEN 'hackernews' THEN '2000-01-01' ELSE strftime(posted_at, '%Y-%m-%d') END AS posted,
    CASE s WHEN 'workday' THEN CASE WHEN remote THEN 'Full time,remote' ELSE 'Full time' END WHEN 'oracle' THEN 'Eng,' || CASE WHEN remote THEN 'ORA_REMOTE' ELSE 'ORA_ONSITE' END WHEN 'weworkremotely' THEN 'Programming' WHEN 'hackernews' THEN 'hn-whoishiring' ELSE 'yc,acme' END AS tags
    FROM (SELECT *, (['workday', 'oracle', 'weworkremotely', 'hackernews', 'ycombinator'])[1 + id % 5] AS s FROM ({POSTINGS}))"""
)
def source_details(spark, sf_dir):
    rows = all_postings(deep_items(spark, sf_dir))
    return rows.select("source", "source_id", "url", "title", "company_name", "description", "location", "remote", "employment_type", F.date_format("posted_at", "yyyy-MM-dd").alias("posted"), F.array_join("tags", ",").alias("tags"))


TEXTS = f"""SELECT doc_id AS id, {sql_one_of(TITLES, 'doc_id')} AS title, coalesce(text, '') || ' ' || {sql_one_of(DESCRIPTIONS, 'doc_id // 2')} AS description, {sql_one_of(LOCATIONS, 'doc_id // 3')} AS location, doc_id % 13 <> 0 AS remote, {sql_one_of(TAGS, 'doc_id // 5')} AS tags FROM documents"""


@query(f"SELECT id, filter_status, filter_reason FROM ({cascade_sql(CONFIG, TEXTS)})")
def filter_documents(spark, sf_dir):
    """The rules over whole texts, each with a line that a rule may look for at its end."""
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(
        k.alias("id"),
        one_of(TITLES, k).alias("title"),
        F.concat_ws(" ", F.coalesce("text", F.lit("")), one_of(DESCRIPTIONS, F.floor(k / 2))).alias("description"),
        one_of(LOCATIONS, F.floor(k / 3)).alias("location"),
        (F.pmod(k, F.lit(13)) != 0).alias("remote"),
        one_of(TAGS, F.floor(k / 5)).alias("tags"),
    )
    return rules.classified(rows, CONFIG).select("id", "filter_status", "filter_reason")


TAG = r"</?\s*(?:img|a|iframe|script|style|link|object|embed|svg|base)\b[^>]*>"


@query(f"SELECT page_id, regexp_replace(html, '(?i){TAG}', '', 'g') AS text, regexp_matches(html, '(?i){TAG}') AS before, false AS after FROM pages WHERE html NOT LIKE '%](%' AND html NOT LIKE '%]:%'")
def exfil_pages(spark, sf_dir):
    """Whole pages: tags that load something are found and go; what a page says stays."""
    c = F.col("html")
    rows = table(spark, sf_dir, "pages").where(~F.contains(c, F.lit("](")) & ~F.contains(c, F.lit("]:")))
    found = lambda x: F.array_contains(text.exfil_in(x), "html tag")
    clean = text.without_exfil(c)
    return rows.select("page_id", clean.alias("text"), found(c).alias("before"), found(clean).alias("after"))


INGEST = f"""
WITH RECURSIVE rows_ AS (SELECT row_number() OVER (ORDER BY id) AS k, id, source || '|' || source_id AS h, source || '/' || {COMPANY} || '/' || {TITLE} AS t,
  CASE WHEN length({COMPANY}) >= 2 AND length({CROSS}) >= 4 THEN {COMPANY} || '|' || {CROSS} END AS x, {COMPANY} = 'nova' AS black, {COMPANY} = 'blueskylabs' AS shut,
  posted_at < DATE '2000-05-01' - 30 AS stale, filter_status = 'dropped' AS dropped FROM ({CASCADE})),
s(k, hs, ts, xs, outcome) AS (SELECT 0::BIGINT, list(h), list(t), list(x) FILTER (x IS NOT NULL), '' FROM rows_ WHERE id % 197 = 5
  UNION ALL SELECT r.k, CASE WHEN o = 'inserted' THEN list_append(hs, h) ELSE hs END, CASE WHEN o = 'inserted' THEN list_append(ts, t) ELSE ts END, CASE WHEN o = 'inserted' AND x IS NOT NULL THEN list_append(xs, x) ELSE xs END, o
  FROM s JOIN rows_ r ON r.k = s.k + 1, LATERAL (SELECT CASE WHEN black THEN 'dropped_blacklist' WHEN list_contains(hs, h) THEN 'skipped_duplicate' WHEN stale THEN 'stale' WHEN dropped OR shut THEN 'dropped_filter'
    WHEN list_contains(ts, t) THEN 'skipped_duplicate' WHEN coalesce(list_contains(xs, x), false) THEN 'skipped_cross_source' ELSE 'inserted' END AS o) a)"""


@query(f"{INGEST} SELECT id, outcome FROM s JOIN rows_ USING (k)")
def ingest_outcomes(spark, sf_dir):
    """The whole ingest plan over postings, with stored ones: what becomes of each record."""
    rows = postings(spark, sf_dir)
    records = rows.withColumnRenamed("id", "ord").drop("ingested_at")
    old = keyed(rows.where(F.pmod("id", F.lit(197)) == 5), CONFIG, F.lit("2000-05-01").cast("date"))
    stored = old.select("id", "dedupe_hash", "title_key", "cross_source_hash", F.lit(None).cast("string").alias("jd_fingerprint"), F.col("ingested_at").cast("timestamp").alias("ingested_at"), F.lit(None).cast("long").alias("duplicate_of"))
    names = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    done = ingested(records, stored, F.lit("2000-05-01").cast("date"), CONFIG, names("nova"), names("blueskylabs"))
    return done.rows.select(F.col("ord").alias("id"), "outcome")


@query(
    r"""SELECT doc_id, k::BIGINT AS place, line FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS line FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(coalesce(text, ''), ',', chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[^\x20-\x7e\n]')))
    WHERE line <> ''"""
)
def lists_of_texts(spark, sf_dir):
    """Typed lists out of real texts: items by commas and line feeds."""
    rows = table(spark, sf_dir, "documents").where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20-\x7e\n]"))
    return rows.select("doc_id", F.posexplode(text.listed(F.col("text"))).alias("k", "line")).select("doc_id", (F.col("k") + 1).cast("long").alias("place"), "line")


@query("SELECT s_name AS slug FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 = 0")
def enabled_slugs(spark, sf_dir):
    k = F.col("s_suppkey")
    boards = table(spark, sf_dir, "supplier").select(F.when(F.pmod(k, F.lit(2)) == 0, "lever").otherwise("ashby").alias("source"), F.col("s_name").alias("slug"), (F.pmod(k, F.lit(3)) == 0).alias("enabled"))
    return readers.enabled_slugs(boards, "lever")


@query("SELECT page_id FROM pages WHERE page_id % 4 <> 3")
def personal_paths(spark, sf_dir):
    k = F.col("page_id")
    path = F.when(F.pmod(k, F.lit(4)) == 0, "data/jobs.db-wal").when(F.pmod(k, F.lit(4)) == 1, F.concat(F.lit("applications/"), k.cast("string"), F.lit("/cover.md"))).when(F.pmod(k, F.lit(4)) == 2, "x/resumes/me.pdf").otherwise("src/db.py")
    return readers.personal_files(table(spark, sf_dir, "pages").select("page_id", path.alias("path"))).select("page_id")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 50 = 0 ORDER BY p_partkey DESC LIMIT 2")
def hiring_threads(spark, sf_dir):
    k = F.col("p_partkey")
    threads = table(spark, sf_dir, "part").select(k.alias("id"), F.when(F.pmod(k, F.lit(50)) == 0, "Ask HN: Who is hiring? (May)").otherwise("Ask HN: Who wants to be hired?").alias("title"), k.alias("created"))
    return readers.hiring_threads(threads).select("id")


OWN = rules.FilterConfig.active({"required_tech": ["Go", "vue"], "seniority_terms": ["senior", "lead"], "excluded_tech": ["express"], "home_state": "tx"})


@query(f"SELECT id, filter_status, filter_reason FROM ({cascade_sql(OWN)})")
def filter_own_profile(spark, sf_dir):
    """The rules as a stored profile sets them."""
    return rules.classified(postings(spark, sf_dir), OWN).select("id", "filter_status", "filter_reason")


@query("SELECT page_id::VARCHAR AS slug, html AS payload FROM pages WHERE page_id % 5 <> 0 AND html IS NOT NULL")
def landed_answers(spark, sf_dir):
    """Answers as they land, every fifth line broken: it costs nobody else."""
    path = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    line = F.to_json(obj(slug=F.col("page_id").cast("string"), payload=F.col("html"), page=F.lit(0)))
    table(spark, sf_dir, "pages").select(F.when(F.pmod("page_id", F.lit(5)) == 0, '{"slug": "x", "payload": ').otherwise(line).alias("value")).write.text(path)
    return readers.landed(spark, path).select("slug", "payload")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 1")
def snapshot_read(spark, sf_dir):
    """Two snapshots are written: readers see the last one."""
    root = f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    for part in (0, 1):
        sinks.snapshot(rows.where(F.pmod("n_nationkey", F.lit(2)) == part), root)
    return sinks.current(spark, root)
