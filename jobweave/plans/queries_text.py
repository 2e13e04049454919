"""Text, addresses, dates and payloads."""

from pyspark.sql import functions as F

from jobweave.functions import dates, text
from jobweave.operators import boards
from jobweave.plans.binding import JOBS, POSTINGS, jobs, one_of, postings, sql_one_of, sql_text, table
from jobweave.plans.registry import query
from jobweave.sources import normalise
from jobweave.sources.readers import REGISTRY, all_postings


@query(
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?i)<\s*/?(p|div|li|h[1-6])\s*>', chr(10), 'g'),
    '(?i)<\s*br\s*/?\s*>', chr(10), 'g'), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') AS text FROM pages"""
)
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_to_text(F.col("html"), text.unescape_common).alias("text"))


OTHERS = "|".join(h.replace(".", r"\.") for h in ("example.com",))


@query(r"""SELECT page_id, len(h)::BIGINT AS links, list_filter(h, lambda x: regexp_matches(x, '^https?://'))[1] AS first_link FROM (SELECT page_id, regexp_extract_all(html, '(?i)href\s*=\s*["'']([^"'']+)["'']', 1) AS h FROM pages)""")
def href_pick(spark, sf_dir):
    links = boards.hrefs(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("links"), boards.apply_link(F.col("html")).alias("first_link"))


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, url LIKE 'http%' AS is_url FROM pages")
def url_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", boards.host_of(F.col("url")).alias("host"), boards.looks_like_url(F.col("url")).alias("is_url"))


#: Addresses and the board of each.
ADDRESSES = {
    "https://boards.greenhouse.io/Acme/jobs/1": ("greenhouse", "acme"),
    "boards-api.greenhouse.io/v1/boards/Acme/jobs": ("greenhouse", "acme"),
    "https://boards.greenhouse.io/embed/job_board?for=Acme&x=1": ("greenhouse", "acme"),
    "https://jobs.lever.co/Acme-1/2": ("lever", "acme-1"),
    "https://jobs.ashbyhq.com/Acme%20Co": ("ashby", "Acme%20Co"),
    "https://apply.workable.com/acme/": ("workable", "acme"),
    "careers.smartrecruiters.com/Visa": ("smartrecruiters", "Visa"),
    "https://acme.jibeapply.com/jobs": ("jibe", "acme"),
    "https://acme.wd5.myworkdayjobs.com/en-US/External": ("workday", "acme|wd5|External"),
    "https://acme.wd5.myworkdayjobs.com/wday/cxs/acme/Site/jobs": ("workday", "acme|wd5|Site"),
    "https://acme.myworkdayjobs.com/x": (None, None),
    "just a name": (None, None),
}


@query(f"SELECT s_suppkey, {sql_one_of([s for s, _ in ADDRESSES.values()], 's_suppkey')} AS source, {sql_one_of([g for _, g in ADDRESSES.values()], 's_suppkey')} AS slug FROM supplier")
def board_addresses(spark, sf_dir):
    board = boards.board_of(one_of(list(ADDRESSES), F.col("s_suppkey")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", board.alias("b")).select("s_suppkey", "b.source", "b.slug")


@query(
    r"""SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS joined, lower(array_to_string(regexp_extract_all(c_name, '[A-Za-z0-9]+'), '-')) AS hyphenated,
    CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 2 END::BIGINT AS with_suffix FROM customer"""
)
def company_spellings(spark, sf_dir):
    plain = boards.slug_spellings(F.col("c_name"))
    more = boards.slug_spellings(F.concat("c_name", F.when(F.pmod("c_custkey", F.lit(2)) == 0, " Inc").otherwise("")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.get(plain, F.lit(0)).alias("joined"), F.get(plain, F.lit(1)).alias("hyphenated"), F.size(more).cast("long").alias("with_suffix"))


@query(
    r"""SELECT doc_id, trim(p[1]) AS company, trim(list_filter(p[2:], lambda x: regexp_matches(x, '(?i)\b(engineer|developer|architect|sde|swe|designer|manager|director|lead|principal|staff|founder|cto|ceo|head|scientist|researcher|analyst)\b') AND NOT regexp_matches(x, 'https?://'))[1]) AS title
    FROM (SELECT doc_id, list_filter(string_split('Org ' || coalesce(source, 'none') || ' | Lead Engineer ' || coalesce(lang, '-') || ' | REMOTE | $100k', '|'), lambda x: trim(x) <> '') AS p FROM documents)"""
)
def header_parse(spark, sf_dir):
    line = F.concat(F.lit("Org "), F.coalesce("source", F.lit("none")), F.lit(" | Lead Engineer "), F.coalesce("lang", F.lit("-")), F.lit(" | REMOTE | $100k"))
    h = normalise.header(line)
    return table(spark, sf_dir, "documents").select("doc_id", h["company"].alias("company"), h["title"].alias("title"))


TRANSLATED = "translate(replace(text, '…', '...'), '—–“”‘’ •▪▶★​‌‍﻿', '--\"\"'''' ----')"


@query(
    f"""SELECT conv_id, turn, {TRANSLATED} AS text, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[—–“”‘’… •▪▶★​‌‍﻿]'))), '') AS banned
    FROM (SELECT conv_id, turn, coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN ' — “x”… •' ELSE '' END AS text FROM conversations)"""
)
def sanitize_text(spark, sf_dir):
    c = F.concat(F.coalesce("text", F.lit("")), F.when(F.pmod("turn", F.lit(2)) == 0, " — “x”… •").otherwise(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", c.alias("text"))
    return rows.select("conv_id", "turn", text.sanitised(F.col("text")).alias("text"), F.array_join(text.banned_in(F.col("text")), "").alias("banned"))


@query("SELECT doc_id, 'See Home (http://a.b/' || doc_id || ') and http://c.d and . x' AS text, '' AS found FROM documents")
def exfil_strip(spark, sf_dir):
    c = F.concat(F.lit("See [Home](http://a.b/"), F.col("doc_id").cast("string"), F.lit(") and [http://c.d](http://c.d) and ![i](http://e.f/p.png).<img src=x> x"))
    clean = text.without_exfil(c)
    return table(spark, sf_dir, "documents").select("doc_id", clean.alias("text"), F.array_join(text.exfil_in(clean), ",").alias("found"))


@query(
    r"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') AS text FROM conversations"""
)
def resume_normalise(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.resume_text(F.col("text")).alias("text"))


@query(f"SELECT id, strftime(ingested_at, '%Y-%m-%d') AS iso, strftime(ingested_at, '%Y-%m-%d') || CASE WHEN id % 2 = 0 THEN ' 10:20:30' ELSE ' 00:00:00' END AS multi, strftime(ingested_at, '%Y-%m-%d') || ' 08:09:10' AS feed FROM ({JOBS})")
def date_parse_multi(spark, sf_dir):
    at = F.col("ingested_at")
    show = lambda c, f="yyyy-MM-dd HH:mm:ss": F.date_format(c, f)
    multi = F.concat(show(at, "yyyy-MM-dd"), F.when(F.pmod("id", F.lit(2)) == 0, "T10:20:30").otherwise(""))
    feed = F.concat(show(at, "EEE, dd MMM yyyy"), F.lit(" 08:09:10 GMT"))
    # A zone is put back to the session's own for showing, so the result is the same in any zone.
    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), dates.feed_time(feed).cast("timestamp_ntz"))
    return jobs(spark, sf_dir).select("id", show(dates.iso_time(show(at, "yyyy-MM-dd")), "yyyy-MM-dd").alias("iso"), show(dates.any_time(multi)).alias("multi"), show(utc).alias("feed"))


@query("SELECT event_id, user_id, ('0' || regexp_extract(props, '\"k\": *(\\d+)', 1))::BIGINT AS k, user_id % 3 <> 0 AS told FROM events")
def json_fields(spark, sf_dir):
    from jobweave.functions.payloads import object_in

    chatty = F.when(F.pmod("user_id", F.lit(3)) == 0, F.lit("no answer {")).otherwise(F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone {not json}.")))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), object_in(chatty).alias("o"))
    return rows.select("event_id", "user_id", "k", F.col("o").isNotNull().alias("told"))


@query("SELECT n_nationkey, n_nationkey // 10 > 0 OR n_nationkey % 10 > 4 AS newer FROM nation")
def version_compare(spark, sf_dir):
    k = F.col("n_nationkey")
    version = F.concat(F.lit("v1."), F.floor(k / 10).cast("string"), F.lit("."), F.pmod(k, F.lit(10)).cast("string"), F.lit("-rc1"))
    return table(spark, sf_dir, "nation").select("n_nationkey", text.is_newer(version, F.lit("1.0.4")).alias("newer"))


@query(f"SELECT id, CASE WHEN length(description) > 40 THEN rtrim(substr(description, 1, 40)) || '...' ELSE description END AS head, len(string_split(description, ','))::BIGINT AS items FROM ({POSTINGS})")
def clip_and_list(spark, sf_dir):
    return postings(spark, sf_dir).select("id", text.clipped(F.col("description"), 40).alias("head"), F.size(text.listed(F.col("description"))).cast("long").alias("items"))


@query(f"SELECT id, 'Title: ' || title || chr(10) || 'At: ' || company_name || chr(10) AS prompt FROM ({POSTINGS})")
def prompt_render(spark, sf_dir):
    template = "Title: {{title}}\nAt: {{company}}\n"
    safe = text.untrusted(F.concat(F.lit("n0nce"), "title"), "n0nce")
    return postings(spark, sf_dir).select("id", text.rendered(template, {"title": safe, "company": F.col("company_name")}).alias("prompt"))


def made_items(spark, sf_dir):
    """Items of each JSON source, made of postings: {source: slug, item and what else the source needs}."""
    p = postings(spark, sf_dir)
    key, place, tags = F.col("id").cast("string"), F.coalesce("location", F.lit("")), F.array_join("tags", ", ")
    s = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]))
    obj = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    title, body = F.col("title"), F.col("description")
    items = {
        "greenhouse": s(id=key, title=title, location=obj(name=place), content=body, departments=F.array(obj(name=tags))),
        "lever": s(id=key, text=title, categories=obj(location=place, team=tags), descriptionPlain=body),
        "ashby": s(id=key, title=title, location=place, descriptionHtml=body, team=tags, isRemote=F.col("remote")),
        "workable": s(shortcode=key, title=title, location=obj(city=place), description=body, remote=F.col("remote"), department=F.col("tags")),
        "smartrecruiters": s(id=key, name=title, location=obj(fullLocation=place, remote=F.col("remote")), jobAd=obj(sections=obj(jobDescription=obj(text=body)))),
        "jibe": s(slug=key, title=title, location_name=place, description=body, tags3=F.col("tags")),
        "remoteok": s(id=key, position=title, location=place, description=body, tags=F.col("tags")),
    }
    used = [r for r in REGISTRY if r in items]
    return {r: p.where(F.pmod("id", F.lit(len(used))) == k).select(F.lit("acme-co").alias("slug"), items[r].alias("item")) for k, r in enumerate(used)}


USED = ["greenhouse", "lever", "ashby", "workable", "smartrecruiters", "jibe", "remoteok"]
REMOTE = "CASE r WHEN 'greenhouse' THEN regexp_matches(lower(l), 'remote|anywhere|distributed') WHEN 'lever' THEN lower(l) LIKE '%remote%' WHEN 'jibe' THEN lower(l) LIKE '%remote%' WHEN 'remoteok' THEN true ELSE remote OR lower(l) LIKE '%remote%' END"


@query(
    f"""SELECT r AS source, CASE WHEN r = 'remoteok' THEN '' ELSE 'acme-co:' END || id AS source_id, title, CASE WHEN r IN ('greenhouse', 'lever') THEN 'Acme Co' WHEN r = 'remoteok' THEN 'Unknown' ELSE 'acme-co' END AS company_name,
    CASE WHEN l = '' THEN CASE WHEN r = 'remoteok' THEN 'Remote' END ELSE l END AS location, {REMOTE} AS remote, (list_position({sql_text(USED)}, r) - 1)::BIGINT AS pos
    FROM (SELECT *, {sql_one_of(USED, 'id')} AS r, coalesce(location, '') AS l FROM ({POSTINGS}))"""
)
def source_union(spark, sf_dir):
    rows = all_postings(made_items(spark, sf_dir))
    place = F.array_position(F.array(*map(F.lit, USED)), F.col("source")) - 1
    return rows.select("source", "source_id", "title", "company_name", "location", "remote", place.cast("long").alias("pos"))
