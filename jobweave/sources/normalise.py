"""One projection for each board system: its JSON item (a string column, `item`, beside `slug`) to the common record.

Items are parsed with explicit schemas. What does not fit a schema is null for that field alone, so a malformed item costs a field or a row, never a scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.dates import any_time, epoch_or_iso, feed_time, iso_time, millis_time
from jobweave.functions.payloads import job_posting_ld
from jobweave.functions.text import either, html_to_text, looks_remote, or_empty, strip, title_case, unescape_all
from jobweave.operators.boards import apply_link, company_from_host, first_url

RECORD = ["source", "source_id", "url", "title", "company_name", "description", "location", "remote", "employment_type", "posted_at", "tags", "raw"]
NAMED = "array<struct<name:string,value:string>>"
GREENHOUSE = f"title string, id string, location struct<name:string>, offices {NAMED}, departments {NAMED}, metadata {NAMED}, content string, absolute_url string, company_name string, updated_at string, first_published string"
LEVER = (
    "text string, id string, categories struct<location:string,allLocations:array<string>,team:string,commitment:string>, workplaceType string, description string, descriptionBody string,"
    " descriptionPlain string, additional string, lists array<struct<text:string,content:string>>, hostedUrl string, applyUrl string, createdAt string"
)
ASHBY = (
    "title string, id string, location string, secondaryLocations array<struct<location:string>>, workplaceType string, isRemote boolean, isListed boolean, descriptionHtml string, descriptionPlain string,"
    " department string, team string, jobUrl string, applyUrl string, employmentType string, publishedAt string, updatedAt string"
)
WORKDAY_LIST = "externalPath string, title string, locationsText string"
WORKDAY_DETAIL = (
    "jobPostingInfo struct<title:string,jobDescription:string,location:string,remoteType:string,jobReqId:string,id:string,externalUrl:string,timeType:string,startDate:string,postedOn:string>"
)
WORKABLE = (
    "title string, shortcode string, location struct<city:string,region:string,country:string>, workplace string, remote boolean, description string, requirements string, benefits string,"
    " department string, type string, published string, created string"
)
LABEL = "struct<label:string>"
SECTION = "struct<text:string>"
SMARTRECRUITERS = (
    f"name string, id string, location struct<fullLocation:string,city:string,region:string,country:string,remote:boolean,hybrid:boolean>, company struct<name:string>, industry {LABEL}, department {LABEL},"
    f" function {LABEL}, typeOfEmployment {LABEL}, jobAd struct<sections:struct<jobDescription:{SECTION},qualifications:{SECTION},additionalInformation:{SECTION},companyDescription:{SECTION}>>,"
    " postingUrl string, applyUrl string, releasedDate string"
)
JIBE = (
    "title string, slug string, req_id string, location_name string, full_location string, short_location string, description string, responsibilities string, qualifications string,"
    " categories array<struct<name:string>>, tags3 array<string>, tags4 array<string>, tags5 array<string>, hiring_organization string, employment_type string, posted_date string, create_date string"
)
ORACLE_LOCATIONS = "array<struct<Name:string>>"
ORACLE_LIST = f"Id string, Title string, PrimaryLocation string, secondaryLocations {ORACLE_LOCATIONS}, PostedDate string"
ORACLE_DETAIL = (
    f"{ORACLE_LIST}, ExternalDescriptionStr string, ExternalResponsibilitiesStr string, ExternalQualificationsStr string, WorkplaceTypeCode string, WorkplaceType string,"
    " WorkerType string, JobType string, JobFamily string, Category string"
)
REMOTEOK = "id string, position string, company string, location string, description string, tags array<string>, url string, apply_url string, date string, epoch string"
FEED_ITEM = "title string, link string, guid string, description string, region string, category string, pubDate string"
HN_CHILD = "id string, text string, author string, created_at_i string"
HN_ITEM = "url string, title string"
LD = (
    "title string, description string, hiringOrganization struct<name:string>, jobLocationType string, jobLocation string, employmentType string, datePosted string"
)
LD_PLACE = "struct<address:struct<addressLocality:string,addressRegion:string,addressCountry:string>>"
#: Signs of remote work and of a bare country, and parts of a thread's first line.
REMOTE_SIGNAL = (
    r"(?iuU)\(\s*remote\b|\[\s*remote\b|[-–—|:]\s+remote\b|\bremote\s*[-–—|:]|\bfully[\s-]+remote\b|\b100%\s+remote\b"
    r"|\bremote[\s-]+first\b|\bwork(?:s|ing)?\s+remotely\b|\bwork\s+from\s+home\b"
)
ONLY_COUNTRY = r"(?i)^(united states(?: of america)?|usa|u\.s\.a?\.?)$"
REMOTE_WORD, ONSITE_WORD = r"(?iU)\bremote\b", r"(?iU)\b(on[\s-]?site|hybrid|in[\s-]?office)\b"
JOB_KIND = r"(?iU)^(full[-\s]?time|part[-\s]?time|contract|intern)$"
ROLE_WORD = r"(?iU)\b(engineer|developer|architect|sde|swe|designer|manager|director|lead|principal|staff|founder|cto|ceo|head|scientist|researcher|analyst)\b"
HIRING = r"(?U)\b(?:hiring|seeking|looking for)[:\s]+([A-Z][\w\s\-/&,]{4,80})"
LAUNCH_TITLE = r"(?iU)^(.+?)\s+\(YC\s+[A-Za-z]+\d{2,4}\)\s+(?:Is\s+)?(?:Hiring|Is\s+Looking\s+For)\s+(?:a\s+|an\s+)?(.+?)$"
JOB_PAGE = r"(?U)^https?://(?:www\.)?ycombinator\.com/companies/([\w.-]+)/jobs/([\w.-]+)"


def parsed(items: DataFrame, schema: str) -> DataFrame:
    """items with i: the item as a struct; rows that are no JSON object go."""
    return items.withColumn("i", F.from_json("item", schema)).where(F.col("i").isNotNull() & F.col("item").rlike(r"^\s*\{"))


def text(path: str) -> Column:
    return or_empty(F.col(path))


def joined(sep: str, *parts: Column) -> Column:
    """The parts that are not empty, in order."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), sep)


def present(*tags: Column) -> Column:
    return F.filter(F.array(*tags), lambda t: t != "")


def names(path: str) -> Column:
    return F.coalesce(F.transform(path, lambda x: or_empty(x["name"])), F.array().cast("array<string>"))


def record(rows: DataFrame, source: str, **columns: Column) -> DataFrame:
    """The common record; rows without title or id go."""
    values = {"location": F.lit(None), "employment_type": F.lit(None), "posted_at": F.lit(None).cast("timestamp"), "tags": F.array().cast("array<string>"), "raw": F.col("item")} | columns
    kinds = {"remote": "boolean", "posted_at": "timestamp", "tags": "array<string>"}
    made = rows.select(F.lit(source).alias("source"), *[values[c].cast(kinds.get(c, "string")).alias(c) for c in RECORD[1:]])
    return made.where((F.col("title") != "") & F.col("source_id").isNotNull())


def with_slug(key: Column) -> Column:
    """slug:key, null without a key."""
    return F.when(key != "", F.concat_ws(":", "slug", key))


def slug_name() -> Column:
    return title_case(F.replace("slug", F.lit("-"), F.lit(" ")))


def greenhouse(items: DataFrame) -> DataFrame:
    rows = parsed(items, GREENHOUSE)
    place, offices = text("i.location.name"), F.array_join(names("i.offices"), " ")
    departments = F.array_join(names("i.departments"), ", ")
    metadata = F.array_join(F.coalesce(F.transform("i.metadata", lambda m: F.concat(or_empty(m["name"]), F.lit(": "), or_empty(m["value"]))), F.array().cast("array<string>")), " ")
    pieces = F.split(F.replace(F.concat_ws(",", departments, metadata), F.lit(":"), F.lit(",")), ",")
    return record(
        rows,
        "greenhouse",
        source_id=with_slug(F.col("i.id")),
        url=text("i.absolute_url"),
        title=strip(text("i.title")),
        company_name=F.coalesce(either(F.col("i.company_name")), slug_name()),
        description=strip(F.concat_ws("\n\n", unescape_all(text("i.content")), joined("\n\n", departments, metadata, offices))),
        location=either(place, offices),
        remote=F.lower(F.concat_ws(" ", place, offices)).rlike("remote|anywhere|distributed"),
        posted_at=iso_time(either(F.col("i.updated_at"), F.col("i.first_published"))),
        tags=F.filter(F.transform(pieces, strip), lambda t: t != ""),
    )


def lever(items: DataFrame) -> DataFrame:
    rows = parsed(items, LEVER)
    place, places = text("i.categories.location"), F.coalesce("i.categories.allLocations", F.array().cast("array<string>"))
    work = F.lower(text("i.workplaceType"))
    lists = F.array_join(F.coalesce(F.transform("i.lists", lambda x: F.concat(F.lit("## "), or_empty(x["text"]), F.lit("\n"), or_empty(x["content"]))), F.array().cast("array<string>")), "\n")
    full = joined("\n\n", F.coalesce(either(F.col("i.description"), F.col("i.descriptionBody")), F.lit("")), text("i.additional"), lists)
    return record(
        rows,
        "lever",
        source_id=with_slug(F.col("i.id")),
        url=F.coalesce(either(F.col("i.hostedUrl"), F.col("i.applyUrl")), F.lit("")),
        title=strip(text("i.text")),
        company_name=slug_name(),
        description=F.when(strip(full) == "", text("i.descriptionPlain")).otherwise(full),
        location=F.coalesce(either(place), F.get(places, F.lit(0))),
        remote=(work == "remote") | looks_remote(place, F.array_join(places, " ")),
        employment_type=either(F.col("i.categories.commitment")),
        posted_at=millis_time(F.col("i.createdAt")),
        tags=present(strip(text("i.categories.team")), strip(work)),
    )


def ashby(items: DataFrame) -> DataFrame:
    rows = parsed(items, ASHBY).where(F.coalesce("i.isListed", F.lit(True)))
    place = strip(text("i.location"))
    others = F.array_join(F.coalesce(F.transform("i.secondaryLocations", lambda s: or_empty(s["location"])), F.array().cast("array<string>")), ", ")
    work, department, team = (strip(text(f"i.{c}")) for c in ("workplaceType", "department", "team"))
    description = F.coalesce(either(F.col("i.descriptionHtml"), F.col("i.descriptionPlain")), F.lit(""))
    extras = joined("\n\n", department, team, others, work)
    return record(
        rows,
        "ashby",
        source_id=with_slug(F.col("i.id")),
        url=F.coalesce(either(F.col("i.jobUrl"), F.col("i.applyUrl")), F.lit("")),
        title=strip(text("i.title")),
        company_name=F.col("slug"),
        description=F.when(extras == "", description).otherwise(strip(F.concat(description, F.lit("\n\n"), extras))),
        location=either(place, others),
        remote=F.coalesce("i.isRemote", F.lit(False)) | (F.lower(work) == "remote") | looks_remote(place, others),
        employment_type=F.col("i.employmentType"),
        posted_at=iso_time(either(F.col("i.publishedAt"), F.col("i.updatedAt"))),
        tags=present(department, team, work),
    )


def workday(items: DataFrame) -> DataFrame:
    """items: slug (tenant|region|site), item (of the list) and detail (the posting's own answer)."""
    rows = parsed(items, WORKDAY_LIST).withColumn("d", F.from_json("detail", WORKDAY_DETAIL)["jobPostingInfo"]).where(F.col("detail").isNotNull())
    part = lambda k: F.get(F.split("slug", r"\|"), F.lit(k))
    place, remote = F.coalesce(either(F.col("d.location"), F.col("i.locationsText")), F.lit("")), F.lower(text("d.remoteType"))
    address = F.concat(F.lit("https://"), part(0), F.lit("."), part(1), F.lit(".myworkdayjobs.com/"), part(2), F.col("i.externalPath"))
    return record(
        rows,
        "workday",
        source_id=F.concat_ws(":", part(0), either(F.col("d.jobReqId"), F.col("d.id"), F.col("i.externalPath"))),
        url=F.coalesce(either(F.col("d.externalUrl")), address),
        title=strip(F.coalesce(either(F.col("d.title"), F.col("i.title")), F.lit(""))),
        company_name=title_case(part(0)),
        description=text("d.jobDescription"),
        location=either(place),
        remote=looks_remote(remote, place),
        employment_type=F.col("d.timeType"),
        posted_at=any_time(either(F.col("d.startDate"), F.col("d.postedOn"))),
        tags=present(text("d.timeType"), remote),
        raw=F.to_json(F.struct(F.col("item").alias("list"), "detail")),
    )


def workable(items: DataFrame) -> DataFrame:
    rows = parsed(items, WORKABLE)
    place = either(joined(", ", *[text(f"i.location.{c}") for c in ("city", "region", "country")]))
    work = F.lower(strip(text("i.workplace")))
    departments = F.coalesce(F.from_json("i.department", "array<string>"), F.filter(F.array(text("i.department")), lambda d: d != ""))
    return record(
        rows,
        "workable",
        source_id=with_slug(F.col("i.shortcode")),
        url=F.concat(F.lit("https://apply.workable.com/"), "slug", F.lit("/j/"), F.col("i.shortcode"), F.lit("/")),
        title=strip(text("i.title")),
        company_name=F.col("slug"),
        description=strip(joined("\n\n", text("i.description"), text("i.requirements"), text("i.benefits"))),
        location=place,
        remote=F.coalesce("i.remote", F.lit(False)) | (work == "remote") | looks_remote(place),
        employment_type=either(F.col("i.type")),
        posted_at=iso_time(either(F.col("i.published"), F.col("i.created"))),
        tags=F.concat(F.filter(departments, lambda d: d.isNotNull()), present(work)),
    )


def smartrecruiters(items: DataFrame) -> DataFrame:
    rows = parsed(items, SMARTRECRUITERS)
    place = either(F.col("i.location.fullLocation"), joined(", ", *[text(f"i.location.{c}") for c in ("city", "region", "country")]))
    remote, hybrid = (F.coalesce(f"i.location.{c}", F.lit(False)) for c in ("remote", "hybrid"))
    sections = [text(f"i.jobAd.sections.{s}.text") for s in ("jobDescription", "qualifications", "additionalInformation", "companyDescription")]
    labels = [text(f"i.{c}.label") for c in ("industry", "department", "function")]
    return record(
        rows,
        "smartrecruiters",
        source_id=with_slug(F.col("i.id")),
        url=F.coalesce(either(F.col("i.postingUrl"), F.col("i.applyUrl")), F.lit("")),
        title=strip(text("i.name")),
        company_name=F.coalesce(either(F.col("i.company.name")), F.col("slug")),
        description=strip(joined("\n\n", *sections)),
        location=place,
        remote=remote | (looks_remote(place) & ~hybrid),
        employment_type=F.col("i.typeOfEmployment.label"),
        posted_at=iso_time(F.col("i.releasedDate")),
        tags=present(*labels, F.when(remote, "remote").otherwise(""), F.when(hybrid, "hybrid").otherwise("")),
    )


def jibe(items: DataFrame) -> DataFrame:
    rows = parsed(items, JIBE)
    place = either(F.col("i.location_name"), F.col("i.full_location"), F.col("i.short_location"))
    key = either(F.col("i.slug"), F.col("i.req_id"))
    empty = F.array().cast("array<string>")
    tags = F.concat(F.filter(names("i.categories"), lambda t: t != ""), *[F.filter(F.coalesce(f"i.{c}", empty), lambda t: t.isNotNull()) for c in ("tags3", "tags4", "tags5")])
    return record(
        rows,
        "jibe",
        source_id=with_slug(key),
        url=F.concat(F.lit("https://"), "slug", F.lit(".jibeapply.com/jobs/"), key, F.lit("?lang=en-us")),
        title=strip(text("i.title")),
        company_name=F.coalesce(either(F.col("i.hiring_organization")), F.col("slug")),
        description=strip(joined("\n\n", text("i.description"), text("i.responsibilities"), text("i.qualifications"))),
        location=place,
        remote=looks_remote(place),
        employment_type=either(F.col("i.employment_type")),
        posted_at=iso_time(either(F.col("i.posted_date"), F.col("i.create_date"))),
        tags=F.concat(tags, F.when(looks_remote(place), F.array(F.lit("remote"))).otherwise(empty)),
    )


def oracle_page(payload: Column) -> Column:
    """struct(items, total) of a list answer: nested in its first item, or at the top; anything else has no items."""
    nested = F.from_json(payload, "items array<struct<TotalJobsCount:string,requisitionList:array<string>>>")
    top = F.from_json(payload, "TotalJobsCount string, requisitionList array<string>")
    inner = F.get(nested["items"], F.lit(0))
    empty = F.array().cast("array<string>")
    return F.struct(F.coalesce(inner["requisitionList"], top["requisitionList"], empty).alias("items"), F.coalesce(inner["TotalJobsCount"], top["TotalJobsCount"]).try_cast("long").alias("total"))


def oracle_detail(payload: Column) -> Column:
    """The detail object as a JSON string: the first item, or the answer itself if it has an Id."""
    return F.coalesce(F.get(F.from_json(payload, "items array<string>")["items"], F.lit(0)), F.when(F.get_json_object(payload, "$.Id").isNotNull(), payload))


def oracle(items: DataFrame) -> DataFrame:
    """items: slug (host|site|address, and maybe company), item (of the list) and detail (an answer, or null)."""
    rows = parsed(items, ORACLE_LIST).withColumn("d", F.from_json(oracle_detail(F.col("detail")), ORACLE_DETAIL))
    part = lambda k: F.trim(F.get(F.split("slug", r"\|"), F.lit(k)))
    listed = lambda p: F.filter(names(f"{p}.secondaryLocations"), lambda n: n != "")
    key, title = strip(F.coalesce(either(F.col("d.Id"), F.col("i.Id")), F.lit(""))), strip(F.coalesce(either(F.col("d.Title"), F.col("i.Title")), F.lit("")))
    description = joined("\n\n", *[strip(text(f"d.External{s}Str")) for s in ("Description", "Responsibilities", "Qualifications")])
    place = F.coalesce(either(F.col("d.PrimaryLocation"), F.col("i.PrimaryLocation"), F.array_join(listed("i"), ", ")), F.lit(""))
    work = F.upper(F.coalesce(either(F.col("d.WorkplaceTypeCode"), F.col("d.WorkplaceType")), F.lit("")))
    entries = F.concat(present(text("d.PrimaryLocation"), text("i.PrimaryLocation")), listed("d"), listed("i"))
    bare = F.exists(entries, lambda e: strip(e).rlike(ONLY_COUNTRY))
    return record(
        rows,
        "oracle",
        source_id=F.when(key != "", F.concat_ws(":", part(0), key)),
        url=F.concat(F.regexp_replace(part(2), "/+$", ""), F.lit("/job/"), key),
        title=title,
        company_name=F.coalesce(either(part(3)), company_from_host(part(0))),
        description=description,
        location=either(place),
        remote=F.contains(work, F.lit("REMOTE")) | looks_remote(place) | bare | F.concat_ws("\n", title, description).rlike(REMOTE_SIGNAL),
        employment_type=either(F.col("d.WorkerType"), F.col("d.JobType")),
        posted_at=any_time(either(F.col("d.PostedDate"), F.col("i.PostedDate"))),
        tags=present(text("d.JobFamily"), text("d.Category"), work),
        raw=F.to_json(F.struct(F.col("item").alias("list"), "detail")),
    )


def remoteok(items: DataFrame) -> DataFrame:
    rows = parsed(items, REMOTEOK).where("i.id is not null and i.position is not null")
    return record(
        rows,
        "remoteok",
        source_id=F.col("i.id"),
        url=F.coalesce(either(F.col("i.url"), F.col("i.apply_url")), F.lit("")),
        title=unescape_all(strip(text("i.position"))),
        company_name=F.coalesce(either(unescape_all(strip(text("i.company")))), F.lit("Unknown")),
        description=text("i.description"),
        location=F.coalesce(either(unescape_all(strip(text("i.location")))), F.lit("Remote")),
        remote=F.lit(True),
        posted_at=epoch_or_iso(either(F.col("i.date"), F.col("i.epoch"))),
        tags=F.filter(F.coalesce("i.tags", F.array().cast("array<string>")), lambda t: t.isNotNull()),
    )


def weworkremotely(items: DataFrame) -> DataFrame:
    """items: a feed's items as a struct column i (from the XML reader or from_xml); those without a link to apply by go."""
    rows = items.withColumn("item", F.to_json("i"))
    title, link = strip(text("i.title")), either(strip(text("i.link")), strip(text("i.guid")))
    split = r"(?sU)^\s*([^:]+?)\s*:\s*(.+?)\s*$"
    fits = title.rlike(split)
    made = record(
        rows,
        "weworkremotely",
        source_id=link,
        url=apply_link(F.col("i.description")),
        title=F.when(fits, F.regexp_extract(title, split, 2)).otherwise(title),
        company_name=F.when(fits, F.regexp_extract(title, split, 1)).otherwise("Unknown"),
        description=strip(text("i.description")),
        location=F.coalesce(either(strip(text("i.region"))), F.lit("Remote")),
        remote=F.lit(True),
        posted_at=feed_time(F.col("i.pubDate")),
        tags=present(strip(text("i.category"))),
    )
    return made.where("url is not null").dropDuplicates(["source_id"])


def header_parts(first_line: Column) -> Column:
    return F.filter(F.transform(F.split(first_line, r"\|"), strip), lambda p: p != "")


def part_kind(p: Column) -> Column:
    """What a part of a thread's first line is: url, workplace, emptype, comp, title or other."""
    whole = p.rlike(r"(?iU)^(?:remote|on[\s-]?site|hybrid|in[\s-]?office)$")
    return F.when(p.rlike("https?://[^\\s<>\"']+"), "url").when(whole, "workplace").when(p.rlike(JOB_KIND), "emptype").when(p.rlike("^[$€£]"), "comp").when(p.rlike(ROLE_WORD), "title").otherwise("other")


def header(plain: Column) -> Column:
    """struct(company, title, location, remote) from the first line of a comment: the first part, then by what the parts look like."""
    line = F.coalesce(F.get(F.filter(F.split(plain, "\n"), lambda x: strip(x) != ""), F.lit(0)), F.lit(""))
    parts = header_parts(line)
    rest = F.filter(parts, lambda p, k: k > 0)
    of_kind = lambda kind: F.get(F.filter(rest, lambda p: part_kind(p) == kind), F.lit(0))
    remote = F.when(F.size(parts) > 0, line.rlike(REMOTE_WORD)).otherwise(plain.rlike(REMOTE_WORD) & ~plain.rlike(ONSITE_WORD))
    return F.struct(F.get(parts, F.lit(0)).alias("company"), of_kind("title").alias("title"), of_kind("other").alias("location"), remote.alias("remote"))


def title_in_text(company: Column, plain: Column) -> Column:
    told = F.regexp_replace(strip(F.regexp_extract(plain, HIRING, 1)), r"[.,;:]+$", "")
    return F.coalesce(either(told), F.when(company.isNotNull(), F.concat(company, F.lit(" (HN — see description)"))))


def hackernews(items: DataFrame) -> DataFrame:
    """items: item (a comment of a thread) and thread_created."""
    rows = parsed(items, HN_CHILD).where("i.id is not null and i.text <> ''").withColumn("plain", html_to_text(F.col("i.text"))).withColumn("h", header(F.col("plain")))
    return record(
        rows,
        "hackernews",
        source_id=F.col("i.id"),
        url=F.coalesce(first_url(F.col("plain")), F.concat(F.lit("https://news.ycombinator.com/item?id="), F.col("i.id"))),
        title=F.coalesce("h.title", title_in_text(F.col("h.company"), F.col("plain")), F.lit("(see description)")),
        company_name=F.coalesce("h.company", F.lit("Unknown")),
        description=F.col("plain"),
        location=F.col("h.location"),
        remote=F.col("h.remote"),
        posted_at=F.coalesce(F.timestamp_seconds(F.col("i.created_at_i").try_cast("long")), F.col("thread_created")),
        tags=F.array(F.lit("hn-whoishiring")),
    )


def launch_title(title: Column) -> Column:
    """struct(company, role) of a title like "X (YC S21) is hiring a Y"; nulls for others."""
    part = lambda k: either(strip(F.regexp_extract(strip(or_empty(title)), LAUNCH_TITLE, k)))
    return F.struct(part(1).alias("company"), part(2).alias("role"))


def ycombinator(items: DataFrame) -> DataFrame:
    """items: item (url and title) and page (the HTML behind the url); only job pages with a JobPosting block count."""
    rows = parsed(items, HN_ITEM).where(F.col("i.url").rlike(JOB_PAGE)).withColumn("ld", job_posting_ld(F.col("page"))).where("ld is not null")
    rows = rows.withColumn("l", F.from_json("ld", LD)).withColumn("h", launch_title(F.col("i.title")))
    rows = rows.withColumn("place", F.coalesce(F.get(F.from_json("l.jobLocation", f"array<{LD_PLACE}>"), F.lit(0)), F.from_json("l.jobLocation", LD_PLACE)))
    key = lambda k: F.regexp_extract("i.url", JOB_PAGE, k)
    flag = F.upper(text("l.jobLocationType")) == "TELECOMMUTE"
    place = either(unescape_all(joined(", ", *[text(f"place.address.address{c}") for c in ("Locality", "Region", "Country")])))
    description = strip(text("l.description"))
    return record(
        rows,
        "ycombinator",
        source_id=F.concat_ws(":", key(1), key(2)),
        url=F.col("i.url"),
        title=F.coalesce(either(strip(text("l.title")), F.col("h.role"), F.col("i.title")), F.lit("")),
        company_name=F.coalesce(either(strip(text("l.hiringOrganization.name")), F.col("h.company")), key(1)),
        description=description,
        location=F.coalesce(place, F.when(flag, "Remote")),
        remote=flag | (F.regexp_count(F.lower(description), F.lit("remote")) >= 2),
        employment_type=either(F.col("l.employmentType")),
        posted_at=iso_time(F.col("l.datePosted")),
        tags=F.array(F.lit("yc"), key(1)),
        raw=F.to_json(F.struct(F.col("item").alias("hn"), "ld")),
    )
