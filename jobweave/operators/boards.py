"""Job boards: addresses and slugs, discovery, verification results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions.text import either, normal_company, or_empty, strip, title_case

#: Sources in the order in which names are probed, and those whose answer proves that a board exists.
PROBED = ["greenhouse", "lever", "ashby", "smartrecruiters", "workable"]
PROVEN = ["greenhouse", "lever", "ashby", "jibe"]
CASE_KEPT = ["smartrecruiters", "ashby"]
CASE_BLIND = ["ashby"]
#: Hosts of application systems, and hosts that are never the place to apply.
APPLY_HOSTS = [
    "greenhouse.io",
    "lever.co",
    "ashbyhq.com",
    "myworkdayjobs.com",
    "workable.com",
    "smartrecruiters.com",
    "bamboohr.com",
    "jobvite.com",
    "breezy.hr",
    "jobs.personio.com",
    "recruitee.com",
    "rippling.com",
    "teamtailor.com",
    "pinpointhq.com",
    "join.com",
    "applytojob.com",
    "icims.com",
    "myworkdaysite.com",
]
OTHER_HOSTS = [
    "weworkremotely.com",
    "twitter.com",
    "x.com",
    "linkedin.com",
    "facebook.com",
    "instagram.com",
    "youtube.com",
    "github.com",
    "medium.com",
    "wikipedia.org",
    "google.com",
    "tinyurl.com",
    "bit.ly",
]
#: Where slugs stand in the addresses of a feed, and what is no slug.
SLUG_IN_URL = {
    "greenhouse": (r"(?U)(?:boards|job-boards|boards-api)\.greenhouse\.io/([\w-]+)", "^[a-f0-9]{16,}$|^embed$"),
    "lever": (r"(?U)jobs\.lever\.co/([\w.-]+)", "^[a-f0-9]{16,}$"),
    "workable": (r"(?iU)apply\.workable\.com/([\w-]+)", r"^\d+$"),
    "smartrecruiters": (r"(?iU)(?:jobs|careers)\.smartrecruiters\.com/([\w.-]+?)(?=/|\?|#|$)", r"^\d+$"),
    "ashby": (r"(?iU)jobs\.ashbyhq\.com/([\w.-]+)", r"^\d+$|(?i)^[a-f0-9]{16,}$"),
}
LOCALE = r"^[a-z]{2}([-_][A-Za-z]{2})?$"
HOST_NOISE = ["careers", "career", "jobs", "job", "www", "eeho", "fa", "oraclecloud"]


def host_of(url: Column) -> Column:
    """The host of an address, in small letters, without user and port; null for none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def under(host: Column, domains: list[str]) -> Column:
    """Whether the host is one of the domains or below one."""
    any_of = F.lit(False)
    for d in domains:
        any_of = any_of | (host == d) | host.endswith("." + d)
    return any_of


def hrefs(page: Column) -> Column:
    return F.regexp_extract_all(or_empty(page), F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), F.lit(1))


def apply_link(description: Column) -> Column:
    """The first link to an application system, else the first to any host that is not among the others; null for none."""
    links = F.filter(F.transform(hrefs(description), strip), lambda h: h.rlike("^https?://") & host_of(h).isNotNull() & ~under(host_of(h), OTHER_HOSTS))
    return F.coalesce(F.get(F.filter(links, lambda h: under(host_of(h), APPLY_HOSTS)), F.lit(0)), F.get(links, F.lit(0)))


def first_url(text: Column) -> Column:
    return F.regexp_substr(text, F.lit("https?://[^\\s<>\"']+"))


def board_of(text: Column) -> Column:
    """struct(source, slug) of a pasted address; null for what is not recognised."""
    raw = strip(or_empty(text))
    url = F.when(F.contains(raw, F.lit("//")), raw).otherwise(F.concat(F.lit("https://"), raw))
    host = host_of(url)
    parts = F.filter(F.split(F.regexp_extract(url, r"^[^/]*//[^/?#]*(/[^?#]*)?", 1), "/"), lambda p: p != "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    first = F.get(parts, F.lit(0))
    labels = F.split(host, r"\.")
    embedded = F.nullif(F.lower(F.regexp_extract(query, "(?:^|&)for=([^&]+)", 1)), F.lit(""))
    versioned = (first == "v1") & (F.get(parts, F.lit(1)) == "boards") & (F.size(parts) >= 3)
    tenant, region = F.get(labels, F.lit(0)), F.get(labels, F.lit(1))
    direct = (first == "wday") & (F.get(parts, F.lit(1)) == "cxs") & (F.size(parts) >= 4)
    site = F.get(F.filter(parts, lambda p: ~p.rlike(LOCALE)), F.lit(0))
    packed = F.when(direct, F.concat_ws("|", F.get(parts, F.lit(2)), region, F.get(parts, F.lit(3)))).when(site.isNotNull(), F.concat_ws("|", tenant, region, site))
    made = lambda source, slug: F.when(slug.isNotNull(), F.struct(F.lit(source).alias("source"), slug.alias("slug")))
    greenhouse = F.when(versioned, F.lower(F.get(parts, F.lit(2)))).when(first == "embed", embedded).otherwise(F.lower(first))
    return (
        F.when(host.isNull() | ~F.contains(host, F.lit(".")), F.lit(None))
        .when(host.endswith("greenhouse.io"), made("greenhouse", greenhouse))
        .when(host.endswith("lever.co"), made("lever", F.lower(first)))
        .when(host.endswith("ashbyhq.com"), made("ashby", first))
        .when(host.endswith("workable.com"), made("workable", F.lower(first)))
        .when(host.endswith("smartrecruiters.com"), made("smartrecruiters", first))
        .when(host.endswith("jibeapply.com"), made("jibe", F.nullif(tenant, F.lit(""))))
        .when(host.endswith("myworkdayjobs.com") & (F.size(labels) >= 4), made("workday", packed))
    )


def looks_like_url(text: Column) -> Column:
    bare = strip(or_empty(text))
    return bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://") | bare.rlike(r"^[^\s/]+\.[A-Za-z]{2,}(?:/|$)")


def company_from_host(host: Column) -> Column:
    """The first label that is neither the ending, nor noise, nor a data centre's; else the host itself."""
    labels = F.filter(F.split(host, r"\."), lambda p: p != "")
    told = F.filter(F.slice(labels, F.lit(1), F.greatest(F.lit(0), F.size(labels) - 1)), lambda p: ~p.isin(*HOST_NOISE) & ~p.rlike(r"^[a-z]{2}\d+$"))
    return F.coalesce(title_case(F.replace(F.get(told, F.lit(0)), F.lit("-"), F.lit(" "))), host)


def is_valid_slug(source: Column, slug: Column) -> Column:
    """Packed slugs have their parts; all others are fine."""
    parts = F.split(slug, r"\|")
    filled = lambda a: F.forall(a, lambda p: F.trim(p) != "")
    return F.when(source == "workday", (F.size(parts) == 3) & F.forall(parts, lambda p: p != "")).when(source == "oracle", (F.size(parts) >= 3) & filled(F.slice(parts, 1, 3))).otherwise(F.lit(True))


def board_exists(source: Column, ok: Column, jobs: Column) -> Column:
    return F.coalesce(ok & (source.isin(*PROVEN) | (F.coalesce(jobs, F.lit(0)) > 0)), F.lit(False))


def name_words(name: Column) -> Column:
    return F.regexp_extract_all(or_empty(name), F.lit("([A-Za-z0-9]+)"), F.lit(1))


def company_keys(name: Column) -> Column:
    """The keys under which a company's boards may be stored."""
    return F.array_distinct(F.filter(F.array(F.lower(F.array_join(name_words(name), "")), normal_company(name)), lambda k: k != ""))


def slug_spellings(name: Column, keep_case: bool = False) -> Column:
    """Joined, hyphenated and without legal suffix, in this order; none for a name without letters and digits."""
    words = name_words(name)
    made = F.array(F.array_join(words, ""), F.array_join(words, "-"), normal_company(name))
    made = made if keep_case else F.transform(made, F.lower)
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(made, lambda s: s != "")))


def slug_key(slug: Column) -> Column:
    return F.regexp_replace(F.lower(F.substring_index(slug, "|", 1)), "[^a-z0-9]+", "")


def by_name(names: DataFrame, boards: DataFrame) -> DataFrame:
    """names (name) with the first board (id) whose slug's key is among the company's."""
    keys = names.select("name", F.explode(company_keys(F.col("name"))).alias("key"))
    stored = boards.select("id", "source", "slug", slug_key(F.col("slug")).alias("key"))
    return keys.join(stored, "key").groupBy("name").agg(F.min_by(F.struct("id", "source", "slug"), "id").alias("board")).select("name", "board.*")


def candidates(feed: DataFrame, url: str = "url") -> DataFrame:
    """source, slug, place of the slugs in a feed's addresses, noise left out; place is the order in which they are met."""
    found = []
    for source, (pattern, noise) in SLUG_IN_URL.items():
        slug = F.col("slug") if source in CASE_KEPT else F.lower("slug")
        hits = feed.select(F.col("place"), F.posexplode(F.regexp_extract_all(or_empty(F.col(url)), F.lit(pattern), F.lit(1))).alias("k", "slug"))
        found.append(hits.select(F.lit(source).alias("source"), slug.alias("slug"), F.struct("place", "k").alias("place")).where(~F.col("slug").rlike(noise)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def preferred_spelling(found: DataFrame) -> DataFrame:
    """source, slug: one spelling for each slug whatever its case, the first that is not all small letters, else the first."""
    small = F.col("slug") == F.lower("slug")
    return found.groupBy("source", F.lower("slug").alias("key")).agg(F.min_by("slug", F.struct(small, "place")).alias("slug")).select("source", "slug")


def discovered(found: DataFrame, stored: DataFrame) -> DataFrame:
    """source, slug of candidates that are not stored; without regard to case where two spellings are one board."""
    key = lambda df: F.when(df["source"].isin(*CASE_BLIND), F.lower(df["slug"])).otherwise(df["slug"])
    seen = stored.select(F.col("source").alias("_source"), key(stored).alias("_key")).distinct()
    new = found.join(seen, (found["source"] == seen["_source"]) & (key(found) == seen["_key"]), "left_anti")
    return new.select("source", "slug").distinct().orderBy("source", "slug")


def reverified(boards: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """boards after results (source, slug, ok, job_count, error): counts and errors taken over, boards that are gone disabled, others untouched."""
    new = results.select(F.col("source").alias("_s"), F.col("slug").alias("_g"), F.col("ok").alias("_ok"), F.col("job_count").alias("_n"), F.col("error").alias("_e"))
    joined = boards.join(new, (F.col("source") == F.col("_s")) & (F.col("slug") == F.col("_g")), "left")
    seen = F.col("_s").isNotNull()
    return joined.withColumns(
        {
            "last_job_count": F.when(seen & F.col("_ok"), F.col("_n")).otherwise(F.col("last_job_count")),
            "last_error": F.when(seen, F.col("_e")).otherwise(F.col("last_error")),
            "last_fetched_at": F.when(seen, now).otherwise(F.col("last_fetched_at")),
            "enabled": F.when(seen & ~F.col("_ok"), F.lit(False)).otherwise(F.col("enabled")),
        }
    ).drop("_s", "_g", "_ok", "_n", "_e")


def first_by_source(found: DataFrame) -> DataFrame:
    """Of each name and source the first spelling that exists, in the order of preference."""
    rank = F.row_number().over(Window.partitionBy("name", "source").orderBy("place"))
    order = F.array_position(F.array(*map(F.lit, PROBED)), F.col("source"))
    return found.withColumn("_rank", rank).where("_rank = 1").drop("_rank").withColumn("preference", order).orderBy("name", "preference")


def probes(names: DataFrame, verified: DataFrame) -> DataFrame:
    """name, source, slug, job_count: spellings of names that verification (source, slug, ok, job_count) shows to exist."""
    spelt = None
    for source in PROBED:
        part = names.select("name", F.lit(source).alias("source"), F.posexplode(slug_spellings(F.col("name"), source in CASE_KEPT)).alias("place", "slug"))
        spelt = part if spelt is None else spelt.unionByName(part)
    hits = spelt.join(verified, ["source", "slug"]).where(board_exists(F.col("source"), F.col("ok"), F.col("job_count")))
    return first_by_source(hits).select("name", "source", "slug", "job_count")


def seeded(stored: DataFrame, seeds: DataFrame) -> DataFrame:
    """Valid seeds (source, slug) of sources that have no row yet."""
    return seeds.where(is_valid_slug(F.col("source"), F.col("slug"))).join(stored.select("source").distinct(), "source", "left_anti")


def shown_name(label: Column, slug: Column) -> Column:
    return either(label, F.substring_index(slug, "|", 1))
