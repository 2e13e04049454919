"""Filter rules and their diagnostics over postings made of parts."""

from pyspark.sql import functions as F

from jobweave.operators import listing, rules
from jobweave.plans.binding import POSTINGS, postings, sql_text, table
from jobweave.plans.registry import query

CONFIG = rules.FilterConfig(state="Missouri")


def rx(column: str, pattern: str | None, flags: str = "i") -> str:
    return f"regexp_matches({column}, {sql_text(pattern)}, '{flags}s')" if pattern else "false"


def words(terms: list[str]) -> str | None:
    return rf"\b({rules.alternation(terms)})\b" if terms else None


def cascade_sql(c: rules.FilterConfig, rows_sql: str = POSTINGS) -> str:
    """The rules as a CASE over the postings, in the other engine's dialect."""
    loc, text = "coalesce(location, '')", "title || chr(10) || description || chr(10) || array_to_string(tags, ' ') || chr(10) || coalesce(location, '')"
    home = f"({rx(loc, rules.HOME_COUNTRY)} OR {rx(loc, rules.HOME_CODE, 'c')} OR {rx(loc, rules.HOME_STATE, 'c')})"
    state = r"\b(" + "|".join(r"\s+".join(s.split()) for s in rules.STATES) + r")\b"
    own = rf"\b{c.state}\b"
    window = f"regexp_extract_all({text}, {sql_text('(?is)' + rules.ONLY_IN + '.{0,800}')})"
    restricted = f"NOT {rx('w', rules.NATIONWIDE)} AND {rx('w', state)} AND NOT ({rx('w', own)} OR {rx('w', chr(92) + 'b' + rules.STATES[c.state] + chr(92) + 'b', 'c')})"
    rescue = [t for t in c.competing if t in c.required and t not in c.excluded]
    tags = "list_transform(tags, lambda t: lower(t))"
    rows = [
        ("NOT remote", "dropped", rules.NOT_REMOTE),
        (f"{rx('title', rules.ONSITE)} OR {rx(loc, rules.ONSITE)}", "dropped", rules.IS_ONSITE),
        (f"({rx(loc, rules.ELSEWHERE)} OR {rx(loc, rules.PLACE, 'c')}) AND NOT {home}", "dropped", rules.IS_ELSEWHERE),
        (f"len(list_filter({window}, lambda w: {restricted})) > 0", "dropped", rules.EXCLUDES_STATE.format(c.state)),
        (f"NOT {rx('title', words(c.seniority))}", "dropped", rules.NOT_SENIOR),
        (f"{rx('title', rules.SALES)} OR {rx('title', rules.SALES_HEAD)}", "dropped", rules.IS_SALES),
        (rx(text, rules.CRYPTO), "dropped", rules.IS_CRYPTO),
        (rx("title", words(c.excluded)), "dropped", rules.EXCLUDED_TITLE),
        (f"list_has_any({tags}, {sql_text(c.excluded)}) AND NOT list_has_any({tags}, {sql_text(rescue)})", "dropped", rules.EXCLUDED_STACK),
        (f"NOT {rx(text, words(c.long_terms))} AND NOT {rx(text, words(c.short_terms))}", "dropped", rules.NOT_REQUIRED),
        (f"NOT {rx(text, words(c.long_terms))}", "manual", rules.ONLY_SHORT),
        (f"{rx('description', words(c.excluded))} AND NOT {rx('description', words(c.long_terms))}", "manual", rules.EXCLUDED_MENTION),
    ]
    case = lambda k, end: "CASE " + " ".join(f"WHEN {r[0]} THEN {sql_text(r[k])}" for r in rows) + f" ELSE {end} END"
    return f"SELECT *, {case(1, chr(39) + 'passed' + chr(39))} AS filter_status, {case(2, 'NULL')} AS filter_reason FROM ({rows_sql})"


CASCADE = cascade_sql(CONFIG)


def classified(spark, sf_dir):
    return rules.classified(postings(spark, sf_dir), CONFIG)


@query(f"SELECT filter_status, filter_reason, count(*) AS n FROM ({CASCADE}) GROUP BY ALL")
def filter_cascade_counts(spark, sf_dir):
    return classified(spark, sf_dir).groupBy("filter_status", "filter_reason").agg(F.count("*").alias("n"))


@query(f"SELECT id, filter_status, filter_reason FROM ({CASCADE})")
def filter_cascade(spark, sf_dir):
    return classified(spark, sf_dir).select("id", "filter_status", "filter_reason")


@query(f"SELECT source, filter_status || ':' || coalesce(filter_reason, 'ok') AS bucket, count(*) AS n FROM ({CASCADE}) GROUP BY ALL")
def filter_buckets(spark, sf_dir):
    return listing.bucket_counts(classified(spark, sf_dir), "source")


@query(
    f"SELECT source, count(*) FILTER (filter_status = 'passed') AS passed, count(*) FILTER (filter_status = 'manual') AS manual, count(*) FILTER (filter_status = 'dropped') AS dropped FROM ({CASCADE}) GROUP BY source"
)
def filter_status_pivot(spark, sf_dir):
    return listing.status_pivot(classified(spark, sf_dir), "source")


@query(f"SELECT filter_reason AS reason, count(*) AS n FROM ({CASCADE}) WHERE filter_status = 'dropped' GROUP BY ALL")
def drop_totals(spark, sf_dir):
    return listing.drop_totals(classified(spark, sf_dir))


@query(f"SELECT * FROM (SELECT source, filter_status, row_number() OVER (PARTITION BY source, filter_status ORDER BY id) AS place, id, title FROM ({CASCADE})) WHERE place <= 5")
def filter_samples(spark, sf_dir):
    return listing.samples(classified(spark, sf_dir), ["source", "filter_status"], "id", ["id", "title"])


@query(
    f"SELECT id, NOT {rx('title', words(CONFIG.seniority))} OR {rx('title', rules.SALES)} OR {rx('title', rules.SALES_HEAD)} AS fails, {rx('title', rules.TITLE_GATE)} AS gate FROM ({POSTINGS})"
)
def filter_title_quick_fail(spark, sf_dir):
    return postings(spark, sf_dir).select("id", rules.title_fails(F.col("title"), CONFIG).alias("fails"), rules.passes_gate(F.col("title")).alias("gate"))


@query(
    """SELECT p_partkey, len(list_intersect(t, ['red', 'blue', 'bolt', 'gear'])) AS shared, len(list_filter(t, lambda x: x NOT IN ('bolt', 'gear'))) AS others, list_has_any(t, ['bolt']) AS is_bolt
    FROM (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS t FROM part)"""
)
def tag_algebra(spark, sf_dir):
    tags, some = F.array_distinct(F.split("p_name", " ")), F.array(*map(F.lit, ["red", "blue", "bolt", "gear"]))
    left = F.array_except(tags, F.array(F.lit("bolt"), F.lit("gear")))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.size(F.array_intersect(tags, some)).cast("long").alias("shared"), F.size(left).cast("long").alias("others"), F.arrays_overlap(tags, F.array(F.lit("bolt"))).alias("is_bolt")
    )


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'Missouri' WHEN n_nationkey % 3 = 0 THEN 'New York' END AS state FROM nation")
def home_states(spark, sf_dir):
    k = F.col("n_nationkey")
    typed = F.when(F.pmod(k, F.lit(4)) == 0, " mo").when(F.pmod(k, F.lit(2)) == 0, "MISSOURI").when(F.pmod(k, F.lit(3)) == 0, "new york").otherwise("atlantis")
    return table(spark, sf_dir, "nation").select("n_nationkey", rules.home_state_column(typed).alias("state"))


@query(
    f"""SELECT id, company_name FROM ({POSTINGS}) WHERE regexp_replace(lower(regexp_replace(company_name, '(?i)[,\\s]+(inc|corp|gmbh|s\\.?a\\.?|ltd|limited)\\.?$', '')), '[^a-z0-9]+', '', 'g') NOT IN ('acme', 'nova')"""
)
def blacklist_anti(spark, sf_dir):
    from jobweave.functions.text import normal_company

    keys = spark.createDataFrame([("Acme LLC",), ("NOVA",)], "name string").select(normal_company(F.col("name")).alias("key"))
    return rules.without_companies(postings(spark, sf_dir), keys, normal_company(F.col("company_name"))).select("id", "company_name")
