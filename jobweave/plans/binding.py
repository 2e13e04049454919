"""Binds operators to the star-schema tables: postings made of parts, applications made of orders, task logs made of events.

Each binding exists as a DataFrame and as SQL over the same tables, so that queries can be compared with another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = [
    "Senior Software Engineer",
    "Staff Engineer (hybrid)",
    "Senior Sales Engineer",
    "Head of Partnerships",
    "Junior Developer",
    "Lead Angular Developer",
    "Principal Architect - Austin, TX",
    "Sr. Backend Eng (Remote)",
    "Director of Engineering",
    "VP Product",
    "Senior Software Engineer - Berlin, Germany",
]
LOCATIONS = ["Remote, US", "London", "Austin, TX", "Remote", None, "Toronto, ON", "US-East", "Berlin, Germany", "Remote - United States"]
DESCRIPTIONS = [
    "We build with React and Node.js in a small team.",
    "Some js and ts experience is welcome.",
    "A blockchain company that writes Solidity.",
    "We are currently hiring in Texas and Ohio only. Our stack is TypeScript.",
    "Python and Go services, no front end.",
    "Our legacy app is Angular; new work is also Angular.",
    "<p>Vue &amp; Svelte</p><p>Work from home.</p>",
    "You must reside in Missouri or Kansas. We use react.",
    "We employ employees in any US state, Texas included; we use Express.",
]
COMPANIES = ["Acme Corp", "Acme, Inc.", "ACME", "Blue-Sky Labs GmbH", "Nova S.A.", "Q", "Orbit Ltd", "Orbit Limited"]
TAGS = [["angular", "typescript"], ["angular", "react"], ["go"], [], ["Vue"], ["node"]]
NOW = "2000-06-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_of(options: list, number: Column) -> Column:
    literal = lambda o: F.array(*map(F.lit, o)).cast("array<string>") if isinstance(o, list) else F.lit(o)
    return F.get(F.array(*map(literal, options)), F.pmod(number, F.lit(len(options))).cast("int"))


def sql_text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, list):
        return "[" + ", ".join(map(sql_text, value)) + "]::VARCHAR[]"
    return "'" + str(value).replace("'", "''") + "'"


def sql_one_of(options: list, number: str) -> str:
    return f"([{', '.join(map(sql_text, options))}])[1 + (({number}) % {len(options)})]"


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, source, source_id, url, title, company_name, description, location, remote, tags, posted_at, ingested_at from part."""
    k = F.col("p_partkey")
    day = lambda n: F.lit("2000-01-01").cast("date") + F.pmod(k * n, F.lit(150)).cast("int")
    return table(spark, sf_dir, "part").select(
        k.alias("id"),
        F.concat(F.lit("s"), F.pmod(k, F.lit(3)).cast("string")).alias("source"),
        F.pmod(k * 7, F.lit(1501)).cast("string").alias("source_id"),
        F.concat(F.lit("https://example.org/"), k.cast("string")).alias("url"),
        F.concat_ws(" ", one_of(TITLES, k), F.when(F.pmod(k, F.lit(4)) == 0, F.col("p_name"))).alias("title"),
        one_of(COMPANIES, F.floor(k / 5)).alias("company_name"),
        one_of(DESCRIPTIONS, k + F.col("p_size")).alias("description"),
        one_of(LOCATIONS, F.col("p_size")).alias("location"),
        (F.pmod(k, F.lit(13)) != 0).alias("remote"),
        one_of(TAGS, k + F.col("p_size") * 3).alias("tags"),
        day(11).alias("posted_at"),
        day(17).alias("ingested_at"),
    )


POSTINGS = f"""
SELECT p_partkey AS id, 's' || (p_partkey % 3) AS source, ((p_partkey * 7) % 1501)::VARCHAR AS source_id, 'https://example.org/' || p_partkey AS url,
  {sql_one_of(TITLES, 'p_partkey')} || CASE WHEN p_partkey % 4 = 0 THEN ' ' || p_name ELSE '' END AS title,
  {sql_one_of(COMPANIES, 'p_partkey // 5')} AS company_name, {sql_one_of(DESCRIPTIONS, 'p_partkey + p_size')} AS description,
  {sql_one_of(LOCATIONS, 'p_size')} AS location, p_partkey % 13 <> 0 AS remote, {sql_one_of(TAGS, 'p_partkey + p_size * 3')} AS tags,
  DATE '2000-01-01' + ((p_partkey * 11) % 150)::INTEGER AS posted_at, DATE '2000-01-01' + ((p_partkey * 17) % 150)::INTEGER AS ingested_at
FROM part"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with score, status and follow-up from orders: id, company_id, source, title, score, status, ease, filter_status, duplicate_of, ingested_at, next_followup_at, outcome."""
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", None).otherwise(one_of(["new", "applied", "interviewing", "archived", "rejected"], k))
    return table(spark, sf_dir, "orders").select(
        k.alias("id"),
        F.col("o_custkey").alias("company_id"),
        F.col("o_orderpriority").alias("source"),
        F.concat(F.lit("Role "), F.pmod(k * 37, F.lit(1009)).cast("string")).alias("title"),
        F.when(F.pmod(k, F.lit(7)) != 0, F.pmod(F.floor("o_totalprice"), F.lit(101))).cast("long").alias("score"),
        status.alias("status"),
        one_of(["easy", "med", "hard"], k).alias("ease"),
        F.when(F.pmod(k, F.lit(11)) == 0, "manual").otherwise("passed").alias("filter_status"),
        F.when(F.pmod(k, F.lit(17)) == 0, k - 1).alias("duplicate_of"),
        F.col("o_orderdate").cast("date").alias("ingested_at"),
        F.when(F.pmod(k, F.lit(3)) == 0, F.date_add(F.col("o_orderdate").cast("date"), 7)).alias("next_followup_at"),
        F.when(F.pmod(k, F.lit(5)) == 0, "offer").alias("outcome"),
    )


JOBS = f"""
SELECT o_orderkey AS id, o_custkey AS company_id, o_orderpriority AS source, 'Role ' || ((o_orderkey * 37) % 1009) AS title,
  CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice)::BIGINT % 101 END AS score,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE {sql_one_of(['new', 'applied', 'interviewing', 'archived', 'rejected'], 'o_orderkey')} END AS status,
  {sql_one_of(['easy', 'med', 'hard'], 'o_orderkey')} AS ease, CASE WHEN o_orderkey % 11 = 0 THEN 'manual' ELSE 'passed' END AS filter_status,
  CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey - 1 END AS duplicate_of, o_orderdate::DATE AS ingested_at,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE + 7 END AS next_followup_at, CASE WHEN o_orderkey % 5 = 0 THEN 'offer' END AS outcome
FROM orders"""
