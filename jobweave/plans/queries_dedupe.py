"""Keys, fingerprints and removal of repeats."""

from pyspark.sql import functions as F

from jobweave.functions.hashes import cross_key, has_simhash, simhash, simhash_md5, source_key
from jobweave.functions.text import COMPANY_SUFFIXES, TITLE_NOISE, cross_title, normal_company, normal_title
from jobweave.operators import dedupe
from jobweave.operators.lineage import cut_lineage, spread
from jobweave.plans.binding import POSTINGS, postings, table
from jobweave.plans.registry import query

SUFFIX = rf"(?i)[,\s]+({COMPANY_SUFFIXES})\.?$"
COMPANY = f"regexp_replace(lower(regexp_replace(trim(company_name), '{SUFFIX}', '')), '[^a-z0-9]+', '', 'g')"
PART = "[^,\\-–—]{1,40}"
STRIPPED = f"regexp_replace(title, '\\s*[\\-–—]\\s*{PART},\\s*{PART}(?:,\\s*{PART})?\\s*$', '')"
# The titles' own locations have no pattern characters but full stops and parentheses, which these tables lack.
OWN = f"CASE WHEN coalesce(location, '') <> '' AND regexp_matches(title, '(?i)\\s*[\\-–—]\\s*' || location || '\\s*$') THEN regexp_replace(title, '(?i)\\s*[\\-–—]\\s*' || location || '\\s*$', '') ELSE {STRIPPED} END"
TITLE = f"trim(regexp_replace(lower({OWN}), '\\s+', ' ', 'g'))"
NOISE = rf"(?i)\b({TITLE_NOISE})\b"
SPELT = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({OWN}), '\\bsr\\.?\\b', 'senior', 'g'), '\\bjr\\.?\\b', 'junior', 'g'), '\\beng\\.?\\b', 'engineer', 'g'), '\\bdev\\.?\\b', 'developer', 'g')"
CROSS = f"regexp_replace(regexp_replace({SPELT}, '{NOISE}', '', 'g'), '[^a-z0-9]+', '', 'g')"


@query(f"SELECT id, {COMPANY} AS company, {TITLE} AS title, {CROSS} AS cross_title FROM ({POSTINGS})")
def normal_names(spark, sf_dir):
    t, place = F.col("title"), F.col("location")
    return postings(spark, sf_dir).select("id", normal_company(F.col("company_name")).alias("company"), normal_title(t, place).alias("title"), cross_title(t, place).alias("cross_title"))


@query(
    f"""SELECT id, sha256(source || '|' || source_id) AS dedupe_hash, CASE WHEN length({COMPANY}) >= 2 AND length({CROSS}) >= 4 THEN sha256({COMPANY} || '|' || {CROSS}) END AS cross_source_hash FROM ({POSTINGS})"""
)
def sha_keys(spark, sf_dir):
    keys = source_key(F.col("source"), F.col("source_id")).alias("dedupe_hash")
    return postings(spark, sf_dir).select("id", keys, cross_key(F.col("company_name"), F.col("title"), F.col("location")).alias("cross_source_hash"))


GREEDY = """
WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY p_partkey) AS k, p_partkey AS id, p_brand || '/' || (p_partkey % 60) AS h, CASE WHEN p_partkey % 9 <> 0 THEN p_name || p_type END AS g FROM part),
s(k, hs, gs, ok) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], false
  UNION ALL SELECT r.k, CASE WHEN a.ok THEN list_append(hs, h) ELSE hs END, CASE WHEN a.ok AND g IS NOT NULL THEN list_append(gs, g) ELSE gs END, a.ok
  FROM s JOIN r ON r.k = s.k + 1, LATERAL (SELECT NOT list_contains(hs, h) AND NOT coalesce(list_contains(gs, g), false) AS ok) a)
SELECT id FROM s JOIN r USING (k) WHERE ok"""


@query(GREEDY)
def greedy_dedupe(spark, sf_dir):
    k = F.col("p_partkey")
    h, g = F.concat("p_brand", F.lit("/"), F.pmod(k, F.lit(60)).cast("string")), F.when(F.pmod(k, F.lit(9)) != 0, F.concat("p_name", "p_type"))
    rows = table(spark, sf_dir, "part").select(k.alias("id"), h.alias("h"), g.alias("g"))
    return dedupe.first_wins(rows, ["h", "g"], "id").select("id")


@query(
    """SELECT p_partkey, r = 1 AS keeper, r > 1 AND NOT a AS archive FROM (SELECT p_partkey, p_size > 40 AS a, row_number() OVER (PARTITION BY p_brand, lower(trim(p_name)) ORDER BY p_size > 40, p_partkey) AS r FROM part)"""
)
def dup_groups_keeper(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumns({"title": normal_title(F.col("p_name")), "archived": F.col("p_size") > 40})
    return dedupe.keepers(rows, ["p_brand", "title"], "archived", "p_partkey").select("p_partkey", "keeper", "archive")


@query("SELECT p_brand, lower(trim(p_name)) AS title, p_partkey, count(*) OVER (PARTITION BY p_brand, lower(trim(p_name))) AS n FROM part QUALIFY n > 1")
def dup_groups(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("title", normal_title(F.col("p_name")))
    return dedupe.groups(rows, ["p_brand", "title"], "p_partkey").select("p_brand", "title", "p_partkey", "n")


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) = 1 THEN sha256(coalesce(text, '')) END AS hash FROM documents")
def first_hash_only(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    return dedupe.first_only(rows, "hash", "doc_id")


@query("SELECT s_suppkey FROM supplier WHERE lower('Customer' || substr(s_name, 9)) NOT IN (SELECT lower(c_name) FROM customer WHERE c_acctbal > 0)")
def hash_anti_lookup(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Customer"), F.expr("substr(s_name, 9)")).alias("name"))
    old = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_name").alias("name"))
    return dedupe.new_members(own, old, F.lower, "name").select("s_suppkey")


# Words of the cleaned text, shingle by shingle, and a vote of the bits of their digests.
DIGESTS = """
WITH clean AS (SELECT doc_id AS id, lower(regexp_replace(coalesce(text, ''), '<[^>]+>', ' ', 'g')) AS t FROM documents),
tokens AS (SELECT id, length(t) AS n, regexp_extract_all(t, '[a-z0-9]+') AS w FROM clean),
grams AS (SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda i: md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS m FROM tokens WHERE n >= 200 AND len(w) >= 3),
halves AS (SELECT id, ('0x' || substr(m, 1, 8))::BIGINT AS a, ('0x' || substr(m, 9, 8))::BIGINT AS b FROM grams),
votes AS (SELECT id, count(*) AS n, [{a}] AS va, [{b}] AS vb FROM halves GROUP BY id),
prints AS (SELECT id, lpad(lower(to_hex(list_sum(list_transform(va, lambda v, i: CASE WHEN 2 * v > n THEN (1::BIGINT << (32 - i::INTEGER)) ELSE 0 END))::BIGINT)), 8, '0')
  || lpad(lower(to_hex(list_sum(list_transform(vb, lambda v, i: CASE WHEN 2 * v > n THEN (1::BIGINT << (32 - i::INTEGER)) ELSE 0 END))::BIGINT)), 8, '0') AS print FROM votes)
""".replace("{a}", ", ".join(f"sum((a >> {31 - k}) & 1)" for k in range(32))).replace("{b}", ", ".join(f"sum((b >> {31 - k}) & 1)" for k in range(32)))


@query(f"{DIGESTS} SELECT id, print FROM prints")
def simhash_in_sql(spark, sf_dir):
    return simhash_md5(spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")), "id", F.col("text"))


@query()
def simhash_exact(spark, sf_dir):
    """The fingerprint over BLAKE2b, which the other engine lacks; tests compare it with a plain loop."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).where(has_simhash(F.col("text"))).select(F.col("doc_id").alias("id"), simhash("text").alias("print"))


def prints(spark, sf_dir):
    return cut_lineage(simhash_in_sql(spark, sf_dir))


HALF = "('0x' || substr({}.print, {}, 8))::BIGINT"
DISTANCE = " + ".join(f"bit_count(xor({HALF.format('a', k)}, {HALF.format('b', k)}))" for k in (1, 9))


@query(f"{DIGESTS}, p AS (SELECT DISTINCT print FROM prints) SELECT a.print AS print_a, b.print AS print_b FROM p a JOIN p b ON a.print < b.print WHERE {DISTANCE} <= 3")
def hamming_pairs(spark, sf_dir):
    return dedupe.near_pairs(prints(spark, sf_dir))


@query(
    f"""{DIGESTS.replace('WITH clean', 'WITH RECURSIVE clean')}, d AS (SELECT id, print, DATE '2000-01-01' + (id % 60)::INTEGER AS at FROM prints),
    first AS (SELECT a.id, arg_min(b.id, (b.at, b.id)) AS parent FROM d a JOIN d b ON (b.at, b.id) < (a.at, a.id) AND a.at - b.at <= 30 AND {DISTANCE} <= 3 GROUP BY a.id),
    up(id, root) AS (SELECT id, parent FROM first UNION ALL SELECT up.id, f.parent FROM up JOIN first f ON f.id = up.root)
    SELECT id, root FROM up WHERE root NOT IN (SELECT id FROM first)"""
)
def near_dup_canonical(spark, sf_dir):
    at = F.date_add(F.lit("2000-01-01").cast("date"), F.pmod("id", F.lit(60)).cast("int"))
    return dedupe.canonical(dedupe.near_links(prints(spark, sf_dir).withColumn("at", at)))
