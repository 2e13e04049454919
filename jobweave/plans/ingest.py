"""The ingest plan: records in, new postings and outcome counts out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.functions.dates import is_stale
from jobweave.functions.hashes import NEAR, cross_key, simhash, source_key
from jobweave.functions.text import normal_company, normal_title
from jobweave.operators.dedupe import canonical, first_wins, near_links
from jobweave.operators.lineage import cut_lineage, dealt
from jobweave.operators.print_index import PrintIndex
from jobweave.operators.rules import FilterConfig, classified

OUTCOMES = ["dropped_blacklist", "skipped_duplicate", "stale", "dropped_filter", "skipped_cross_source", "inserted"]


@dataclass(frozen=True)
class Ingested:
    rows: DataFrame  # all records, each with its outcome
    new: DataFrame  # the postings to append, with duplicate_of (a stored id) or duplicate_of_ord (one of these)
    companies: DataFrame  # names seen for the first time


def keyed(records: DataFrame, config: FilterConfig | None, now: Column) -> DataFrame:
    """records with the keys and gates of every rule. records: the common record and `ord`, a unique order of arrival."""
    title = F.concat_ws("\x1f", "source", normal_company(F.col("company_name")), normal_title(F.col("title"), F.col("location")))
    return classified(records, config).withColumns(
        {
            "company_key": normal_company(F.col("company_name")),
            "dedupe_hash": source_key(F.col("source"), F.col("source_id")),
            "title_key": title,
            "cross_source_hash": cross_key(F.col("company_name"), F.col("title"), F.col("location")),
            "is_stale": is_stale(F.col("posted_at"), now),
        }
    )


def ingested(records: DataFrame, stored: DataFrame, now: Column, config: FilterConfig | None = None, blacklist: DataFrame | None = None, blocked: DataFrame | None = None, days: int = 14, index: PrintIndex | None = None) -> Ingested:
    """records against the stored postings (id, dedupe_hash, title_key, cross_source_hash, jd_fingerprint, ingested_at, duplicate_of).

    blacklist (key) and blocked (key) hold company keys. A record is accepted in order of arrival unless an earlier accepted or stored one shares its source id,
    its title within company and source, or its cross-source key. Outcomes are told in the order of the rules: blacklist, source id, stale, filter, blocked,
    title, cross-source. Near-duplicate descriptions are linked to the first one of the last `days` days, not dropped. With an index of the stored fingerprints only what lies in
    the new ones' cells is read of them; `remembered` adds the new ones.
    """
    spark = records.sparkSession
    none = spark.createDataFrame([], "key string")
    keys = keyed(dealt(records, "ord"), config, now)
    black = (blacklist if blacklist is not None else none).select(F.col("key").alias("company_key"), F.lit(True).alias("is_blacklisted")).distinct()
    shut = (blocked if blocked is not None else none).select(F.col("key").alias("company_key"), F.lit(True).alias("is_blocked")).distinct()
    flagged = keys.join(black, "company_key", "left").join(shut, "company_key", "left")
    flagged = cut_lineage(flagged.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_blacklisted", "is_blocked")}))
    open_ = flagged.where(~F.col("is_blacklisted") & ~F.col("is_stale") & (F.col("filter_status") != "dropped") & ~F.col("is_blocked"))
    known = {k: stored for k in ("dedupe_hash", "title_key", "cross_source_hash")}
    accepted = cut_lineage(first_wins(open_, list(known), "ord", known))

    def earlier(rows: DataFrame, key: str) -> DataFrame:
        """rows with whether a stored row, or an accepted one before them, has their key."""
        mine = accepted.select(F.col(key).alias("_k"), F.col("ord").cast("long").alias("_o")).unionByName(stored.select(F.col(key).alias("_k"), F.lit(-1).cast("long").alias("_o")))
        first = mine.where("_k is not null").groupBy("_k").agg(F.min("_o").alias("_o"))
        joined = rows.join(first, rows[key] == first["_k"], "left")
        return joined.withColumn(f"had_{key}", F.coalesce(F.col("_o") < F.col("ord"), F.lit(False))).drop("_k", "_o")

    told = flagged
    for key in known:
        told = earlier(told, key)
    outcome = (
        F.when(F.col("is_blacklisted"), "dropped_blacklist")
        .when(F.col("had_dedupe_hash"), "skipped_duplicate")
        .when(F.col("is_stale"), "stale")
        .when((F.col("filter_status") == "dropped") | F.col("is_blocked"), "dropped_filter")
        .when(F.col("had_title_key"), "skipped_duplicate")
        .when(F.col("had_cross_source_hash"), "skipped_cross_source")
        .otherwise("inserted")
    )
    rows = told.withColumn("outcome", outcome).drop(*[f"had_{k}" for k in known])
    new = cut_lineage(accepted.withColumn("jd_fingerprint", simhash("description")))
    since = now - F.make_interval(days=F.lit(days))
    stored_id = lambda c: F.concat(F.lit("s"), F.lpad(c.cast("string"), 20, "0"))
    fresh = new.select(F.concat(F.lit("t"), F.lpad(F.col("ord").cast("string"), 20, "0")).alias("id"), F.col("jd_fingerprint").alias("print"), F.col("ord").cast("long").alias("at"))
    # Stored fingerprints of the window come first, in order of their ids; links end at the stored row's own canonical one.
    hits = index.first_near(fresh.select("print"), since) if index is not None else None
    if index is not None:
        links, old = near_links(fresh, NEAR, None), None
        if hits is not None:
            met = cut_lineage(fresh.join(hits.select("print", stored_id(F.col("root")).alias("parent")), "print").select("id", "parent"))
            links = links.join(met.select("id"), "id", "left_anti").unionByName(met)
    else:
        recent = stored.where(F.col("ingested_at") >= since)
        old = recent.select(stored_id(F.col("id")).alias("id"), F.col("jd_fingerprint").alias("print"), stored_id(F.coalesce("duplicate_of", "id")).alias("root"))
        ordered = old.select("id", "print", F.lit(-1).cast("long").alias("at")).unionByName(fresh).where("print is not null")
        links = near_links(ordered, NEAR, None).where(F.col("id").startswith("t"))
    roots = canonical(links)
    number = lambda c, kind: F.when(c.startswith(kind), F.substring(c, F.lit(2), F.length(c))).cast("long")
    root = F.col("root")
    if old is not None:
        roots = roots.join(old.select(F.col("id").alias("root"), F.col("root").alias("stored_root")), "root", "left")
        root = F.coalesce("stored_root", "root")
    linked = roots.select(F.col("id").alias("_id"), number(root, "s").alias("duplicate_of"), number(root, "t").alias("duplicate_of_ord"))
    own = F.concat(F.lit("t"), F.lpad(F.col("ord").cast("string"), 20, "0"))
    new = new.join(linked, own == linked["_id"], "left").drop("_id")
    names = flagged.where(~F.col("is_blacklisted") & ~F.col("is_stale") & (F.col("filter_status") != "dropped")).select("company_key", "company_name").dropDuplicates(["company_key"])
    return Ingested(rows, new, names)


def remembered(index: PrintIndex, new: DataFrame, batch: str) -> bool:
    """Adds what was stored to the index: new rows with id, jd_fingerprint, ingested_at and duplicate_of, the stored id that their links end at (none: their own)."""
    return index.add(new.select("id", F.col("jd_fingerprint").alias("print"), F.col("ingested_at").alias("at"), F.col("duplicate_of").alias("root")), batch)


def stats(result: Ingested) -> DataFrame:
    """One row of counts: fetched, each outcome, flagged_jd_similar, passed_filter and manual_review of what is inserted."""
    counts = result.rows.agg(F.count("*").alias("fetched"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES])
    more = result.new.agg(
        F.count(F.coalesce("duplicate_of", "duplicate_of_ord")).alias("flagged_jd_similar"), F.count_if(F.col("filter_status") == "passed").alias("passed_filter"), F.count_if(F.col("filter_status") == "manual").alias("manual_review")
    )
    # One row each.
    return counts.crossJoin(more)


def fingerprint_backfill(postings: DataFrame, days: int = 30) -> DataFrame:
    """postings with missing fingerprints filled in, and duplicate_of where an earlier one of the window is near; links that exist stay."""
    filled = cut_lineage(postings.withColumn("jd_fingerprint", F.coalesce("jd_fingerprint", simhash("description"))))
    links = near_links(filled.select("id", F.col("jd_fingerprint").alias("print"), F.col("ingested_at").alias("at")), NEAR, days)
    kept = filled.where("duplicate_of is not null").select("id", F.col("duplicate_of").alias("parent"))
    fresh = links.join(kept.select("id"), "id", "left_anti").unionByName(kept)
    roots = canonical(fresh)
    new = roots.join(kept.select("id"), "id", "left_anti")
    joined = filled.join(new, "id", "left")
    return joined.withColumn("duplicate_of", F.coalesce("duplicate_of", "root")).drop("root")
