"""Changes of stored state: every change is a projection or a full join over snapshots, or an appended log with a latest view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.functions.dates import followup_default, shifted

#: Statuses that a new draft leaves as they are.
BEYOND_DRAFT = ["applied", "screening", "interviewing", "rejected"]
ARCHIVE_BELOW = 60


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last entry of each key."""
    rest = [c for c in log.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")
    return log.groupBy(*key).agg(best).select(*key, *[F.col(f"_x.{c}").alias(c) for c in rest])


def first_running(log: DataFrame, kind: str, order: str) -> DataFrame:
    """Of each kind the task that has run longest."""
    return log.where("status = 'running'").groupBy(kind).agg(F.min_by("task_id", order).alias("task_id"))


def history(log: DataFrame, key: str, order: list[str], score: str = "score") -> DataFrame:
    """log with version (1: the current score), previous score and change against it."""
    window = Window.partitionBy(key)
    back = window.orderBy(*[F.desc(c) for c in order])
    prior = F.lag(score).over(window.orderBy(*order))
    return log.withColumns({"version": F.row_number().over(back), "previous": prior, "change": F.col(score) - prior})


def upserted(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """stored with the non-null values of changes put over it, and rows for new keys; columns are stored's.

    changes has one row for each key at most.
    """
    shared = [c for c in stored.columns if c != key and c in changes.columns]
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in shared])
    joined = stored.join(new, stored[key] == new["_key"], "full")
    value = lambda c: F.coalesce(f"_new_{c}", c).alias(c) if c in shared else F.col(c)
    return joined.select(*[F.coalesce(key, "_key").alias(key) if c == key else value(c) for c in stored.columns])


def checked(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """ids, or an error if one is unknown: a bulk change takes all or none."""
    missing = ids.join(known.select(key).distinct(), key, "left_anti").select(key).limit(5).collect()
    if missing:
        raise ValueError(f"unknown {key}: {[r[0] for r in missing]}")
    return ids


def moved(applications: DataFrame, status: Column, now: Column, next_followup: Column | None = None, last_contact: Column | None = None, outcome: Column | None = None) -> DataFrame:
    """applications in a new status (null: unchanged). The first move to applied sets applied_at, and a follow-up a week later if none is set or given."""
    none = F.lit(None)
    to = F.coalesce(status, F.col("status"))
    enters = F.coalesce(status == "applied", F.lit(False))
    applied = F.when(enters, F.coalesce("applied_at", now)).otherwise(F.col("applied_at"))
    given = next_followup if next_followup is not None else none.cast("timestamp")
    default = F.when(enters, followup_default(applied))
    return applications.withColumns(
        {
            "status": to,
            "applied_at": applied,
            "next_followup_at": F.coalesce(given, F.col("next_followup_at"), default),
            "last_contact_at": F.coalesce(last_contact if last_contact is not None else none.cast("timestamp"), F.col("last_contact_at")),
            "outcome": F.coalesce(outcome if outcome is not None else none.cast("string"), F.col("outcome")),
            "updated_at": now,
        }
    )


def adopted(scores: DataFrame, resume: int) -> DataFrame:
    """Scores of other resumes put to this one; tailored scores (no resume) stay."""
    return scores.withColumn("resume_id", F.when(F.col("resume_id").isNotNull(), F.lit(resume).cast(dict(scores.dtypes)["resume_id"])))


def unemployment_marked(applications: DataFrame, ids: DataFrame, used: bool, now: Column) -> DataFrame:
    """Marked or cleared for the jobs of ids (job_id), with a new application where there is none."""
    flags = ids.select(F.col("job_id").alias("_job"))
    joined = applications.join(flags, applications["job_id"] == flags["_job"], "full")
    hit = F.col("_job").isNotNull()
    return joined.withColumns(
        {
            "job_id": F.coalesce("job_id", "_job"),
            "status": F.coalesce("status", F.lit("new")),
            "used_for_unemployment": F.when(hit, F.lit(used)).otherwise(F.coalesce("used_for_unemployment", F.lit(False))),
            "used_for_unemployment_at": F.when(hit, now if used else F.lit(None).cast("timestamp")).otherwise(F.col("used_for_unemployment_at")),
        }
    ).drop("_job")


def blocked(companies: DataFrame, company: int, flag: bool = True) -> DataFrame:
    return companies.withColumn("is_blocked", F.when(F.col("id") == company, F.lit(flag)).otherwise(F.col("is_blocked")))


def listed_names(blacklist: DataFrame, added: DataFrame, key: Column) -> DataFrame:
    """blacklist with new names appended, one for each key; keys under two letters are refused, known ones change nothing."""
    new = added.withColumn("key", key).where(F.length("key") >= 2).dropDuplicates(["key"])
    return blacklist.unionByName(new.join(blacklist.select("key"), "key", "left_anti").select(*blacklist.columns))


def unlisted(blacklist: DataFrame, removed: DataFrame, key: Column) -> DataFrame:
    """blacklist without the names of removed, by their keys; unknown ones change nothing."""
    return blacklist.join(removed.select(key.alias("key")).distinct(), "key", "left_anti")


def guarded(names: DataFrame, blacklist: DataFrame, keys: Column) -> DataFrame:
    """names with refused: one of a name's keys (an array) is on the blacklist (key)."""
    exploded = names.select("name", F.explode(keys).alias("key")).join(blacklist.select("key").distinct(), "key", "left_semi")
    hit = exploded.select(F.col("name").alias("_name")).distinct().withColumn("refused", F.lit(True))
    return names.join(hit, names["name"] == hit["_name"], "left").drop("_name").withColumn("refused", F.coalesce("refused", F.lit(False)))


def watched(boards: DataFrame, added: DataFrame, now: Column) -> DataFrame:
    """boards (source, slug, added_by, label, added_at, enabled) with the user's new ones; of boards that are there already the row stays, enabled again."""
    key = ["source", "slug"]
    again = added.select(*key).distinct().withColumn("_again", F.lit(True))
    kept = boards.join(again, key, "left").withColumn("enabled", F.col("enabled") | F.coalesce("_again", F.lit(False))).select(*boards.columns)
    new = added.dropDuplicates(key).join(boards.select(*key), key, "left_anti").withColumns({"added_by": F.lit("user"), "added_at": now, "enabled": F.lit(True)})
    return kept.unionByName(new.select(*boards.columns))


def unwatched(boards: DataFrame, removed: DataFrame) -> DataFrame:
    """boards without those of removed (source, slug) that a user added; seeds and found boards stay."""
    gone = removed.select("source", "slug").distinct().withColumn("_gone", F.lit(True))
    return boards.join(gone, ["source", "slug"], "left").where(~(F.coalesce("_gone", F.lit(False)) & (F.col("added_by") == "user"))).select(*boards.columns)


def patched(applications: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """applications (job_id, ...) with the values of changes that are not null. A change of a job without an application does nothing."""
    shared = [c for c in changes.columns if c != "job_id"]
    new = changes.select(F.col("job_id").alias("_job"), *[F.col(c).alias(f"_new_{c}") for c in shared])
    joined = applications.join(new, applications["job_id"] == new["_job"], "left")
    values = {c: F.coalesce(f"_new_{c}", c) for c in shared} | {"updated_at": F.when(F.col("_job").isNotNull(), now).otherwise(F.col("updated_at"))}
    return joined.withColumns(values).select(*applications.columns)


def followed_up(applications: DataFrame, actions: DataFrame, now: Column, week: int = 7) -> DataFrame:
    """applications after actions (job_id, action, days, at): a snooze moves the follow-up days on (null or 0: a week), a contact is noted and moves it a
    week on. Of several actions of a job the last (by at) moves it, and any contact is noted. Other actions do nothing."""
    wait = F.when(F.col("action") == "snooze", F.coalesce(F.nullif("days", F.lit(0)), F.lit(week))).otherwise(week).cast("int")
    known = actions.where(F.col("action").isin("snooze", "contacted")).withColumn("_wait", wait)
    last = known.groupBy("job_id").agg(F.max(F.struct("at", "_wait")).alias("_last"), F.bool_or(F.col("action") == "contacted").alias("_met"))
    return patched(applications, last.select("job_id", F.when(F.col("_met"), now).alias("last_contact_at"), shifted(now, F.col("_last._wait")).alias("next_followup_at")), now)


def with_score(log: DataFrame, scores: DataFrame, active_resume: int | None) -> DataFrame:
    """The log with new scores (job_id, score, kind, at) appended: a baseline score carries the active resume, a tailored one none."""
    resume = F.when(F.col("kind") == "baseline", F.lit(active_resume)).cast("long")
    return log.unionByName(scores.withColumn("resume_id", resume).select(*log.columns))


def with_statuses(postings: DataFrame, applications: DataFrame) -> DataFrame:
    """postings with status: that of their application (job_id, status), null without one."""
    own = applications.select(F.col("job_id").alias("_job"), "status")
    return postings.join(own, postings["id"] == own["_job"], "left").drop("_job")


def prune_stats(pruned_rows: DataFrame) -> DataFrame:
    """scanned, lightened, bytes_freed of what `pruned` returns."""
    return pruned_rows.agg(F.count("*").alias("scanned"), F.count_if(F.col("bytes_freed") > 0).alias("lightened"), F.coalesce(F.sum("bytes_freed"), F.lit(0)).cast("long").alias("bytes_freed"))


def backfill_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """fingerprinted, flagged: rows (id, jd_fingerprint, duplicate_of) that a backfill gave a fingerprint or a link."""
    old = before.select("id", F.col("jd_fingerprint").alias("_print"), F.col("duplicate_of").alias("_dup"))
    rows = after.join(old, "id")
    return rows.agg(F.count_if(F.col("jd_fingerprint").isNotNull() & F.col("_print").isNull()).alias("fingerprinted"), F.count_if(F.col("duplicate_of").isNotNull() & F.col("_dup").isNull()).alias("flagged"))


def prunable(status: Column, posted: Column, ingested: Column, now: Column, posted_days: int = 30, ingested_days: int = 14) -> Column:
    """Archived or rejected; or posted too long ago; or ingested too long ago and not applied to."""
    before = lambda c, days: F.coalesce(c < now - F.make_interval(days=F.lit(days)), F.lit(False))
    closed = F.coalesce(status.isin("archived", "rejected"), F.lit(False))
    return closed | before(posted, posted_days) | (before(ingested, ingested_days) & ~status.eqNullSafe(F.lit("applied")))


def pruned(postings: DataFrame, prune: Column, fingerprint: Column) -> DataFrame:
    """postings with the heavy columns emptied where prune holds, fingerprinted first; bytes_freed tells what went."""
    heavy = F.length(F.coalesce("description", F.lit(""))) + F.length(F.coalesce("raw", F.lit("")))
    goes = prune & (heavy > 0)
    return postings.withColumns(
        {
            "jd_fingerprint": F.when(goes, F.coalesce("jd_fingerprint", fingerprint)).otherwise(F.col("jd_fingerprint")),
            "bytes_freed": F.when(goes, heavy).otherwise(0).cast("long"),
            "description": F.when(goes, "").otherwise(F.col("description")),
            "raw": F.when(goes, "").otherwise(F.col("raw")),
        }
    )


def drafted(status: Column) -> Column:
    """The status after a draft: drafted, unless the application is further on."""
    return F.when(status.isin(*BEYOND_DRAFT), status).otherwise(F.lit("drafted"))


def to_archive(score: Column, status: Column) -> Column:
    """A low score archives what nobody has looked at."""
    return F.coalesce(score < ARCHIVE_BELOW, F.lit(False)) & (F.coalesce(status, F.lit("new")) == "new")


def resume_activated(resumes: DataFrame, new_id: int) -> DataFrame:
    return resumes.withColumn("is_active", F.col("id") == new_id)


def migrated(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """rows with columns that older snapshots lack, and defaults where they are null."""
    return rows.withColumns({c: F.coalesce(F.col(c), d) if c in rows.columns else d for c, d in defaults.items()})


def setting(settings: DataFrame, key: str, value: str) -> DataFrame:
    """The key-value table with one value set."""
    new = settings.sparkSession.createDataFrame([(key, value)], "key string, value string")
    return settings.where(F.col("key") != key).unionByName(new)


def known_ids(asked: DataFrame, key: str, ids: str, known: DataFrame) -> DataFrame:
    """key, ids: the ids of each list that are known (id), each once, at its first place; lists of unknown ids alone go. A list is small: what a caller asks for at once."""
    each = asked.select(key, F.posexplode(F.array_distinct(ids)).alias("place", "id")).join(known.select("id").distinct(), "id", "left_semi")
    return each.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias(ids))
