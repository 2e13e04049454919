"""The refresh plan: a feed of addresses in, verified boards added, boards that are gone disabled, counts out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.operators.boards import board_exists, candidates, discovered, preferred_spelling, reverified
from jobweave.operators.lineage import cut_lineage

Verifier = Callable[[DataFrame], DataFrame]  # boards (source, slug) -> source, slug, ok, job_count, error


@dataclass(frozen=True)
class Refreshed:
    boards: DataFrame
    stats: DataFrame  # source, candidates, added, reverified, disabled


def inserted(boards: DataFrame, results: DataFrame, now: Column, added_by: str = "refresh") -> DataFrame:
    """boards with a row for each board of results that exists; boards that are stored already stay as they are."""
    new = results.where(board_exists(F.col("source"), F.col("ok"), F.col("job_count"))).dropDuplicates(["source", "slug"]).join(boards.select("source", "slug"), ["source", "slug"], "left_anti")
    columns = {"added_by": F.lit(added_by), "last_job_count": F.col("job_count"), "last_error": F.lit(None).cast("string"), "last_fetched_at": now, "enabled": F.lit(True)}
    return boards.unionByName(new.withColumns(columns).select(*boards.columns))


def refreshed(feed: DataFrame, boards: DataFrame, verify: Verifier, now: Column, reverify: bool = True) -> Refreshed:
    """feed (place, url) against boards (source, slug, added_by, last_job_count, last_error, last_fetched_at, enabled).

    New slugs of the feed are verified and added where they exist; with reverify the enabled boards that were stored before are verified too, and those that are gone are
    disabled. Nothing is deleted.
    """
    found = cut_lineage(preferred_spelling(candidates(feed)))
    new = discovered(found, boards)
    fresh = cut_lineage(verify(new))
    out = inserted(boards, fresh, now)
    old = cut_lineage(verify(boards.where("enabled").select("source", "slug"))) if reverify else None
    if reverify:
        out = reverified(out, old, now)
    exists = board_exists(F.col("source"), F.col("ok"), F.col("job_count"))
    count = lambda df, name: df.groupBy("source").agg(F.count("*").alias(name))
    stats = count(fresh, "candidates").join(count(fresh.where(exists), "added"), "source", "full")
    if reverify:
        stats = stats.join(count(old, "reverified"), "source", "full").join(count(old.where(~F.col("ok")), "disabled"), "source", "full")
    else:
        stats = stats.withColumns({"reverified": F.lit(0), "disabled": F.lit(0)})
    return Refreshed(out, stats.select("source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("candidates", "added", "reverified", "disabled")]))
