"""Date and time functions. Times are UTC: sessions set spark.sql.session.timeZone to UTC, and times without a zone are read as UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def iso_time(c: Column) -> Column:
    """An ISO 8601 time, a final Z included; null for anything else."""
    fine = c.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?([Zz]|[+-]\d{2}:?\d{2})?)?$")
    return F.when(fine, F.try_to_timestamp(F.regexp_replace(c, "[Zz]$", "+00:00")))


def any_time(c: Column) -> Column:
    """ISO 8601 first, then a day or a time without zone."""
    return F.coalesce(iso_time(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def feed_time(c: Column) -> Column:
    """The time of an RSS item, with or without its weekday."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UTC|UT|Z)$", "+0000")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm xx")))


def millis_time(c: Column) -> Column:
    return F.timestamp_millis(F.nullif(c.try_cast("long"), F.lit(0).cast("long")))


def epoch_or_iso(c: Column) -> Column:
    """Seconds since 1970 as a number or digits, else ISO 8601."""
    return F.coalesce(F.when(c.cast("string").rlike(r"^\d+(\.\d+)?$"), F.timestamp_seconds(c.try_cast("double"))), iso_time(c.cast("string")))


def is_stale(posted: Column, now: Column, days: int = 30) -> Column:
    """Strictly older than so many days; an unknown date is fresh."""
    return F.coalesce(posted < now - F.make_interval(days=F.lit(days)), F.lit(False))


def days_overdue(due: Column, now: Column) -> Column:
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(due.cast("timestamp"))
    return F.greatest(F.lit(0), F.floor(seconds / DAY)).cast("long")


def overdue_label(days: Column) -> Column:
    return F.when(days <= 0, "due today").otherwise(F.concat(days.cast("string"), F.lit("d overdue")))


def relative_label(days: Column) -> Column:
    """How long ago, from whole days."""
    months = F.floor(days / 30)
    many = F.concat(months.cast("string"), F.when(months == 1, " month ago").otherwise(" months ago"))
    return F.when(days <= 0, "today").when(days == 1, "1 day ago").when(days < 30, F.concat(days.cast("string"), F.lit(" days ago"))).otherwise(many)


def followup_default(applied: Column, days: int = 7) -> Column:
    return applied + F.make_interval(days=F.lit(days))


def shifted(start: Column, days: Column) -> Column:
    return start + F.make_interval(days=days)


def day_or_dash(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("—"))


def moment_or_empty(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm"), F.lit(""))


def needs_check(checked: Column, now: Column, days: int = 30) -> Column:
    """Never checked, or so many days ago."""
    return F.coalesce(F.datediff(now, checked) >= days, F.lit(True))
