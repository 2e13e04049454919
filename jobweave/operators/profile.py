"""The search profile, a single row of lists, and the choice of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The lists of a profile.
LISTS = ["required_tech", "excluded_tech", "seniority_terms", "competing_tech", "role_titles"]
EMPTY = "array<string>"


def from_json_lists(rows: DataFrame) -> DataFrame:
    """rows with its lists, stored as JSON text, read as arrays; null or malformed text is an empty list."""
    return rows.withColumns({c: F.coalesce(F.from_json(c, EMPTY), F.array().cast(EMPTY)) for c in LISTS if c in rows.columns})


def shown(rows: DataFrame) -> DataFrame:
    """rows with using_defaults: no required technology, or no seniority terms, are set."""
    unset = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return rows.withColumn("using_defaults", unset("required_tech") | unset("seniority_terms"))


def merged(own: Column, suggested: Column) -> Column:
    """The terms of both lists in order, each once, without regard to case: the spelling that comes first stays."""
    both = F.concat(F.coalesce(own, F.array().cast(EMPTY)), F.coalesce(suggested, F.array().cast(EMPTY)))
    small = lambda x: F.lower(F.trim(x))
    kept = F.filter(both, lambda x, i: (F.trim(x) != "") & (F.array_position(F.transform(both, small), small(x)) == i + 1))
    return F.transform(kept, lambda x: F.trim(x))


def put(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The stored row (key, ...) with the new one in its place; a clear is a put of empty lists."""
    return stored.join(new.select("key"), "key", "left_anti").unionByName(new.select(*stored.columns))


def cleared(stored: DataFrame, key: Column) -> DataFrame:
    return stored.withColumns({c: F.when(key, F.array().cast(EMPTY)).otherwise(F.col(c)) for c in LISTS if c in stored.columns})


def model_choice(override: Column, provider_default: Column, general: Column) -> Column:
    """The first that is set: what was asked for, the provider's own, the general one; blanks count as unset."""
    told = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(told(override), told(provider_default), told(general))


def shell_profile(resume: Column) -> Column:
    """struct(name, headline, initials): the first line that is no banner, the first line after it within six that is no section header, and the initials of up to two words."""
    lines = F.filter(F.transform(F.split(F.coalesce(resume, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(r"^[=\-_*#\s]+$"))
    lines = F.filter(lines, lambda x: ~F.upper(x).isin("RESUME", "CURRICULUM VITAE", "CV"))
    name = F.get(lines, F.lit(0))
    header = lambda x: x.rlike(r"(?i)^(summary|experience|education|skills|profile|objective|projects|contact)\b:?$")
    after = F.slice(lines, F.lit(2), F.greatest(F.lit(0), F.least(F.lit(5), F.size(lines) - 1)))
    stop = F.array_position(F.transform(after, header), F.lit(True))
    head = F.get(F.when(stop > 0, F.slice(after, F.lit(1), (stop - 1).cast("int"))).otherwise(after), F.lit(0))
    initials = F.array_join(F.transform(F.slice(F.filter(F.split(name, r"\s+"), lambda w: w != ""), 1, 2), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.when(F.size(lines) > 0, F.struct(name.alias("name"), head.alias("headline"), initials.alias("initials")))
