"""Queries over the driver's tables, one for each operator family, with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobweave.plans import queries_changes, queries_dedupe, queries_listing, queries_more, queries_reading, queries_rules, queries_sources, queries_stored, queries_streams, queries_text
from jobweave.plans.registry import QUERIES, SQL

FAMILIES = [queries_rules, queries_listing, queries_dedupe, queries_text, queries_changes, queries_streams, queries_more, queries_sources, queries_reading, queries_stored]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


filter_cascade_counts = queries_rules.filter_cascade_counts
