"""Pluggable sources: a Python data source with a partition for each slug, and verification of boards in parallel.

A fetcher is a function (slug, page) -> Answer, named as "module:function". The engine never opens connections itself; whoever adds a source
registers a fetcher and a normaliser.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: How long a limited source is given before its one retry.
BACKOFF_SECONDS = 10


@dataclass(frozen=True)
class Answer:
    payload: str | None  # null: nothing more, or an error
    status: int = 200
    more: bool = False


Fetcher = Callable[[str, int], Answer]


def named(path: str) -> Fetcher:
    module, _, function = path.partition(":")
    return getattr(importlib.import_module(module), function)


def with_retry(fetch: Fetcher, wait: float = BACKOFF_SECONDS) -> Fetcher:
    """One retry after a pause where the source says that it is asked too often (429)."""

    def once_more(slug: str, page: int) -> Answer:
        answer = fetch(slug, page)
        if answer.status == 429:
            time.sleep(wait)
            answer = fetch(slug, page)
        return answer

    return once_more


class Slug(InputPartition):
    """One slug to a partition, or where a source is limited all of its slugs to one, so that a second refusal stops the rest."""

    def __init__(self, slugs: list[str]):
        self.slugs = slugs


class BoardReader(DataSourceReader):
    def __init__(self, options: dict):
        self.fetcher, self.slugs = options["fetcher"], json.loads(options["slugs"])
        self.limited = options.get("limited", "false").lower() == "true"
        self.wait = float(options.get("wait", BACKOFF_SECONDS))
        self.pages = int(options["pages"]) if "pages" in options else None  # the source's own bound; without one the fetcher says when there is no more

    def partitions(self) -> list[Slug]:
        return [Slug(self.slugs)] if self.limited else [Slug([s]) for s in self.slugs]

    def read(self, partition: Slug) -> Iterator[tuple]:
        fetch = with_retry(named(self.fetcher), self.wait)
        for slug in partition.slugs:
            for page in count() if self.pages is None else range(self.pages):
                answer = fetch(slug, page)
                if answer.status == 429 and self.limited:
                    return
                if answer.payload is None or answer.status != 200:
                    break  # this slug only
                yield slug, answer.payload, page
                if not answer.more:
                    break


class BoardSource(DataSource):
    """spark.read.format("jobboard").option("fetcher", "module:function").option("slugs", '["a", "b"]').load(): slug, payload, page."""

    @classmethod
    def name(cls) -> str:
        return "jobboard"

    def schema(self) -> str:
        return "slug string, payload string, page int"

    def reader(self, schema) -> BoardReader:
        return BoardReader(self.options)


def answers(spark: SparkSession, fetcher: str, slugs: list[str], limited: bool = False, wait: float = BACKOFF_SECONDS, pages: int | None = None) -> DataFrame:
    """slug, payload, page; pages: how many of a slug are read at most, as the source has it (none: as many as there are)."""
    spark.dataSource.register(BoardSource)
    reader = spark.read.format("jobboard").option("fetcher", fetcher).option("slugs", json.dumps(slugs))
    reader = reader if pages is None else reader.option("pages", str(pages))
    return reader.option("limited", str(limited).lower()).option("wait", str(wait)).load()


def verified(boards: DataFrame, check: Callable[[str, str], tuple[bool, int | None, str | None]]) -> DataFrame:
    """source, slug, ok, job_count, error: check(source, slug) of each board; one that raises is not ok, and stops nobody else."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for source, slug in zip(batch["source"], batch["slug"], strict=True):
                try:
                    ok, count, error = check(source, slug)
                except Exception as e:  # noqa: BLE001  a check may fail in any way
                    ok, count, error = False, None, str(e)[:400]
                out.append((source, slug, ok, count, error))
            yield pd.DataFrame(out, columns=["source", "slug", "ok", "job_count", "error"])

    return boards.select("source", "slug").distinct().mapInPandas(run, "source string, slug string, ok boolean, job_count double, error string").withColumn("job_count", F.col("job_count").cast("long"))
