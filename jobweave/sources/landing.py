"""Sources side by side, each on its own: what one raises costs its own rows, and is told as a row."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators.lineage import written

Source = Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class Landed:
    records: DataFrame | None  # of all sources that were read, with source_rank; none: all failed
    report: DataFrame  # source, source_rank, fetched, error


def landed(spark: SparkSession, sources: dict[str, Source], at_once: int = 4) -> Landed:
    """Reads each source (records of one schema, or dead letters beside them) by a job of its own into the shared folder.

    A source that raises, while it is planned or in any of its tasks, has no records and an error in the report; the others are read all the same. The order of `sources` is
    their rank. A source whose rows may fail one by one gives what it has and tells its errors as rows (`sources.paging`).
    """

    def read(one: tuple[int, tuple[str, Source]]):
        rank, (name, source) = one
        try:
            rows = written(source(spark).withColumn("source_rank", F.lit(rank)))
            return name, rank, rows, rows.count(), None
        except Exception as e:  # noqa: BLE001  a source may fail in any way
            return name, rank, None, 0, f"{type(e).__name__}: {reason(e)}"

    with ThreadPoolExecutor(at_once) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(read), enumerate(sources.items())))
    records = None
    for _, _, rows, _, _ in done:
        if rows is not None:
            records = rows if records is None else records.unionByName(rows)
    report = spark.createDataFrame([(name, rank, n, error) for name, rank, _, n, error in done], "source string, source_rank int, fetched long, error string")
    return Landed(records, report)


def reason(e: Exception) -> str:
    """The first line of what went wrong; of a failed job that of its task."""
    lines = str(getattr(e, "getMessage", lambda: None)() or e).splitlines()
    return (lines[0] if lines else "")[:400]


def by_source(report: DataFrame, rows: DataFrame, outcomes: list[str]) -> DataFrame:
    """source, fetched, error, and how many of its rows have each outcome: a row for each source of the report, those that failed too."""
    counts = rows.groupBy("source").agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in outcomes])
    return report.join(counts, "source", "left").select("source", "source_rank", "fetched", "error", *[F.coalesce(o, F.lit(0)).alias(o) for o in outcomes])
