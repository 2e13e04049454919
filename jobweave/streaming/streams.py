"""Streaming twins: micro-batch ingest, latest snapshots, windows, late data."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobweave.operators.dedupe import new_members
from jobweave.operators.ledger import Ledger


def files(spark: SparkSession, path: str, schema: str, per_trigger: int = 100, kind: str = "json") -> DataFrame:
    """Files as they land, so many to a micro-batch."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def ingest(stream: DataFrame, plan: Callable[[DataFrame, int], DataFrame], table: str, key: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch through a batch plan, published in the table (a ledger's) where its key is new.

    A batch is named by its stream (its checkpoint) and number, so one that is run again after a failure is not published twice, and one that was killed half way is not there at all. Of the stored
    rows only the keys are read.
    """

    # Two streams into one table count their batches each for itself.
    source = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, batch_id: int) -> None:
        ledger = Ledger(batch.sparkSession, table)
        name = f"{source}-{batch_id}"
        if ledger.published(name):
            return
        new = plan(batch, batch_id).withColumn("batch_id", F.lit(batch_id).cast("long"))
        stored = ledger.read()
        ledger.append(new if stored is None else new_members(new, stored, lambda c: c, key), name)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_split(stream: DataFrame, at: Column, now: Column, days: int = 30) -> DataFrame:
    """The stream with is_late: late rows are marked and can be counted, where a watermark would drop them silently."""
    return stream.withColumn("is_late", F.coalesce(at < now - F.make_interval(days=F.lit(days)), F.lit(False)))


def first_seen(stream: DataFrame, at: str, key: list[str], days: int = 14) -> DataFrame:
    """Rows whose key was not seen within the window; state older than it is dropped."""
    return stream.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark(key)


def latest_snapshot(stream: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, for update or complete mode."""
    rest = [c for c in stream.columns if c != key]
    best = stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x"))
    return best.select(key, *[F.col(f"x.{c}").alias(c) for c in rest])


def tumbling(stream: DataFrame, at: str, width: str, by: list[str], late: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, at: str, gap: str, by: list[str], late: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n"))


def settled(stream: DataFrame, to: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs what has arrived to its end."""
    return stream.writeStream.outputMode(mode).foreachBatch(to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
