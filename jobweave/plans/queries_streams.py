"""Streaming twins, run to the end of what has arrived and written to the shared folder."""

import uuid

from pyspark.sql import functions as F

from jobweave.operators.lineage import shared_folder
from jobweave.plans.binding import table
from jobweave.plans.registry import query
from jobweave.streaming import streams


def folder(spark):
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def events(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    alone = rows.inputFiles()[0].rstrip("/").endswith("/events.parquet")  # a file, not a folder of files: streams read folders
    reader = spark.readStream.schema(rows.schema)
    stream = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if alone else reader.parquet(f"{sf_dir}/events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def ran(spark, stream, mode):
    """The last state of a stream, read back from a table."""
    root = folder(spark)
    query = streams.settled(stream, lambda batch, _: batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{root}/out"), f"{root}/state", mode)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    found = ran(spark, streams.tumbling(events(spark, sf_dir), "ts", "1 day", ["event_type"], "1000 days"), "complete")
    return found.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def stream_latest(spark, sf_dir):
    return ran(spark, streams.latest_snapshot(events(spark, sf_dir).select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]), "complete").select("user_id", "event_id", "event_type")


@query(
    """SELECT user_id, s::BIGINT AS session, count(*) AS n FROM (SELECT user_id, sum(g) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
    FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS g FROM events)) GROUP BY ALL"""
)
def stream_sessions(spark, sf_dir):
    from pyspark.sql import Window

    found = ran(spark, streams.sessions(events(spark, sf_dir), "ts", "6 hours", ["user_id"], "1000 days"), "complete")
    return found.select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("session_window.start")).cast("long").alias("session"), "n")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    return ran(spark, streams.first_seen(events(spark, sf_dir).select("user_id", "event_type", "ts"), "ts", ["user_id", "event_type"], 40), "append").select("user_id", "event_type")


@query("SELECT ts < TIMESTAMP '2024-01-10' AS is_late, count(*) AS n FROM events GROUP BY ALL")
def stream_late(spark, sf_dir):
    marked = streams.late_split(events(spark, sf_dir), F.col("ts"), F.lit("2024-02-09").cast("timestamp"))
    return ran(spark, marked.groupBy("is_late").agg(F.count("*").alias("n")), "complete")
