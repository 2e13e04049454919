"""Where results go: tables that change as a whole, appended logs, files of drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions.text import sanitised, without_exfil
from jobweave.operators.ledger import Ledger


def snapshot(df: DataFrame, root: str) -> None:
    """Makes df the table at root: readers see the old rows or the new ones, never a part."""
    Ledger(df.sparkSession, root).replace(df)


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The table at root; none where nothing was published."""
    return Ledger(spark, root).read()


def appended(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def storable(markdown: Column) -> Column:
    """A draft's text as it may be stored: cleaned of banned characters and of what could load or track."""
    return without_exfil(sanitised(markdown))


def drafts(rows: DataFrame) -> DataFrame:
    """job_id, kind, markdown as they may be stored."""
    return rows.select("job_id", "kind", storable(F.col("markdown")).alias("markdown")).where(F.col("kind").isin("resume", "cover_letter"))


def stats_json(stats: DataFrame) -> DataFrame:
    return stats.select(F.to_json(F.struct(*stats.columns)).alias("json"))


def print_html(rows: DataFrame) -> DataFrame:
    """job_id, kind, html: paragraphs, headings, lists and emphasis of the markdown as a page of its own, without links."""
    escaped = F.replace(F.replace(F.replace("markdown", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.regexp_replace(escaped, r"\[([^\]]*)\]\([^)]*\)", "$1")
    for level in (3, 2, 1):
        body = F.regexp_replace(body, rf"(?m)^{'#' * level} +(.*)$", f"<h{level}>$1</h{level}>")
    # Each item is a list, and lists that follow each other are one.
    body = F.regexp_replace(F.regexp_replace(body, r"(?m)^[-*] +(.*)$", "<ul><li>$1</li></ul>"), r"</li></ul>\n<ul><li>", "</li>\n<li>")
    body = F.regexp_replace(F.regexp_replace(body, r"\*\*(.+?)\*\*", "<strong>$1</strong>"), r"\*(.+?)\*", "<em>$1</em>")
    body = F.regexp_replace(body, r"(?m)^(?!<h|<ul|<li|</ul|\s*$)(.+)$", "<p>$1</p>")
    return rows.select("job_id", "kind", F.concat(F.lit("<!doctype html><html><head><meta charset='utf-8'><title>"), "kind", F.lit("</title></head><body>"), body, F.lit("</body></html>")).alias("html"))
