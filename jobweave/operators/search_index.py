"""Substring search without reading texts: every place of every three letters is a posting, and a term is where all of its threes follow one another.

Postings lie in folders by the hash of their first letter, sorted, so a search opens one folder for each first letter of the term's threes and within it the row groups of
these threes. Places prove a match exactly, so no text is fetched to verify it. Texts are padded at their end, so terms of one or two letters are the beginnings of threes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators.ledger import Ledger

GRAM = 3
PAD = "￿"


def cell_of(gram: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(F.substring(gram, 1, 1)), F.lit(cells)).cast("int")


class SearchIndex:
    """Rows: gram, id, field, length (of the field), places (from 0), cell. Ids come once: postings of a job board do not change their words, and what is withdrawn is not among the
    rows that are joined."""

    def __init__(self, spark: SparkSession, root: str, cells: int = 64):
        self.table = Ledger(spark, root)
        self.cells = (self.table.entry() or {"meta": {}})["meta"].get("cells", cells)

    def add(self, rows: DataFrame, batch: str, fields: list[str]) -> bool:
        """Adds rows (id, and a text column for each of `fields`); letters count as small ones, null as empty."""
        each = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias("text")) for k, c in enumerate(fields)]))
        texts = rows.select(F.col("id").cast("long").alias("id"), each.alias("x")).select("id", "x.field", "x.text", F.length("x.text").alias("length"))
        padded = F.concat("text", F.lit(PAD * (GRAM - 1)))
        grams = F.transform(F.sequence(F.lit(1), F.col("length")), lambda k: F.struct(F.substring(padded, k, F.lit(GRAM)).alias("gram"), (k - 1).alias("place")))
        exploded = texts.where("length > 0").select("id", "field", "length", F.explode(grams).alias("g"))
        postings = exploded.groupBy(F.col("g.gram").alias("gram"), "id", "field", "length").agg(F.sort_array(F.collect_list("g.place")).alias("places"))
        filed = postings.withColumn("cell", cell_of(F.col("gram"), self.cells))
        # Letters are not alike frequent: a cell is written by several tasks, each with its own stretch of grams.
        return self.table.append(filed.repartitionByRange("cell", "gram", "id").sortWithinPartitions("cell", "gram", "id"), batch, ["cell"], {"cells": self.cells, "fields": fields})

    def postings(self, term: str) -> DataFrame | None:
        """The postings of the term's threes; no other is read."""
        stored = self.table.read()
        if stored is None or not term:
            return None
        grams = sorted({term[k : k + GRAM] for k in range(len(term) - GRAM + 1)}) or [term]
        spark = stored.sparkSession
        # The cells of the term's letters: one row is asked for each, whatever the index holds.
        letters = spark.createDataFrame([(g,) for g in grams], "gram string").select(cell_of(F.col("gram"), self.cells).alias("cell")).distinct()
        within = stored.where(F.col("cell").isin([r["cell"] for r in letters.collect()]))
        return within.where(F.col("gram").isin(grams)) if len(term) >= GRAM else within.where((F.col("gram") >= term) & (F.col("gram") <= term + PAD * GRAM))

    def search(self, term: str) -> DataFrame | None:
        """id, rank of all ids with the term in one of their fields: 0 a field that is the term, 1 one that begins with it, 2 one that holds it. Letters count as small ones."""
        term = term.strip().lower()
        found = self.postings(term)
        if found is None:
            return None
        starts = found.select("id", "field", "length", "gram", F.explode("places").alias("place"))
        if len(term) >= GRAM:
            offsets = F.map_from_arrays(*[F.array(*map(F.lit, x)) for x in zip(*gram_offsets(term), strict=True)])
            starts = starts.withColumn("offset", F.explode(F.element_at(offsets, F.col("gram")))).withColumn("start", F.col("place") - F.col("offset"))
            whole = starts.groupBy("id", "field", "length", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(term) - GRAM + 1)
        else:
            whole = starts.withColumn("start", F.col("place"))
        rank = F.when((F.col("start") == 0) & (F.col("length") == len(term)), 0).when(F.col("start") == 0, 1).otherwise(2)
        return whole.groupBy("id").agg(F.min(rank).alias("rank"))


def gram_offsets(term: str) -> list[tuple[str, list[int]]]:
    """Each three of a term with the offsets at which it stands."""
    out: dict[str, list[int]] = {}
    for k in range(len(term) - GRAM + 1):
        out.setdefault(term[k : k + GRAM], []).append(k)
    return list(out.items())


def listed(rows: DataFrame, index: SearchIndex, term: str, order: list[Column], limit: int = 20) -> DataFrame:
    """rows (id, ...) that the index finds, best matches first, then by order; as `listing.searched`, but of rows only those found are joined."""
    found = index.search(term) if len(term.strip()) >= 2 else None
    if found is None:
        return rows.withColumn("rank", F.lit(0)).limit(0)
    return rows.join(found.select("id", "rank"), "id").orderBy("rank", *order).limit(min(50, max(1, limit)))
