"""A stored index of fingerprints, so that new ones meet only stored ones that may be near, and the store is not read as a whole.

A fingerprint has a row for each choice of blocks of its bits; rows lie in folders by a cell, the hash of choice and bits. New fingerprints name the cells that they fall
into, at most `cells` numbers however many they are, and only these folders are opened. The index is a ledger's table: an ingest adds its rows as one batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.functions.hashes import NEAR, halves
from jobweave.operators.dedupe import banded
from jobweave.operators.ledger import Ledger


class PrintIndex:
    """Rows: print, id, at, root (what a link to the row ends at), band, value, cell. blocks and cells are fixed when the index is made.

    blocks: more of them make longer keys, and more rows of each fingerprint; 4 suit millions, 6 (20 rows) billions.
    """

    def __init__(self, spark: SparkSession, root: str, blocks: int = 4, cells: int = 256, distance: int = NEAR):
        self.table = Ledger(spark, root)
        made = (self.table.entry() or {"meta": {}})["meta"]
        self.blocks, self.cells, self.distance = made.get("blocks", blocks), made.get("cells", cells), made.get("distance", distance)

    def keys(self, prints: DataFrame) -> DataFrame:
        """prints (print, ...) by their keys: a row for each with band, value, cell, high, low."""
        high, low = halves(F.col("print"))
        keyed = banded(prints.where("print is not null").select("print").distinct().select("print", high.alias("high"), low.alias("low")), self.blocks, self.distance)
        return keyed.withColumn("cell", F.pmod(F.xxhash64("band", "value"), F.lit(self.cells)).cast("int"))

    def add(self, rows: DataFrame, batch: str) -> bool:
        """Adds rows (id, print, at, root); false where the batch was added before. Rows without a fingerprint have no place here."""
        own = rows.where("print is not null").select("print", F.col("id").cast("long").alias("id"), F.col("at").cast("timestamp").alias("at"), F.coalesce("root", "id").cast("long").alias("root"))
        keyed = self.keys(own).select("print", "band", "value", "cell").join(own, "print")
        meta = {"blocks": self.blocks, "cells": self.cells, "distance": self.distance}
        # A cell's rows are in a file of their own: as many tasks as there are cells write them.
        return self.table.append(keyed.repartition("cell").sortWithinPartitions("cell", "band", "value"), batch, ["cell"], meta)

    def compact(self) -> bool:
        """One file for each cell again, after many batches."""
        return self.table.compact(lambda rows: rows.repartition("cell").sortWithinPartitions("cell", "band", "value"), ["cell"])

    def candidates(self, keyed: DataFrame) -> DataFrame | None:
        """Stored rows in the cells of keyed rows (`keys`); no other folder is read. None where nothing is stored."""
        stored = self.table.read()
        if stored is None:
            return None
        cells = sorted(r["cell"] for r in keyed.select("cell").distinct().collect())  # at most `cells` numbers
        return stored.where(F.col("cell").isin(cells)) if cells else stored.limit(0)

    def near(self, prints: DataFrame, since=None) -> DataFrame | None:
        """print, id, at, root: for each of prints (print) the stored rows within the distance, not older than `since`; one for each stored fingerprint, that of the smallest id."""
        keyed = self.keys(prints)
        stored = self.candidates(keyed)
        if stored is None:
            return None
        if since is not None:
            stored = stored.where(F.col("at") >= since)
        firsts = stored.groupBy("cell", "band", "value", "print").agg(F.min(F.struct("id", "at", "root")).alias("first"))
        high, low = halves(F.col("stored"))
        met = keyed.join(firsts.withColumnRenamed("print", "stored"), ["cell", "band", "value"])
        apart = F.bit_count(F.col("high").bitwiseXOR(high)) + F.bit_count(F.col("low").bitwiseXOR(low))
        found = met.where(apart <= self.distance).groupBy("print", "stored").agg(F.min("first").alias("first"))
        return found.select("print", "first.id", "first.at", "first.root")

    def first_near(self, prints: DataFrame, since=None) -> DataFrame | None:
        """print, id, root: of each of prints the stored row of the smallest id within the distance and not older than `since`."""
        found = self.near(prints, since)
        return None if found is None else found.groupBy("print").agg(F.min(F.struct("id", "root")).alias("first")).select("print", "first.id", "first.root")
