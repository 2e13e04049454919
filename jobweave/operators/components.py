"""Connected components of rows by id."""

from __future__ import annotations

import uuid
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.operators.lineage import cut_lineage, removed, shared_folder


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id that edges (src, dst) lead to), of all ends of edges that have another end.

    Rounds of contraction. Vertices are ranked anew by hash in each; every vertex points to the first of itself and its neighbours, and pointers are doubled until they end at vertices that are
    first among their own neighbours. Chains by random ranks are short, and at most about half of the vertices are such ends, whatever the order of ids, so a component of n
    vertices takes some log n rounds, a path in order as well. Labels are joined, never gathered.

    Each step is a table in the shared folder, removed in the end: a checkpoint would hand on the estimated sizes of joins, which multiply from step to step.
    """
    spark = edges.sparkSession
    folder, steps = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}", count()

    def stored(rows: DataFrame) -> DataFrame:
        path = f"{folder}/{next(steps)}"
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    left = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst")
    left = stored(left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    total, turn = None, 0
    while not left.isEmpty():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("rank"), F.col(c).alias("id"))  # noqa: B023, E731
        low = left.groupBy(F.col("src").alias("id")).agg(F.min(rank("dst")).alias("near")).select("id", F.least("near", rank("id"))["id"].alias("to"))
        low, moving = stored(low), True
        while moving:
            ahead = low.select(F.col("id").alias("to"), F.col("to").alias("next"))
            moved = stored(low.join(ahead, "to").select("id", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
            low, moving = moved.select("id", "to"), not moved.where("moved").isEmpty()
        onward = low.select(F.col("id").alias("to"), F.col("to").alias("next"))
        total = low if total is None else stored(total.join(onward, "to", "left").select("id", F.coalesce("next", "to").alias("to")))
        ends = low.select(F.col("id").alias("dst"), F.col("to").alias("d"))
        moved = left.join(low.withColumnRenamed("id", "src"), "src").join(ends, "dst").select(F.col("to").alias("src"), F.col("d").alias("dst"))
        left = stored(moved.where("src <> dst").distinct())
    if total is None:
        out = left.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    else:
        out = total.join(total.groupBy("to").agg(F.min("id").alias("component")), "to").select("id", "component")
    out = cut_lineage(out)
    removed(spark, folder)
    return out
