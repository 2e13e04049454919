"""Numbers by order without one task: rows are ranged over tasks, counted there, and each task's rows go on from the counts before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweave.operators.lineage import cut_lineage


def ranged(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in stretches of their order, with part (the stretch's number) and row (rising within all of them). Stored, so that both stay as they are."""
    # Rows alike in all of `order` are spread too, by where they were read; equal rows are interchangeable.
    keys = [*order, "_tie"]
    tied = cut_lineage(rows.withColumn("_tie", F.monotonically_increasing_id()))
    return cut_lineage(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}))


def numbered(rows: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """rows with place: 0, 1, 2 ... in order, within each value of `by`."""
    by = by or []
    stored = ranged(rows, [*by, *order])
    counts = stored.groupBy(*by, "part").agg(F.count("*").alias("_here"), F.min("row").alias("_first"))
    # A row for each stretch that holds some of a key: at most as many as tasks and keys together.
    before = Window.partitionBy(*by, F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_here").over(before), F.lit(0)))
    counts = counts.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate([*by, "part"])], "_first", "_before")
    on = F.lit(True)
    for k, c in enumerate([*by, "part"]):
        on = on & F.col(c).eqNullSafe(F.col(f"_{k}"))
    return stored.join(counts, on).select(*rows.columns, (F.col("_before") + F.col("row") - F.col("_first")).alias("place"))
