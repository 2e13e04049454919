"""Company rows: found by name, or made with the next numbers, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.operators.ledger import Ledger
from jobweave.operators.numbering import numbered


def get_or_create(names: DataFrame, companies: Ledger, batch: str, attempts: int = 10) -> DataFrame:
    """name, id, is_blocked of each distinct name of names (name), null aside; names that are not stored are added with ids behind the largest one.

    New names are numbered in their order, so the same names over the same table get the same ids, however often a task or the whole call is run again; a call that comes second
    finds what the first one added. Writers at the same time cannot give an id twice: a batch is published only onto the entry that its numbers were counted from.
    """
    asked = names.select(F.col("name").cast("string").alias("name")).where("name is not null").distinct()
    for k in range(attempts):
        before = companies.entry()
        stored = companies.read(before["number"]) if before else None
        if stored is None:
            new, last = asked, 0
        else:
            new = asked.join(stored.select("name"), "name", "left_anti")
            last = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first()["n"]
        rows = numbered(new, ["name"]).select((F.col("place") + 1 + last).cast("long").alias("id"), "name", F.lit(False).alias("is_blocked"))
        if rows.isEmpty():
            break
        schema = rows.schema.json() if before is None else before["schema"]
        if companies.publish(companies.staged(rows), f"{batch}-{k}", schema, after=before["number"] if before else 0):
            break
    else:
        raise RuntimeError("other writers were always first")
    stored = companies.read()
    return asked.join(stored.select("name", "id", "is_blocked"), "name") if stored is not None else asked.select("name", F.lit(None).cast("long").alias("id"), F.lit(False).alias("is_blocked"))
