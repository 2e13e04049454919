"""Tables that change by appended rows: a change costs its own rows, reads put the changes over the last compaction, and compaction makes them one table again.

A read takes the base, which has one row for each key, without the keys that changed since (an anti join whose small side is the changes, so the base is not shuffled while
they are few), and beside it what the changes come to. Columns may be added by any change; rows from before have them null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.operators.ledger import Ledger, merged_schema

SEQ, GONE = "_seq", "_gone"


class ChangeLog:
    """A keyed table below root. patches: a null in a change leaves the stored value; else a change is the whole row."""

    def __init__(self, spark: SparkSession, root: str, key: list[str], patches: bool = False):
        self.ledger, self.key, self.patches = Ledger(spark, root), key, patches

    def change(self, rows: DataFrame, batch: str, gone: bool = False) -> bool:
        """Puts rows (one for each key at most) over those with their keys; with `gone` the keys of rows leave the table. Batches count in the order in which they are published."""
        kept = rows.select(*self.key) if gone else rows
        while not self.ledger.published(batch):
            now = self.ledger.entry()
            number = now["number"] if now else 0
            marked = kept.withColumns({SEQ: F.lit(number + 1).cast("long"), GONE: F.lit(gone)})
            if self.ledger.publish(self.ledger.staged(marked), batch, merged_schema(now, marked), after=number):
                return True
        return False

    def _parts(self) -> tuple[DataFrame | None, DataFrame | None]:
        """The base of the last compaction, and the changes since."""
        now = self.ledger.entry()
        base = [f for f in (now or {"folders": []})["folders"] if f == now["meta"].get("base")]
        since = [f for f in (now or {"folders": []})["folders"] if f not in base]
        return (self.ledger.read(folders=base) if base else None), (self.ledger.read(folders=since) if since else None)

    def read(self) -> DataFrame | None:
        """The table; none where nothing was changed yet."""
        base, since = self._parts()
        if base is None and since is None:
            return None
        out = self._merged(base, since)
        return out.drop(SEQ, GONE)

    def _merged(self, base: DataFrame | None, since: DataFrame | None) -> DataFrame:
        if since is None:
            return base
        rest = [c for c in since.columns if c not in self.key]
        if not self.patches:
            last = since.groupBy(*self.key).agg(F.max_by(F.struct(*rest), SEQ).alias("_last")).select(*self.key, "_last.*")
            over = last.where(~F.col(GONE)).select(*since.columns)
            return over if base is None else base.join(last.select(*self.key), self.key, "left_anti").select(*since.columns).unionByName(over)
        # A patched row needs what it had before, of the keys that changed alone.
        both = since if base is None else since.unionByName(base.join(since.select(*self.key).distinct(), self.key, "left_semi").select(*since.columns))
        last_gone = F.max(F.when(F.col(GONE), F.col(SEQ))).alias("_ended")
        ended = both.groupBy(*self.key).agg(last_gone)
        alive = both.join(ended, self.key).where(~F.col(GONE) & (F.col("_ended").isNull() | (F.col(SEQ) > F.col("_ended"))))
        values = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(SEQ))).alias(c) if c != SEQ else F.max(SEQ).alias(SEQ) for c in rest]
        over = alive.groupBy(*self.key).agg(*values).select(*since.columns)
        return over if base is None else base.join(since.select(*self.key).distinct(), self.key, "left_anti").select(*since.columns).unionByName(over)

    def compact(self) -> bool:
        """Makes base and changes one base, sorted by key; changes that are published meanwhile stay over it."""
        now = self.ledger.entry()
        if now is None or now["folders"] == [now["meta"].get("base")]:
            return False
        rows = self._merged(*self._parts())
        folder = self.ledger.staged(rows.repartitionByRange(*self.key).sortWithinPartitions(*self.key))
        return self.ledger.publish(folder, f"compact-{folder}", None, replaces=now["folders"], meta={"base": folder})
