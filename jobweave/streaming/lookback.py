"""Near-duplicate links of a stream: each posting is linked to the first one of the last days whose fingerprint is near, out of state.

A posting goes to each of its band keys, which lie in a fixed number of cells, as a call for each key would cost far more than its rows. A cell's state holds, by key, the fingerprints of its window, one entry for each fingerprint and time, so copies that arrive together are one; an event-time
timer drops what no later posting can be linked to any more. What the keys of a posting find leaves in one micro-batch, where the first of all is taken.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from jobweave.functions.hashes import NEAR, halves
from jobweave.operators.dedupe import banded
from jobweave.operators.ledger import Ledger

FOUND = "id long, at timestamp, parent long, parent_at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Window(StatefulProcessor):
    """Of a cell of band keys. State: (band key, fingerprint, time in microseconds) -> smallest id. What no posting within `late` of the newest one can be linked to is not stored."""

    def __init__(self, days: int, distance: int, late: int):
        self.span, self.distance, self.late = days * 86_400_000_000, distance, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "band int, value long, print string, t long", "id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)  # a micro-batch's rows of one cell
        new["t"] = new["at"].astype("datetime64[us]").astype("int64")
        new = new.sort_values(["band", "value", "t", "id"])
        limit = int(new["t"].max()) - self.late - self.span - 1000  # watermarks count milliseconds
        old: dict[tuple[int, int], list[tuple[str, int, int]]] = {}
        kept: dict[tuple, int] = {}
        for (band, value, p, t), (i,) in list(self.held.iterator()):
            old.setdefault((band, value), []).append((p, t, i))
            if t < limit:
                self.held.removeKey((band, value, p, t))
            else:
                kept[band, value, p, t] = i
        out, changed = [], {}
        lists = zip(*[new[c].tolist() for c in ("band", "value", "print", "t", "id")])
        for own, group in groupby(lists, key=lambda r: r[:2]):
            posted = list(group)
            known: dict[str, list[tuple[int, int]]] = {}
            for p, t, i in sorted(old.get(own, [])):
                known.setdefault(p, []).append((t, i))
            near: dict[str, list[str]] = {}
            if known or len(posted) > 1:
                bits = {p: int(p, 16) for p in {*known, *(r[2] for r in posted)}}
                near = {p: [q for q in bits if (bits[p] ^ bits[q]).bit_count() <= self.distance] for p in {r[2] for r in posted}}
            for _, _, p, t, i in posted:
                best = None
                for q in near.get(p, ()):
                    times = known.get(q, ())
                    k = bisect_left(times, (t - self.span,))
                    if k < len(times) and times[k] < (t, i) and (best is None or times[k] < best):
                        best = times[k]
                if best:
                    out.append((i, t, best[1], best[0]))
                times = known.setdefault(p, [])
                k = bisect_left(times, (t,))
                if k == len(times) or times[k][0] != t:
                    times.insert(k, (t, i))
                elif i < times[k][1]:
                    times[k] = (t, i)
                else:
                    continue
                if t >= limit:
                    changed[(*own, p, t)] = i
        for where, i in changed.items():
            self.held.updateValue(where, (i,))
        left = [where[3] for where in (*kept, *changed)]
        if left:
            self._wake(min(left))
        found = pd.DataFrame(out, columns=["id", "at", "parent", "parent_at"])
        yield found.assign(at=pd.to_datetime(found["at"], unit="us"), parent_at=pd.to_datetime(found["parent_at"], unit="us"))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        limit = timerValues.getCurrentWatermarkInMs() * 1000 - self.span
        entries = [k for k, _ in self.held.iterator()]
        left = [where[3] for where in entries if where[3] >= limit]
        for where in entries:
            if where[3] < limit:
                self.held.removeKey(where)
        if left:
            self._wake(min(left))
        yield pd.DataFrame([], columns=["id", "at", "parent", "parent_at"])

    def _wake(self, oldest: int) -> None:
        """One timer a cell: when the oldest entry leaves the window. Times are rounded up, as timers count milliseconds."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(-(-(oldest + self.span) // 1000) + 1)

    def close(self) -> None:
        pass


def candidates(stream: DataFrame, days: int = 14, late: str = "0 seconds", blocks: int = 4, distance: int = NEAR, cells: int = 1024) -> DataFrame:
    """id, at, parent, parent_at: what each band key of a posting (id, print, at) finds. Keys are kept by cells, a call of the processor for each. Postings later than `late` behind the newest ones are dropped, as Spark does with a watermark."""
    high, low = halves(F.col("print"))
    rows = stream.where("print is not null and at is not null").select(F.col("id").cast("long").alias("id"), "print", F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    keyed = banded(rows.withColumns({"high": high, "low": low}), blocks, distance, ("id", "at"))
    keyed = keyed.select(F.pmod(F.xxhash64("band", "value"), F.lit(cells)).cast("int").alias("cell"), "band", "value", "id", "print", "at")
    micros = stream.sparkSession.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL '{late}')").first()[0]
    return keyed.groupBy("cell").transformWithStateInPandas(Window(days, distance, micros), FOUND, "Append", "EventTime")


def linked(stream: DataFrame, table: str, checkpoint: str, **options) -> StreamingQuery:
    """Runs what has arrived to its end; table (a ledger's) gets id, at, parent of each posting that has one, a batch of it for each micro-batch."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        first = F.min(F.struct(F.col("parent_at"), F.col("parent").alias("parent"))).alias("first")
        Ledger(batch.sparkSession, table).append(batch.groupBy("id", "at").agg(first).select("id", "at", "first.parent"), f"links-{batch_id}")

    with_state(spark)
    return candidates(stream, **options).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_state(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB; a session that has chosen a store by itself keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if not spark.conf.get(name, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(name, ROCKS)
