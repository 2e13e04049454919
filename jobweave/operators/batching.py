"""Order-dependent grouping of rows, and what comes back from a scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.operators.lineage import cut_lineage
from jobweave.operators.numbering import numbered, ranged


@dataclass
class Packing:
    """The packer's state: rows and size of the open batch, and how many batches were opened. A row opens a batch if the open one is full or would grow too large."""

    most_rows: int
    most_size: int
    n: int = 0
    total: int = 0
    opened: int = 0

    def opens(self, size: int) -> bool:
        return self.opened == 0 or self.n >= self.most_rows or self.total + size > self.most_size

    def take(self, size: int) -> None:
        if self.opens(size):
            self.opened, self.n, self.total = self.opened + 1, 0, 0
        self.n, self.total = self.n + 1, self.total + size


def stretch(sizes: Iterator[int], most_rows: int, most_size: int) -> dict:
    """What a stretch of one key's rows does to the packer, for every state that it may be met in: such a state matters only by how many rows of the stretch still go to the batch
    that is open before it. So there is a Packing for each number of rows (0 to most_rows, or to the stretch's end) behind which the first own batch opens; those
    that come to the same state are one from there on. head: the sizes of those first rows; ends: (entry, opened, n, total)."""
    head, live, length = [], [], 0
    for size in sizes:
        if length <= most_rows:
            head.append(size)
            live.append([Packing(most_rows, most_size), [(length, 0)]])
        states: dict[tuple[int, int], list] = {}
        for packing, entries in live:
            packing.take(size)
            same = states.setdefault((packing.n, packing.total), [packing, []])
            # Each entry's count is that of the packing it is merged into, and what it was ahead or behind.
            same[1].extend((e, more + packing.opened - same[0].opened) for e, more in entries)
        live, length = list(states.values()), length + 1
    ends = sorted((e, p.opened + more, p.n, p.total) for p, entries in live for e, more in entries)
    return {"length": length, "head": head, "ends": ends}


STRETCH = "length long, head array<long>, ends array<struct<entry:long,opened:long,n:long,total:long>>"


def packed(rows: DataFrame, key: str, order: str, size: str, most_rows: int = 8, most_size: int = 24_000) -> DataFrame:
    """key, order, batch: sequential packing within each key.

    A row opens a new batch if the open one holds most_rows or would grow beyond most_size; a row above that alone is a batch of its own. A key's rows are ranged over tasks, so one key may
    hold all rows: each task tells what its stretch does to the packer (`stretch`, some hundred numbers at most), the stretches of a key are put together in order, a
    row for each, and each task packs its rows from the state that it is met in. A null size counts as 0; null is a key of its own.
    """
    kinds = dict(rows.dtypes)
    stored = ranged(rows.select(key, order, F.coalesce(size, F.lit(0)).cast("long").alias(size)), [key, order])
    plain = stored.select("part", F.col(key).alias("k"), F.col(order).alias("o"), F.col(size).alias("size"), "row")

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
        """(part, key), piece: the pieces of a stretch follow one another."""
        for piece in batches:
            cuts = (piece["part"].ne(piece["part"].shift()) | ~(piece["k"].eq(piece["k"].shift()) | (piece["k"].isna() & piece["k"].shift().isna()))).cumsum()
            for _, same in piece.groupby(cuts, sort=False):
                k = same["k"].iloc[0]
                yield (int(same["part"].iloc[0]), None if pd.isna(k) else k), same

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (part, k), pieces in groupby(runs(batches), lambda x: x[0]):
            found = stretch((s for _, piece in pieces for s in piece["size"].tolist()), most_rows, most_size)
            yield pd.DataFrame({"part": [part], "k": pd.Series([k], dtype=object), "length": [found["length"]], "head": [found["head"]], "ends": [[dict(zip(("entry", "opened", "n", "total"), e, strict=True)) for e in found["ends"]]]})

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The state that each stretch of a key is met in: a row for each stretch."""
        now, state, first = None, None, True
        for piece in batches:
            out = []
            for part, k, length, head, ends in zip(piece["part"], piece["k"], piece["length"], piece["head"], piece["ends"], strict=True):
                k = None if pd.isna(k) else k
                if first or k != now:
                    now, state, first = k, Packing(most_rows, most_size), False
                out.append((part, k, state.opened, state.n, state.total))
                entry = 0
                while entry < length and not state.opens(int(head[entry])):
                    state.take(int(head[entry]))
                    entry += 1
                if entry < length:
                    end = next(e for e in ends if e["entry"] == entry)
                    state = Packing(most_rows, most_size, int(end["n"]), int(end["total"]), state.opened + int(end["opened"]))
            yield pd.DataFrame(out, columns=["part", "k", "opened", "n", "total"]).astype({"k": object})

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for where, piece in runs(batches):
            if where != now:
                now, state = where, Packing(most_rows, most_size, *(int(piece[c].iloc[0]) for c in ("n", "total", "opened")))
            out = []
            for s in piece["size"].tolist():
                state.take(s)
                out.append(state.opened - 1)
            yield pd.DataFrame({"k": piece["k"], "o": piece["o"], "batch": out})

    # What is stored is read as it lies: a partition for each part, in order.
    stretches = cut_lineage(plain.mapInPandas(told, f"part int, k {kinds[key]}, {STRETCH}"))
    met = stretches.repartition("k").sortWithinPartitions("k", "part").mapInPandas(joined, f"part int, k {kinds[key]}, opened long, n long, total long")
    states = met.select(F.col("part").alias("_part"), F.col("k").alias("_k"), "opened", "n", "total")
    rest = plain.join(states, (F.col("part") == F.col("_part")) & F.col("k").eqNullSafe(F.col("_k"))).drop("_part", "_k")
    numbers_of = rest.repartition("part", "k").sortWithinPartitions("part", "k", "row").mapInPandas(numbers, f"k {kinds[key]}, o {kinds[order]}, batch long")
    return numbers_of.select(F.col("k").alias(key), F.col("o").alias(order), "batch")


def packed_counts(rows: DataFrame, key: str, order: str, size: str, most_rows: int = 8, most_size: int = 24_000) -> DataFrame:
    """key, batches: the number of batches that `packed` makes."""
    return packed(rows, key, order, size, most_rows, most_size).groupBy(key).agg((F.max("batch") + 1).alias("batches"))


def chunked(rows: DataFrame, order: str, n: int, by: str) -> DataFrame:
    """rows with chunk: runs of n rows in order within `by`. No task holds a key's rows."""
    return numbered(rows, [order], [by]).withColumn("chunk", F.floor(F.col("place") / n).cast("long")).drop("place")


def error_runs(rows: DataFrame, by: str, order: str, failed: Column, limit: int = 3) -> DataFrame:
    """by, first_success (its place), leading_errors, aborts: the run of failures before the first success, and whether it reaches the limit. order: unique. Counts alone, so a key may be large."""
    seen = rows.select(by, F.col(order).alias("_o"), F.coalesce(failed, F.lit(False)).alias("_failed"))
    first = seen.groupBy(by).agg(F.min(F.when(~F.col("_failed"), F.col("_o"))).alias("_first"))
    joined = seen.join(first.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
    out = joined.groupBy(by).agg(F.count_if(F.col("_first").isNull() | (F.col("_o") < F.col("_first"))).alias("leading"), F.first("_first").isNotNull().alias("won"))
    return out.select(by, F.when(F.col("won"), F.col("leading") + 1).cast("int").alias("first_success"), F.col("leading").cast("long").alias("leading_errors"), (F.col("leading") >= limit).alias("aborts"))


def error_islands(rows: DataFrame, by: str, order: str, failed: Column) -> DataFrame:
    """by, island, n, first, last: every run of consecutive failures. Its number is that of the successes before it: a failure's place among all rows less
    its place among the failures. No task holds a key's rows."""
    placed = numbered(rows.select(by, order, failed.alias("_failed")), [order], [by]).withColumnRenamed("place", "_all")
    marked = numbered(placed.where("_failed"), [order], [by]).withColumn("island", F.col("_all") - F.col("place"))
    return marked.groupBy(by, "island").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))


def asked_once(rows: DataFrame, by: str, order: list[str], item: str, known: DataFrame) -> DataFrame:
    """by, items: each item of a request once, in order of its first place; items that known (item) lacks are dropped. Items are folded before lists are made."""
    first = rows.join(known.select(item).distinct(), item, "left_semi").groupBy(by, item).agg(F.min(F.struct(*order)).alias("_first"))
    listed = F.sort_array(F.collect_list(F.struct("_first", item)))
    return first.groupBy(by).agg(F.transform(listed, lambda x: x[item]).alias("items"))


def matched(asked: DataFrame, answers: DataFrame, key: str, position: str) -> DataFrame:
    """asked rows with the last usable answer to each: no error, and a score within 0 and 100. Answers to what was not asked are ignored."""
    usable = answers.where(F.col("score").between(0, 100) & F.col("error").isNull())
    last = usable.groupBy(key).agg(F.max_by(F.struct(*[c for c in answers.columns if c != key]), F.col(position)).alias("answer"))
    return asked.join(last, key, "left")


#: The parts of a score with their weights.
RUBRIC = {"skills_overlap": 30, "experience_match": 25, "role_fit": 20, "domain_fit": 15, "hard_requirements": 10}


def reconciled(score: Column, points: list[Column], tolerance: int = 5) -> Column:
    """The model's score, or the sum of its parts where all are there and differ from it by more than the tolerance; 0 to 100."""
    total = points[0]
    for p in points[1:]:
        total = total + p
    fitted = F.greatest(F.lit(0), F.least(F.lit(100), total))
    return F.when(total.isNotNull() & (F.abs(total - score) > tolerance), fitted).otherwise(score)
