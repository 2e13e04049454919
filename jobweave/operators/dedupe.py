"""Removal of repeated postings: order-dependent keyed dedupe, fingerprints within a Hamming distance, keepers of groups."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from jobweave.functions.hashes import NEAR, halves
from jobweave.operators.components import components
from jobweave.operators.lineage import cut_lineage, shared_folder
from jobweave.operators.numbering import numbered


def first_wins(rows: DataFrame, keys: list[str], order: str, known: dict[str, DataFrame] | None = None, rounds: int = 6, most: int = 200_000) -> DataFrame:
    """The rows that a pass in `order` (unique, a number) accepts: those that share no key with an earlier accepted row, nor with the known ones.

    A row that is not accepted blocks nobody, so no single ranking gives this. Each round accepts the undecided rows that come first
    under all of their keys (no undecided row can overtake them) and removes those that share a key with them. A null key is shared with none. Only keys and order are shuffled.

    A chain of rows that unblock one another takes a round for each two of its rows. What is undecided after `rounds` is therefore passed over in order, in stretches of at
    most `most` rows (`by_stretches`). Where that would be more than STRETCHES, rows are cut into components of rows that keys lead to one another before, and components
    of at most `most` rows are decided side by side; only larger ones go by stretches.
    """
    slim = rows.select(order, *keys)
    for key, old in (known or {}).items():
        taken = old.select(F.col(key).alias("_old")).distinct()
        slim = slim.join(taken, slim[key] == taken["_old"], "left_anti")
    undecided, accepted, done = cut_lineage(slim), None, 0
    while not undecided.isEmpty():
        if done == rounds:
            if undecided.count() > STRETCHES * most:
                won, undecided = by_component(undecided, keys, order, most)
                accepted = accepted.unionByName(won)
            accepted = accepted.unionByName(by_stretches(undecided, keys, order, most))
            break
        done += 1
        low = undecided
        for key in keys:
            least = undecided.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(f"_low_{key}"))
            low = low.join(least, key, "left")
        leads = [F.col(key).isNull() | (F.col(order) == F.col(f"_low_{key}")) for key in keys]
        won = low
        for lead in leads:
            won = won.where(lead)
        won = cut_lineage(won.select(order, *keys))
        accepted = won if accepted is None else accepted.unionByName(won)
        for key in keys:
            taken = won.where(F.col(key).isNotNull()).select(F.col(key).alias("_old")).distinct()
            undecided = undecided.join(taken, undecided[key] == taken["_old"], "left_anti")
        undecided = cut_lineage(undecided.join(won.select(F.col(order).alias("_won")), F.col(order) == F.col("_won"), "left_anti"))
    return rows.join(accepted.select(order), order) if accepted is not None else rows.limit(0)


#: Stretches that are passed over one after another before it pays to look for components.
STRETCHES = 64


def by_stretches(rows: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """Of rows (order, keys) those accepted by a pass in order, stretch by stretch: what each decides needs the ones before it, so no more than `most` rows are in a task at once.

    A taken key is handed on, as a file of the next stretch that holds it, so each stretch reads its own rows and what was handed to it, and all steps together read each key as often
    as it occurs.
    """
    if rows.count() <= most:
        return cut_lineage(one_pass(rows.withColumn("_home", F.lit(0).cast("long")).coalesce(1), keys, order))
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/stretches-{uuid.uuid4().hex}"
    placed = numbered(rows.select(order, *keys), [order]).withColumn("_home", F.floor(F.col("place") / most).cast("long")).drop("place")
    placed.repartition("_home").write.partitionBy("_home").parquet(f"{folder}/rows")
    kinds, own = dict(rows.dtypes), StructType([rows.schema[c] for c in (order, *keys)])
    # Each key with the stretches that hold it, and the next one behind each: a row for each stretch, so a key of many rows is short.
    held = spark.read.schema(StructType([*own, StructField("_home", LongType())])).parquet(f"{folder}/rows")
    values = lambda df, k: df.where(F.col(keys[k]).isNotNull()).select(F.lit(k).alias("_key"), *[F.col(c) if c == keys[k] else F.lit(None).cast(kinds[c]).alias(c) for c in keys], *[c for c in ("_home",) if c in df.columns])
    places = values(held, 0)
    for k in range(1, len(keys)):
        places = places.unionByName(values(held, k))
    onward = Window.partitionBy("_key", *keys).orderBy("_home")
    places.distinct().withColumn("_next", F.lead("_home").over(onward)).where("_next is not null").repartition("_home").write.partitionBy("_home").parquet(f"{folder}/next")
    following = spark.read.schema(StructType([StructField("_key", IntegerType()), *own.fields[1:], StructField("_next", LongType()), StructField("_home", LongType())])).parquet(f"{folder}/next")
    handed = StructType([StructField("_key", IntegerType()), *own.fields[1:], StructField("_next", LongType())])
    spark.createDataFrame([], handed).write.partitionBy("_next").parquet(f"{folder}/taken")
    for home in range(held.agg(F.max("_home")).first()[0] + 1):
        left = held.where(F.col("_home") == home).select(order, *keys)
        taken = spark.read.schema(handed).parquet(f"{folder}/taken").where(F.col("_next") == home).drop("_next")
        for k, key in enumerate(keys):
            left = left.join(taken.where(F.col("_key") == k).select(F.col(key).alias("_old")).distinct(), F.col(key) == F.col("_old"), "left_anti")
        one_pass(left.withColumn("_home", F.lit(home).cast("long")).coalesce(1), keys, order).write.parquet(f"{folder}/won/_home={home}")
        won = spark.read.schema(own).parquet(f"{folder}/won/_home={home}")
        for k in range(len(keys)):
            taken = taken.unionByName(values(won, k))
        same = F.lit(True)
        new = taken.distinct().select(*[F.col(c).alias(f"_{c}_") for c in ("_key", *keys)])
        for c in ("_key", *keys):
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}_"))
        following.where(F.col("_home") == home).join(new, same, "left_semi").select("_key", *keys, "_next").coalesce(1).write.mode("append").partitionBy("_next").parquet(f"{folder}/taken")
    return spark.read.schema(own).parquet(f"{folder}/won").select(order, *keys)


def one_pass(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows (_home, order, keys), each home's whole in a partition, those that a pass over it accepts."""
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A home's rows come in order; what is held are the keys that it has taken so far."""
        home, taken = None, set()
        for batch in batches:
            kept = []
            for row in batch.itertuples(index=False):
                if row[0] != home:
                    home, taken = row[0], set()
                own = {(k, v) for k, v in enumerate(row[2:]) if not pd.isna(v)}
                kept.append(not own & taken)
                if kept[-1]:
                    taken |= own
            yield batch[kept][[order, *keys]]

    ordered = rows.select("_home", order, *keys).sortWithinPartitions("_home", order)
    return ordered.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in [order, *keys]))


def by_component(rows: DataFrame, keys: list[str], order: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Of rows (order, keys) those accepted by a pass over each component of at most `most` rows, and the rows of larger components, undecided."""
    edges = None
    for key in keys:
        # A star for each key: its first row with each other one.
        least = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("src"))
        star = rows.join(least, key).select("src", F.col(order).alias("dst"))
        edges = star if edges is None else edges.unionByName(star)
    homes = components(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")))
    placed = rows.join(homes.withColumnRenamed("id", "_id"), rows[order] == F.col("_id"), "left").select(order, *keys, F.coalesce("component", F.col(order).cast("long")).alias("_home"))
    sizes = placed.groupBy("_home").agg(F.count("*").alias("_n"))
    placed = cut_lineage(placed.join(sizes, "_home"))
    won = cut_lineage(one_pass(placed.where(F.col("_n") <= most).repartition("_home"), keys, order))
    return won, cut_lineage(placed.where(F.col("_n") > most).select(order, *keys))


def blocks_for(n: int, distance: int = NEAR) -> int:
    """Into how many blocks the bits of n fingerprints are cut: so many that keys of all but `distance` of them are about as many as fingerprints."""
    blocks = distance + 1
    while blocks < 2 * distance + 2 and 64 * (blocks - distance) // blocks < (max(1, n // 8)).bit_length():
        blocks += 1
    return blocks


def banded(prints: DataFrame, blocks: int, distance: int = NEAR, keep: tuple[str, ...] = ()) -> DataFrame:
    """print, high, low, the columns to keep, band, value: a row for each choice of `blocks` - `distance` blocks of the bits; two prints that near agree in one choice at least."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]

    def piece(a: int, b: int) -> Column:
        """Bits a to b, counted from the highest: each half holds 32."""
        parts = []
        for half, (lo, hi) in (("high", (max(a, 0), min(b, 32))), ("low", (max(a - 32, 0), min(b - 32, 32)))):
            if lo < hi:
                parts.append(F.shiftright(F.col(half), 32 - hi).bitwiseAND(F.lit((1 << (hi - lo)) - 1)))
        return parts[0] if len(parts) == 1 else F.shiftleft(parts[0], b - 32).bitwiseOR(parts[1])

    pieces = [piece(a, b) for a, b in zip(edges, edges[1:])]
    widths = [b - a for a, b in zip(edges, edges[1:])]
    keys = []
    for chosen in combinations(range(blocks), blocks - distance):
        key = F.lit(0).cast("long")
        for k in chosen:
            key = F.shiftleft(key, widths[k]).bitwiseOR(pieces[k])
        keys.append(key)
    return prints.select("print", "high", "low", *keep, F.posexplode(F.array(*keys)).alias("band", "value"))


def near_pairs(fingerprints: DataFrame, distance: int = NEAR) -> DataFrame:
    """print_a < print_b within the distance, of different fingerprints (print): a row for each pair of values.

    Equal fingerprints are collapsed first, so a text that is posted a million times is one value; members are joined back by whoever needs them. The keys
    grow with the number of values, so candidates stay about as many as values.
    """
    high, low = halves(F.col("print"))
    prints = cut_lineage(fingerprints.where("print is not null").select("print").distinct().select("print", high.alias("high"), low.alias("low")))
    bands = banded(prints, blocks_for(prints.count(), distance), distance)
    side = lambda x: bands.select("band", "value", *[F.col(c).alias(f"{c}_{x}") for c in ("print", "high", "low")])
    apart = F.bit_count(F.col("high_a").bitwiseXOR(F.col("high_b"))) + F.bit_count(F.col("low_a").bitwiseXOR(F.col("low_b")))
    return side("a").join(side("b"), ["band", "value"]).where((F.col("print_a") < F.col("print_b")) & (apart <= distance)).select("print_a", "print_b").distinct()


def near_links(rows: DataFrame, distance: int = NEAR, days: int | None = 30) -> DataFrame:
    """id, parent: of each row (id, print, at) the first earlier row, by time and id, within the distance and the days.

    Values are joined, not rows. Without days a value's first row stands for it; with days each value's rows, one for each time, go in order past those of its
    near values, in stretches of so many days.
    """
    rows = cut_lineage(rows.where("print is not null").select("id", "print", "at"))
    pairs = near_pairs(rows, distance)
    both = pairs.unionByName(pairs.select(F.col("print_b").alias("print_a"), F.col("print_a").alias("print_b")))
    firsts = rows.groupBy("print", "at").agg(F.min("id").alias("id")).select("print", F.struct("at", "id").alias("first"))
    if days is None:
        firsts = firsts.groupBy("print").agg(F.min("first").alias("first"))
    # The first rows of each value and of all values near it.
    near = both.join(firsts, both["print_b"] == firsts["print"]).select(F.col("print_a").alias("print"), "first").unionByName(firsts)
    own = F.struct("at", "id")
    if days is None:
        best = near.groupBy("print").agg(F.min("first").alias("first"))
        return rows.join(best, "print").where(F.col("first") < own).select("id", F.col("first.id").alias("parent"))
    span = days * 86_400_000_000
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    at = micros(F.col("first.at"))
    lot = F.floor(at / span).cast("long")
    met = near.select("print", at.alias("t"), "first", F.explode(F.array(lot, lot + 1)).alias("lot"))
    times = rows.groupBy("print", "at").agg(F.count("*").alias("n")).select("print", micros(F.col("at")).alias("t"), F.col("at").alias("own_at"))
    asked = times.withColumn("lot", F.floor(F.col("t") / span).cast("long"))
    frame = Window.partitionBy("print", "lot").orderBy("t").rangeBetween(-span, 0)
    stream = met.select("print", "lot", "t", "first", F.lit(None).cast(rows.schema["at"].dataType).alias("own_at")).unionByName(
        asked.select("print", "lot", "t", F.lit(None).cast(near.schema["first"].dataType).alias("first"), "own_at")
    )
    best = stream.withColumn("best", F.min("first").over(frame)).where("own_at is not null").select("print", F.col("own_at").alias("at"), "best")
    return rows.join(best, ["print", "at"]).where(F.col("best") < own).select("id", F.col("best.id").alias("parent"))


def canonical(links: DataFrame) -> DataFrame:
    """id, root: where each chain of parents ends, by doubling the pointers until none moves."""
    now = cut_lineage(links.select("id", "parent"))
    while True:
        onward = now.select(F.col("id").alias("parent"), F.col("parent").alias("_next"))
        moved = cut_lineage(now.join(onward, "parent", "left").select("id", F.coalesce("_next", "parent").alias("parent"), F.col("_next").isNotNull().alias("_moved")))
        if moved.where("_moved").isEmpty():
            return moved.select("id", F.col("parent").alias("root"))
        now = moved.select("id", "parent")


def keepers(rows: DataFrame, group: list[str], archived: str, order: str) -> DataFrame:
    """rows with keeper (the group's first row that is not archived, else its first) and archive (others that are to be archived now). order: unique. A minimum for each group, so a group may
    be large; keepers are found by their order, so its rows need not meet."""
    first = rows.groupBy(*group).agg(F.min(F.struct(F.col(archived), F.col(order).alias("_o"))).alias("_first")).select(F.col("_first._o").alias("_keeper"))
    marked = rows.join(first, rows[order] == first["_keeper"], "left").withColumn("keeper", F.col("_keeper").isNotNull()).drop("_keeper")
    return marked.withColumn("archive", ~F.col("keeper") & ~F.col(archived))


def groups(rows: DataFrame, group: list[str], member: str) -> DataFrame:
    """Groups of two rows and more: a row for each member, with the group's number of rows. No group is gathered in one row."""
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1")
    return rows.select(*group, member).join(sizes, group)


def first_only(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with `key` kept by the first that has it, null for the others. order: unique. Rows are joined by it, so equal keys need not meet."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first")).select("_first")
    marked = rows.join(first, rows[order] == first["_first"], "left")
    return marked.withColumn(key, F.when(F.col("_first").isNotNull(), F.col(key))).drop("_first")


def new_members(rows: DataFrame, existing: DataFrame, key: Callable[[Column], Column], column: str) -> DataFrame:
    """rows whose key of `column` is not among that of existing rows."""
    seen = existing.select(key(F.col(column)).alias("_seen")).distinct()
    return rows.join(seen, key(rows[column]) == seen["_seen"], "left_anti")
