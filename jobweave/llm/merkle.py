"""A Merkle manifest of a dataset: digests of rows, a tree over each group's rows in order, a tree over the groups' roots, and a proof for each row.

Trees are collapsed by expressions. The leaves of a group are dealt, in order, to blocks of `arity ** levels` places; a block's leaves are one ordered array, from which `aggregate`
builds level after level, each a `transform` over a `sequence` of runs that hashes `slice`s of the level below. What a block comes to is a leaf of the next round, whose blocks are
smaller in number by the block's size, until each group is one node. Only digests and ids move; texts are read once.

The place of a row in its group comes from a range partitioning and counts per partition, so no task holds a group: partitions are of bounded size,
and a group's rows meet in blocks only. Proofs come down the same way: a block takes the path above it once for all of its leaves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.common import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before:string,after:string>"


@dataclass(frozen=True)
class MerkleParams:
    arity: int = 3  # consecutive nodes that make one node of the next level
    levels: int = 6  # that a block collapses: it holds arity ** levels leaves, 729


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the texts, one behind another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as bytes that no other value has: its length and itself, or - where it is null."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(*(field(v) for v in values))


def placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (g, ...) with `n`, the leaves of the group, and `at`, the place in it (from 0) by `order`."""
    # Rows alike in all of `order` are spread over partitions too, by where they were read.
    tied = cut_lineage(leaves.withColumn("_tie", F.monotonically_increasing_id()))
    keys = ["g", *order, "_tie"]
    ranged = tied.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = cut_lineage(ranged.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    counts = rows.groupBy("g", "_part").agg(F.count("*").alias("_here"), F.min("_row").alias("_first"))
    whole = Window.partitionBy("g")  # a row for each partition that holds some of the group
    counts = counts.withColumns({"n": F.sum("_here").over(whole), "_before": F.sum("_here").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))})
    return rows.join(counts, ["g", "_part"]).withColumn("at", F.coalesce("_before", F.lit(0)) + F.col("_row") - F.col("_first")).drop("_tie", "_part", "_row", "_here", "_first", "_before")


def collapsed(leaves: Column, n: Column, params: MerkleParams) -> Column:
    """All levels of a block, the leaves first: array<array<string>>. A level is hashed while the group has more than one node on it."""

    def above(level: Column) -> Column:
        runs = F.sequence(F.lit(0), F.ceil(F.size(level) / params.arity).cast("int") - 1)
        return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(level, r * params.arity + 1, F.lit(params.arity)), ""), 256))

    def grown(levels: Column, k: Column) -> Column:
        top = F.element_at(levels, -1)
        more = n > F.pow(F.lit(params.arity), k - 1)
        return F.when(more, F.concat(levels, F.array(above(top)))).otherwise(levels)

    return F.aggregate(F.sequence(F.lit(1), F.lit(params.levels)), F.array(leaves), grown)


def steps(levels: Column, slot: Column, params: MerkleParams) -> Column:
    """The siblings of a block's leaf on each level that was hashed: those before and those behind it."""

    def step(k: Column) -> Column:
        level = F.element_at(levels, k + 1)
        index = F.floor(slot / F.pow(F.lit(params.arity), k)).cast("int")
        first = index - index % params.arity
        before, after = F.slice(level, first + 1, index - first), F.slice(level, index + 2, first + params.arity - 1 - index)
        return F.struct(F.array_join(before, "").alias("before"), F.array_join(after, "").alias("after"))

    depth = F.size(levels) - 1
    return F.when(depth > 0, F.transform(F.sequence(F.lit(0), depth - 1), step)).otherwise(F.array().cast(f"array<{STEP}>"))


def blocks_of(nodes: DataFrame, params: MerkleParams) -> DataFrame:
    """nodes (g, n, at, h, payload) as blocks: g, n, block, members (at, payload, in order), levels. Written once, as the way up and the way down read it."""
    size = params.arity**params.levels
    members = F.sort_array(F.collect_list(F.struct("at", "h", "payload"))).alias("_m")
    held = nodes.groupBy("g", "n", F.floor(F.col("at") / size).alias("block")).agg(members)
    levels = collapsed(F.transform("_m", lambda m: m["h"]), F.col("n"), params)
    return cut_lineage(held.select("g", "n", "block", F.transform("_m", lambda m: F.struct(m["at"].alias("at"), m["payload"].alias("payload"))).alias("members"), levels.alias("levels")))


def roots_of(blocks: DataFrame, params: MerkleParams) -> DataFrame:
    """The next round's nodes: one for each block."""
    size = params.arity**params.levels
    return blocks.select("g", F.ceil(F.col("n") / size).alias("n"), F.col("block").alias("at"), F.element_at(F.element_at("levels", -1), 1).alias("h"), F.lit(None).cast("string").alias("payload"))


def risen(nodes: DataFrame, params: MerkleParams) -> list[DataFrame]:
    """The blocks of each round, until every group is one node."""
    rounds = [blocks_of(nodes, params)]
    while not rounds[-1].where("block > 0").isEmpty():
        rounds.append(blocks_of(roots_of(rounds[-1], params), params))
    return rounds


def opened(blocks: DataFrame, params: MerkleParams) -> DataFrame:
    """g, at, payload, path, carry of each member of blocks that have the path above them (`path`) and what hangs on the group (`carry`)."""
    own = steps(F.col("levels"), (F.col("m.at") - F.col("block") * params.arity**params.levels).cast("int"), params)
    rows = blocks.select("*", F.explode("members").alias("m"))
    return rows.select("g", F.col("m.at").alias("at"), F.col("m.payload").alias("payload"), F.element_at(F.col("levels")[0], (F.col("m.at") - F.col("block") * params.arity**params.levels + 1).cast("int")).alias("h"), F.concat(own, "path").alias("path"), "carry")


def descended(rounds: list[DataFrame], tops: DataFrame, params: MerkleParams) -> DataFrame:
    """The leaves of the first round with their paths. tops (g, path, carry): what stands above each group."""
    above = tops.select("g", F.lit(0).cast("long").alias("block"), "path", "carry")
    for blocks in reversed(rounds[1:]):
        above = opened(blocks.join(above, ["g", "block"]), params).select("g", F.col("at").alias("block"), "path", "carry")
    return opened(rounds[0].join(above, ["g", "block"]), params)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path come to."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["before"], h, s["after"]))


def manifest(docs: DataFrame, presented: Column | None = None, params: MerkleParams | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each row of docs (doc_id, source, lang, n_chars, text).

    A leaf is the digest of a row's fields; each source's leaves, by doc_id (null first, then by digest), make its subroot, and these, by source (null first, then bytewise), the
    root. proof_sha256 is the digest of all siblings from the leaf to the root. `presented` is the text that is held against the manifest (the row's own, if
    not given): folded_root is what the leaf with it comes to over the original siblings, and verified whether that is the root.

    Null fields count as `-`, which no value is written as. Rows alike in all fields are leaves of their own, next to one another; they have one leaf, and
    proofs of different places. A lone leaf is its source's subroot, a lone subroot the root, and a proof without siblings the digest of nothing. Nothing comes of an empty
    table. Other columns are ignored.
    """
    params = params or MerkleParams()
    fields = [F.col(c) for c in FIELDS]
    shown = leaf_of(*fields[:-1], presented if presented is not None else fields[-1])
    # A null source's group sorts before all others.
    group = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    leaves = docs.select(group.alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(*fields).alias("h"), shown.alias("shown"))
    ids = F.struct("doc_id", F.when(F.col("shown") != F.col("h"), F.col("shown")).alias("shown")).alias("payload")
    rounds = risen(placed(leaves, ["doc_id", "h"]).select("g", "n", "at", "h", ids), params)
    subroots = rounds[-1].select(F.lit("all").alias("g"), F.col("g").alias("payload"), F.element_at(F.element_at("levels", -1), 1).alias("h"))
    upper = risen(placed(subroots, ["payload"]).select("g", "n", "at", "h", "payload"), params)
    top = upper[-1].select("g", F.array().cast(f"array<{STEP}>").alias("path"), F.element_at(F.element_at("levels", -1), 1).alias("carry"))
    over = descended(upper, top, params).select(F.col("payload").alias("g"), "path", F.struct(F.col("h").alias("subroot"), F.col("carry").alias("root")).alias("carry"))
    rows = descended(rounds, over, params)
    root = F.col("carry.root")
    back = F.coalesce(folded(F.coalesce("payload.shown", "h"), F.col("path")), F.lit(""))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    out = rows.select(F.col("payload.doc_id").alias("doc_id"), F.col("h").alias("leaf"), F.col("carry.subroot").alias("subroot"), root.alias("root"), proof.alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
