"""Near-duplicate detection by b-bit MinHash.

One scan turns each text into its set's size, a 128-bit digest of the set, `bands` band keys and a packed
signature of the low `BITS` bits of each minimum. Equal sets collapse to one representative. Band keys
join representatives into candidate families (only ids move). Each family's sets then move once, in blocks
of bounded size; within a block the packed signatures' bit counts give a collision-corrected similarity that
prunes pairs, and exact intersections of the full sets confirm the links. Only spanning links leave a block.
Families over one block share hub members across blocks; what a family's blocks leave unmerged
meets all other members of the family in a second pass, by pairs of bounded parts, so no link between blocks is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import U64, WordHasher, chunks, connected_components, cut_lineage, mix64, relabelled, seeded, shingle_hashes, utf8_buffers

BITS = 4


@dataclass(frozen=True)
class MinHashParams:
    """Thresholds are whole numbers: documents link where 100 * intersection >= percent * union."""

    words: int = 5
    percent: int = 80
    rows: int = 6
    bands: int = 28
    block_docs: int = 1024
    block_shingles: int = 1_000_000
    hubs: int = 32
    slack: float = 6.0  # standard errors of the estimate that a pair may lie under the threshold

    @property
    def minima(self) -> int:
        return self.rows * self.bands


def text_sets(data: np.ndarray, bounds: np.ndarray, hasher: WordHasher, words: int) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    for first, last in chunks(bounds):
        part = bounds[first : last + 1]
        hashes, _, _, own = hasher(data[part[0] : part[-1]], part - part[0])
        for k in range(last - first):
            yield np.unique(shingle_hashes(hashes[own[k] : own[k + 1]], words))


def minima_of(shingles: np.ndarray, factors: np.ndarray, step: int = 4096) -> np.ndarray:
    low = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    top = (shingles >> U64(32)).astype(np.uint32)
    for k in range(0, len(top), step):
        np.minimum(low, (top[k : k + step, None] * factors[None, :]).min(axis=0), out=low)
    return low


def pack(minima: np.ndarray) -> bytes:
    """The low BITS of each minimum, two to a byte, padded to whole 64-bit words."""
    nibbles = (minima & 15).astype(np.uint8)
    nibbles = np.concatenate([nibbles, np.zeros(-len(nibbles) % 16, np.uint8)])
    return (nibbles[0::2] | nibbles[1::2] << 4).tobytes()


def estimate(a: np.ndarray, b: np.ndarray, minima: int) -> np.ndarray:
    """Collision-corrected similarity of each row of a with each of b (packed signatures as 64-bit words)."""
    differ = a[:, None, :] ^ b[None, :, :]
    differ |= differ >> U64(1)
    differ |= differ >> U64(2)
    differ &= U64(0x1111111111111111)
    same = 1 - np.bitwise_count(differ).sum(axis=2, dtype=np.int64) / minima
    chance = 2.0**-BITS
    return (same - chance) / (1 - chance)


def sketches(docs: DataFrame, params: MinHashParams) -> DataFrame:
    """doc_id, n_shingles, digest (two longs), keys (a band key each) and packed signature, in one scan."""

    def scan(batches):
        hasher, factors = WordHasher(), (seeded(params.minima, 3) >> U64(17)).astype(np.uint32) | np.uint32(1)
        mixers = seeded(params.minima, 5).reshape(params.bands, params.rows)
        salt = seeded(params.bands, 9)
        for batch in batches:
            data, bounds = utf8_buffers(batch.column(1))
            n, d1, d2, keys, packed = [], [], [], [], []
            for shingles in text_sets(data, bounds, hasher, params.words):
                n.append(len(shingles))
                d1.append(int(shingles.sum().astype(np.int64)) if len(shingles) else 0)
                d2.append(int(mix64(shingles ^ U64(0x5851F42D4C957F2D)).sum().astype(np.int64)) if len(shingles) else 0)
                if not len(shingles):
                    keys.append([])
                    packed.append(b"")
                    continue
                low = minima_of(shingles, factors)
                band = (low.reshape(params.bands, params.rows).astype(U64) * mixers).sum(axis=1, dtype=U64)
                keys.append(mix64(band ^ salt).astype(np.int64))
                packed.append(pack(low))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(packed, pa.binary())],
                ["doc_id", "n_shingles", "d1", "d2", "keys", "packed"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, packed binary")


class Forest:
    """Union by smallest position, for the members of a block."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def block_links(sets: list[np.ndarray], packed: np.ndarray, groups: np.ndarray, probe: np.ndarray, params: MinHashParams) -> list[tuple[int, int]]:
    """Spanning links between the groups (known components) of a block: exact, among pairs whose estimate is within reach of the threshold.

    probe: members that are compared with the rest; where all are probes, with each other.
    """
    t = params.percent / 100
    reach = t - params.slack * np.sqrt(t * (1 - t) / params.minima) - 0.01
    forest, sizes, out = Forest(len(sets)), np.array([len(s) for s in sets]), []
    seen: dict[int, int] = {}
    for k, g in enumerate(groups.tolist()):
        forest.join(seen.setdefault(g, k), k)
    order = np.arange(len(sets))
    probing = np.zeros(len(sets), bool)
    probing[probe] = True
    for first in range(0, len(probe), 64):
        rows = probe[first : first + 64]
        near = estimate(packed[rows], packed, params.minima) >= reach
        small, large = np.minimum(sizes[rows, None], sizes), np.maximum(sizes[rows, None], sizes)
        near &= 100 * small >= params.percent * large
        near &= (order > rows[:, None]) if len(probe) == len(sets) else ~probing
        for r, mask in zip(rows.tolist(), near, strict=True):
            left, mine = order[mask].tolist(), sets[r]
            while left := [x for x in left if forest.find(x) != forest.find(r)]:
                some, left = left[:64], left[64:]
                theirs = np.concatenate([sets[x] for x in some])
                at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
                both = np.add.reduceat((mine[at] == theirs).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
                for x in np.array(some)[100 * both >= params.percent * (len(mine) + sizes[some] - both)].tolist():
                    if forest.join(r, x):
                        out.append((int(groups[r]), int(groups[x])))
    return out


def _linked(members: DataFrame, params: MinHashParams) -> DataFrame:
    """(src, dst) of the spanning links of each block; members: block, known, probe, text, packed."""

    def scan(batches):
        hasher, held, block = WordHasher(), [], None

        def flush():
            if len(held) < 2:
                return [], []
            known, probe, sets, packed = zip(*held, strict=True)
            links = block_links(list(sets), np.array(packed), np.array(known), np.flatnonzero(probe), params)
            return [a for a, _ in links], [b for _, b in links]

        for batch in batches:
            data, bounds = utf8_buffers(batch.column("text"))
            src, dst = [], []
            columns = [batch.column(c).to_pylist() for c in ("block", "known", "probe", "packed")]
            for b, k, p, s, shingles in zip(*columns, text_sets(data, bounds, hasher, params.words), strict=True):
                if b != block:
                    got = flush()
                    src += got[0]
                    dst += got[1]
                    held, block = [], b
                held.append((k, p, shingles, np.frombuffer(s, U64)))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])
        src, dst = flush()
        yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    # A block is a run of sorted rows, so its partition streams block by block.
    rows = members.select("block", "known", "probe", "text", "packed").repartition("block").sortWithinPartitions("block", "known")
    return rows.mapInArrow(scan, "src long, dst long")


def _blocks(docs, shingles, params: MinHashParams):
    """The number of parts of bounded size."""
    return F.greatest(F.ceil(docs / params.block_docs), F.least(F.ceil(shingles / params.block_shingles), F.ceil(docs / 8))).cast("int")


def _pair_blocks(members: DataFrame, params: MinHashParams) -> DataFrame:
    """members (family, doc_id, n_shingles, probe, ...) with block, repeated for each block they are in.

    A family's probes and the rest of it, never empty, are cut into parts. A block holds one part of the probes and either one part of the rest or one
    other part of the probes, so it is bounded however many probes there are, and each pair with a probe meets in one block.
    Of two different parts of probes only the first is marked so: neither is compared within itself there.
    """
    size = members.groupBy("family", "probe").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    size = size.withColumn("parts", _blocks(F.col("docs"), F.col("shingles"), params)).groupBy("family")
    size = size.agg(F.max(F.when(F.col("probe"), F.col("parts"))).alias("probe_parts"), F.max(F.when(~F.col("probe"), F.col("parts"))).alias("rest_parts"))
    members = members.join(size.where("probe_parts is not null"), "family")
    members = members.withColumn("own", F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.when(F.col("probe"), F.col("probe_parts")).otherwise(F.col("rest_parts"))).cast("int"))
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda kind, a, b, first: F.struct(F.concat_ws(":", F.lit(kind), "family", a, b).alias("block"), first.alias("probe"))
    with_rest = F.transform(up_to("rest_parts"), lambda j: pair("rest", F.col("own"), j, F.lit(True)))
    with_probes = F.transform(up_to("probe_parts"), lambda k: pair("probes", F.least(F.col("own"), k), F.greatest(F.col("own"), k), F.col("own") <= k))
    of_rest = F.transform(up_to("probe_parts"), lambda i: pair("rest", i, F.col("own"), F.lit(False)))
    places = F.when(F.col("probe"), F.concat(with_rest, with_probes)).otherwise(of_rest)
    return members.withColumn("place", F.explode(places)).withColumns({"block": F.col("place.block"), "probe": F.col("place.probe")}).drop("place", "own", "probe_parts", "rest_parts")


def near_duplicates(docs: DataFrame, params: MinHashParams | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: every document with the smallest doc_id it is linked to.

    Null or blank text: an empty set, linked with nothing. Fewer words than a shingle: the whole sequence is the one
    shingle. Rows with a null doc_id take no part; rows that repeat a doc_id are one document, one row of the result.
    Other columns of docs are ignored.
    """
    params = params or MinHashParams()
    docs = docs.where("doc_id is not null")
    sketch = cut_lineage(sketches(docs, params))
    key = ["d1", "d2", "n_shingles"]
    filled = sketch.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("set")).select("doc_id", "set.*").where("n_shingles > 0")
    # Equal sets: one representative each.
    reps = filled.groupBy(*key).agg(F.min("doc_id").alias("rep"))
    of_rep = sketch.join(reps.select(*key, F.col("rep").alias("doc_id")), [*key, "doc_id"], "left_semi").dropDuplicates(["doc_id"])
    bands = of_rep.select(F.col("doc_id"), F.explode("keys").alias("key"))
    lead = bands.groupBy("key").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")).where("n > 1").select("key", "lead")
    stars = bands.join(lead, "key").where("doc_id <> lead").select(F.col("lead").alias("src"), F.col("doc_id").alias("dst"))
    family = connected_components(stars).withColumnRenamed("id", "doc_id").withColumnRenamed("component", "family")

    member = family.join(of_rep.select("doc_id", "n_shingles", "packed"), "doc_id")
    size = member.groupBy("family").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("shingles"))
    size = size.select("family", _blocks(F.col("docs"), F.col("shingles"), params).alias("blocks"))
    member = member.join(size, "family").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    # The members' texts are picked out of all texts once.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    member = cut_lineage(texts.join(member, "doc_id"))

    # Hubs: the members of a large family with the lowest hashes, about `hubs` of them, repeated in all of its blocks.
    share = F.lit(params.hubs) / (F.col("blocks") * params.block_docs)
    is_hub = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_003)) / 1_000_003 < share)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    block = F.concat_ws(":", "family", "part").alias("block")
    first = member.withColumn("part", F.explode(F.when(is_hub, every).otherwise(F.array("part"))))
    links = _linked(first.select(block, F.col("doc_id").alias("known"), F.lit(True).alias("probe"), "text", "packed"), params)
    component = connected_components(links)

    # Second pass, for families over one block: all but the largest component against all members.
    wide = member.where("blocks > 1")
    if not wide.isEmpty():
        parts = component.select(F.col("id").alias("doc_id"), F.col("component").alias("known"))
        wide = cut_lineage(wide.join(parts, "doc_id", "left").withColumn("known", F.coalesce("known", "doc_id")))
        weight = wide.groupBy("family", "known").agg(F.count("*").alias("n"))
        main = weight.groupBy("family").agg(F.max_by("known", F.struct("n", "known")).alias("main"))
        wide = wide.join(main, "family").withColumn("probe", F.col("known") != F.col("main"))
        again = _pair_blocks(wide, params)
        more = connected_components(_linked(again.select("block", "known", "probe", "text", "packed"), params))
        alone = more.join(component, "id", "left_anti")
        component = relabelled(component, more.select(F.col("id").alias("src"), F.col("component").alias("to"))).unionByName(alone)

    component = component.withColumnRenamed("id", "rep").withColumnRenamed("component", "component_id")
    reps = reps.join(component, "rep", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    full = filled.join(reps.select(*key, "component_id"), key).select("doc_id", "n_shingles", "component_id")
    empty = sketch.select("doc_id").distinct().join(filled, "doc_id", "left_anti").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    out = full.unionByName(empty)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
