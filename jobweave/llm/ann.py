"""Approximate nearest neighbours by cross-polytope hashing.

Pseudo-rotations (sign flips and fast Hadamard transforms) turn each vector; its hash is the nearest signed axis, in
each of several tables. A query probes in each table the buckets whose axes are nearest to it, and what lies there is ranked by exact
inner products in double precision. How many buckets to probe is measured: a bounded sample of queries is
compared with every row, and the least number that reaches the wanted recall on them is used for all.

Vectors of unequal length get one more coordinate that makes them equally long, so that the largest inner product is the smallest angle.
Equal vectors are one entry with its `k + 1` smallest ids, as no other of its ids can be in a result. A bucket of
many entries is split into blocks of bounded size, each of which meets all queries of the bucket.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.common import cut_lineage


@dataclass(frozen=True)
class AnnParams:
    k: int = 20
    tables: int = 4
    block_rows: int = 4096  # entries of a bucket that are held together
    tuning_queries: int = 64  # sampled queries that are compared with all rows
    recall: float = 0.95  # that the probes must reach on them
    seed: int = 7


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; their length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        pairs = x.reshape(len(x), -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


@dataclass(frozen=True)
class CrossPolytope:
    """The hash functions. Each table's code is made of one or more axes: as many as keep buckets near block_rows entries."""

    dims: int
    longest: float  # norm
    lift: bool  # norms differ: add the coordinate that makes them equal
    sizes: tuple[int, ...]  # signed axes of each function of a table
    params: AnnParams
    width: int = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "width", 1 << (self.dims + self.lift - 1).bit_length())

    @staticmethod
    def over(dims: int, rows: int, shortest: float, longest: float, params: AnnParams) -> CrossPolytope:
        lift = shortest < 0.999 * longest
        axes = 1 << (dims + lift - 1).bit_length()
        sizes, left = [2 * axes], rows / (2 * axes) / params.block_rows
        while left > 1:
            sizes.append(2 * min(axes, 1 << max(0, int(np.ceil(np.log2(left))) - 1)))
            left /= sizes[-1]
        return CrossPolytope(dims, longest, lift, tuple(sizes), params)

    @property
    def buckets(self) -> int:
        return int(np.prod(self.sizes, dtype=np.int64))

    def turned(self, x: np.ndarray, query: bool) -> list[list[np.ndarray]]:
        """The signed coordinates of each row under each function of each table."""
        wide = np.zeros((len(x), self.width))
        norm = np.linalg.norm(x, axis=1)
        if query:
            wide[:, : self.dims] = x / norm[:, None]
        else:
            wide[:, : self.dims] = x / self.longest
            if self.lift:
                wide[:, self.dims] = np.sqrt(np.maximum(0, 1 - (norm / self.longest) ** 2))
        rng, out = np.random.default_rng(self.params.seed), []
        for _ in range(self.params.tables):
            parts = []
            for size in self.sizes:
                y = wide
                for _ in range(3):
                    y = hadamard(y * rng.choice((-1.0, 1.0), self.width))
                y = y[:, : max(1, size // 2)]
                parts.append(np.stack([y, -y], axis=2).reshape(len(x), -1))
            out.append(parts)
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the table is part of the code."""
        out = []
        for t, parts in enumerate(self.turned(x, False)):
            code = np.full(len(x), t, np.int64)
            for size, y in zip(self.sizes, parts, strict=True):
                code = code * size + y.argmax(axis=1)
            out.append(code)
        return np.stack(out, axis=1)

    def probes(self, x: np.ndarray, n: int) -> np.ndarray:
        """(rows, tables, n): the buckets in order of the summed squared distance of their axes from the nearest ones."""
        n, out = min(n, self.buckets), []
        for t, parts in enumerate(self.turned(x, True)):
            code, cost = np.full((len(x), 1), t, np.int64), np.zeros((len(x), 1))
            for size, y in zip(self.sizes, parts, strict=True):
                lag = (y.max(axis=1, keepdims=True) - y) ** 2
                cost = (cost[:, :, None] + lag[:, None, :]).reshape(len(x), -1)
                code = (code[:, :, None] * size + np.arange(size)).reshape(len(x), -1)
                best = np.argsort(cost, axis=1, kind="stable")[:, :n]
                code, cost = np.take_along_axis(code, best, 1), np.take_along_axis(cost, best, 1)
            out.append(code)
        return np.stack(out, axis=1)


def exact_best(queries: np.ndarray, entries: np.ndarray, first_id: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query the n best entries (index, inner product), best first, ties to the smaller first id; -1 where there are fewer."""
    rough = queries @ entries.T
    spare = min(len(entries), n + 8)  # room for the rounding of a matrix product
    near = np.argpartition(-rough, spare - 1, axis=1)[:, :spare]
    floor = np.take_along_axis(rough, near, 1).min(axis=1)
    tied = np.flatnonzero((rough >= floor[:, None]).sum(axis=1) > spare)
    score = (queries[:, None, :] * entries[near]).sum(axis=2)
    order = np.lexsort((first_id[near], -score), axis=1)[:, :n]
    best, score = np.take_along_axis(near, order, 1), np.take_along_axis(score, order, 1)
    for q in tied.tolist():  # as many equal scores as fill the room: all of them are compared
        some = np.flatnonzero(rough[q] >= floor[q] - 1e-9 * (1 + abs(floor[q])))
        exact = (queries[q] * entries[some]).sum(axis=1)
        order = np.lexsort((first_id[some], -exact))[:n]
        best[q, : len(order)], score[q, : len(order)] = some[order], exact[order]
    if spare < n:
        pad = ((0, 0), (0, n - spare))
        best, score = np.pad(best, pad, constant_values=-1), np.pad(score, pad)
    return best, score


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), h1, h2 (hashes of v): one row for each vec_id, of the most frequent length (the larger, if two are)."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(fine)
    # -0.0 is 0.0, so that equal vectors have equal hashes.
    return rows.groupBy("vec_id").agg(F.min(F.transform("v", lambda x: x + F.lit(0.0))).alias("v")).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})


def fitted(entries: DataFrame, params: AnnParams) -> CrossPolytope | None:
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    found = entries.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.min(norm).alias("low"), F.max(norm).alias("high")).orderBy(F.desc("n"), F.desc("dims")).first()
    return CrossPolytope.over(found["dims"], found["n"], found["low"], found["high"], params) if found else None


def tuned_probes(entries: DataFrame, sample: list, index: CrossPolytope) -> int:
    """The least number of probes a table that finds the wanted share of the sampled queries' true neighbours: all buckets, if it takes them."""
    params = index.params
    if not sample:
        return 1
    q = np.array([r["v"] for r in sample])
    own = [(r["h1"], r["h2"]) for r in sample]
    # The place of each bucket in each query's order, by table.
    place = np.argsort(index.probes(q, index.buckets), axis=2).astype(np.int32)
    shared = entries.sparkSession.sparkContext.broadcast((q, own, place))

    def scan(batches):
        queries, own, place = shared.value
        table = np.arange(params.tables)
        kept = [[] for _ in own]
        for batch in batches:
            x = matrix(batch.column(0), index.dims)
            if not len(x):
                continue
            ids, codes = batch.column(3).to_numpy(), index.codes(x)
            h1, h2 = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            best, score = exact_best(queries, x, ids, params.k + 1)
            for k, (at, value) in enumerate(zip(best.tolist(), score.tolist(), strict=True)):
                for a, s in zip(at, value, strict=True):
                    if a >= 0 and (h1[a], h2[a]) != own[k]:
                        kept[k].append((s, -int(ids[a]), int(place[k, table, codes[a] - table * index.buckets].min()) + 1))
                kept[k] = sorted(kept[k], reverse=True)[: params.k]
        rows = [(k, s, i, n) for k, own_rows in enumerate(kept) for s, i, n in own_rows]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["q", "s", "i", "need"])

    found = entries.select("v", "h1", "h2", F.element_at("ids", 1).alias("first")).mapInArrow(scan, "q int, s double, i long, need long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), F.desc("i")))
    # tuning_queries * k rows.
    needs = np.sort([r["need"] for r in found.withColumn("r", rank).where(F.col("r") <= params.k).collect()])
    if not len(needs):
        return 1
    return int(needs[int(np.ceil(params.recall * len(needs))) - 1])


def nearest(vectors: DataFrame, is_query: Column, params: AnnParams | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: of each row for which is_query (over vec_id) holds, the k nearest others found, best first.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null ids and vectors of another than the
    most frequent length. Rows that repeat a vec_id are one (the smallest vector, if they differ). Fewer than k others: all of those found.
    Other columns are ignored.
    """
    params = params or AnnParams()
    spark = vectors.sparkSession
    rows = cut_lineage(usable(vectors))
    rank = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    first = rows.withColumn("r", rank).where(F.col("r") <= params.k + 1)
    entries = cut_lineage(first.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")))
    index = fitted(entries, params)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    entries, rows = (d.where(F.size("v") == index.dims) for d in (entries, rows))
    asked = rows.where(is_query)
    queries = cut_lineage(asked.groupBy("h1", "h2").agg(F.first("v").alias("v")))
    sample = queries.orderBy(F.xxhash64(F.lit(params.seed), "h1", "h2"), "h1", "h2").limit(params.tuning_queries).collect()
    probes = tuned_probes(entries, sample, index)

    def place(batches):
        """An entry's row for each table."""
        for batch in batches:
            if batch.num_rows:
                codes = index.codes(matrix(batch.column(2), index.dims))
                at = pa.array(np.repeat(np.arange(batch.num_rows), params.tables))
                yield pa.RecordBatch.from_arrays([pa.array(codes.ravel()), *(c.take(at) for c in batch.columns)], ["code", *batch.schema.names])

    def probe(batches):
        """A query's row for each table and probe."""
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                codes = index.probes(matrix(part.column(2), index.dims), probes)
                at = pa.array(np.repeat(np.arange(part.num_rows), codes[0].size))
                yield pa.RecordBatch.from_arrays([pa.array(codes.ravel()), *(c.take(at) for c in part.columns)], ["code", *part.schema.names])

    placed = entries.select("h1", "h2", "v", "ids").mapInArrow(place, "code long, h1 long, h2 long, v array<double>, ids array<long>")
    probing = queries.select("h1", "h2", "v").mapInArrow(probe, "code long, h1 long, h2 long, v array<double>")
    sizes = placed.groupBy("code").agg(F.ceil(F.count("*") / params.block_rows).cast("int").alias("blocks")).where("blocks > 1")
    placed = placed.join(sizes, "code", "left").withColumn("block", F.pmod("h1", F.coalesce("blocks", F.lit(1))).cast("int"))
    probing = probing.join(sizes, "code", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    both = placed.select("code", "block", F.lit(0).alias("kind"), "h1", "h2", "v", "ids").unionByName(
        probing.select("code", "block", F.lit(1).alias("kind"), "h1", "h2", "v", F.array().cast("array<long>").alias("ids"))
    )

    def meet(batches):
        """Each block's entries are held, and its queries stream past them."""
        n = params.k + 1
        now, held, x, first_ids = None, [], None, None
        for batch in batches:
            code, block, kind = (batch.column(k).to_numpy() for k in range(3))
            v, ids = matrix(batch.column(5), index.dims), batch.column(6).to_pylist()
            cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0)) + 1
            out = []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(code)], strict=True):
                if a == b:
                    continue
                if (code[a], block[a]) != now:
                    now, held, x = (code[a], block[a]), [], None
                if kind[a] == 0:
                    held.append((v[a:b], ids[a:b]))
                    x = None
                elif held:
                    if x is None:
                        x, member_ids = np.concatenate([h[0] for h in held]), [i for h in held for i in h[1]]
                        first_ids = np.array([i[0] for i in member_ids])
                        held = [(x, member_ids)]
                    for c in range(a, b, 256):
                        d = min(c + 256, b)
                        best, score = exact_best(v[c:d], x, first_ids, n)
                        for q in range(d - c):
                            got = [(s, -i) for e, s in zip(best[q].tolist(), score[q].tolist(), strict=True) if e >= 0 for i in held[0][1][e]]
                            if len(got) > n:
                                got = sorted(got, reverse=True)[:n]
                            out.append((c + q, [-i for _, i in got], [s for s, _ in got]))
            at = pa.array([o[0] for o in out], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(3).take(at), batch.column(4).take(at), pa.array([o[1] for o in out], pa.list_(pa.int64())), pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["h1", "h2", "near", "score"]
            )

    met = both.repartition("code", "block").sortWithinPartitions("code", "block", "kind").mapInArrow(meet, "h1 long, h2 long, near array<long>, score array<double>")

    def merge(batches):
        """The best of what all blocks found for each query."""
        n, now, best = params.k + 1, None, {}

        def close(done):
            if now is not None:
                order = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:n]
                done.append((*now, [i for i, _ in order], [s for _, s in order]))

        def batch_of(done):
            columns = list(zip(*done, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())), strict=True)], ["h1", "h2", "near", "score"])

        for batch in batches:
            done = []
            for h1, h2, near, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h1, h2) != now:
                    close(done)
                    now, best = (h1, h2), {}
                best.update(zip(near, score, strict=True))
                if len(best) > 64 * n:
                    best = dict(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:n])
            yield batch_of(done)
        done = []
        close(done)
        yield batch_of(done)

    found = met.repartition("h1", "h2").sortWithinPartitions("h1", "h2").mapInArrow(merge, "h1 long, h2 long, near array<long>, score array<double>")
    pairs = F.filter(F.arrays_zip("near", "score"), lambda x: x["near"] != F.col("query_id"))
    listed = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").join(found, ["h1", "h2"]).select("query_id", F.posexplode(F.slice(pairs, 1, params.k)).alias("place", "x"))
    return listed.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.near").alias("vec_id"), "x.score")
