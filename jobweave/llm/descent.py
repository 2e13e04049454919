"""Near-duplicate vectors by NN-descent.

Equal vectors are one entry. A first neighbour graph comes from sorting the entries by random hyperplane codes and comparing those that stand together. Rounds then
refine it: every entry brings its neighbours, and those whose neighbour it is, together; what they find nearer than their own lists' last goes into these. A list
whose every place holds a link is doubled, so that links are not crowded out, up to a length at which its entry's group is surely held together; a bounded
sample of entries is compared with all to audit the recall, and new codes are drawn while it is too low.

What the graph links loosely is a family. In each family all links are settled in double precision: pairs are compared in blocks of bounded size, and for large families
only where the angles to the family's centre leave it open, as entries within half the link's angle of one centre are linked for sure. Links are counted, not listed;
a block passes on a spanning forest of what it linked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.ann import matrix, usable
from jobweave.llm.common import cut_lineage
from jobweave.operators.components import components as connected_components

LOOSE = 1e-4  # under the threshold: single precision finds, double precision decides
BINS = 40  # that the link's angle is cut into, for angles to a family's centre
SALTS = 16  # parts of a frequent key in a join


@dataclass(frozen=True)
class DescentParams:
    threshold: float = 0.95
    neighbours: int = 16  # of a list at first
    longest: int = 64  # that a list of links alone is enlarged to: families settle the rest
    tables: int = 8  # of codes that make the first graph
    chunk: int = 64  # entries next to one another by code that are compared
    given: int = 4  # the most that an entry takes from one meeting
    rounds: int = 8  # of refinement for each set of tables
    settled: float = 0.05  # share of new edges at which refinement ends
    audited: int = 1024  # entries that are compared with all
    recall: float = 0.99  # of links, on these
    redraws: int = 4  # sets of tables
    block: int = 1024  # entries that a task compares with as many
    seed: int = 7


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that neither large nor small entries leave the range in the squares.
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def entries_of(rows: DataFrame) -> DataFrame:
    """id (smallest vec_id), w (how many vectors), v of each distinct vector."""
    return rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"), F.first("v").alias("v"))


def salted(rows: DataFrame, few: DataFrame, key: str | list[str], by: str, how: str = "inner") -> DataFrame:
    """rows joined with few, which has one row for each key: a frequent key's rows are dealt over SALTS parts."""
    keys = [key] if isinstance(key, str) else key
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    return dealt.join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "_salt"], how).drop("_salt")


def edges_batch(src, dst, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(s, pa.float32())], ["u", "v", "s"])


def rows_of(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def units(entries: DataFrame) -> DataFrame:
    """id, x: unit vectors in single precision, for the search."""

    def scaled(batches):
        for batch in batches:
            dims = len(batch.column(1)[0]) if batch.num_rows else 1
            x = unit(matrix(batch.column(1), dims)).astype(np.float32)
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * dims)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["id", "x"])

    return entries.select("id", "v").mapInArrow(scaled, "id long, x array<float>")


def near_by_code(nodes: DataFrame, dims: int, bits: int, seed: int, params: DescentParams) -> DataFrame:
    """u, v, s: pairs that stand in one chunk when the entries are sorted by the signs of random projections, in each of several tables."""
    planes = np.random.default_rng(seed).normal(size=(params.tables, dims, bits)).astype(np.float32)
    shared = nodes.sparkSession.sparkContext.broadcast(planes)  # tables x dims x at most 60

    def coded(batches):
        weights = 1 << np.arange(bits, dtype=np.int64)[::-1]
        for batch in batches:
            x = rows_of(batch.column(1), dims)
            for t, plane in enumerate(shared.value):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array((x @ plane > 0) @ weights), *batch.columns], ["t", "code", "id", "x"])

    def compared(batches):
        for batch in batches:
            tables, ids, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), rows_of(batch.column(2), dims)
            cuts = np.flatnonzero(np.diff(tables)) + 1
            src, dst, score = [], [], []
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
                for at in range(a, b, params.chunk // 2):  # chunks overlap by half
                    own, y = ids[at : min(b, at + params.chunk)], x[at : min(b, at + params.chunk)]
                    if len(own) < 2:
                        break
                    s = y @ y.T
                    np.fill_diagonal(s, -2)
                    k = min(params.given, len(own) - 1)
                    best = np.argpartition(-s, k - 1, axis=1)[:, :k]
                    src.append(np.repeat(own, k))
                    dst.append(own[best].ravel())
                    score.append(np.take_along_axis(s, best, 1).ravel())
            if src:
                yield edges_batch(np.concatenate(src), np.concatenate(dst), np.concatenate(score))

    ordered = nodes.mapInArrow(coded, "t int, code long, id long, x array<float>").repartitionByRange("t", "code", "id").sortWithinPartitions("t", "code", "id")
    return ordered.select("t", "id", "x").mapInArrow(compared, "u long, v long, s float")


def merged(graph: DataFrame | None, found: DataFrame, params: DescentParams) -> DataFrame:
    """u, v, s, fresh, k: of each entry's old and found neighbours the nearest ones. k is the list's length; a list of links alone is doubled, and then all of it is fresh."""
    both = found.select("u", "v", "s", F.lit(True).alias("fresh"), F.lit(params.neighbours).alias("k"))
    if graph is not None:
        both = both.unionByName(graph.withColumn("fresh", F.lit(False)))
    once = both.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"), F.max("k").alias("k"))
    own = Window.partitionBy("u")  # a list and what one round found for it
    ranked = once.withColumns({"k": F.max("k").over(own), "r": F.row_number().over(own.orderBy(F.desc("s"), "v")), "links": F.count(F.when(F.col("s") >= params.threshold - LOOSE, 1)).over(own)})
    longer = (F.col("links") >= F.col("k")) & (F.col("k") < params.longest)
    sized = ranked.withColumns({"fresh": F.col("fresh") | longer, "k": F.when(longer, F.least(F.col("k") * 2, F.lit(params.longest))).otherwise(F.col("k"))})
    return cut_lineage(sized.where("r <= k").select("u", "v", "s", "fresh", "k"))


def met(graph: DataFrame, nodes: DataFrame, dims: int, params: DescentParams) -> DataFrame:
    """u, v, s: neighbours of a common entry, at least one of them new to it, that are nearer to one another than the last of u's list."""
    # Of those whose neighbour an entry is, as many as a list's length, drawn by hash. They are thinned in parts first: an entry may be the neighbour of very many.
    reverse = graph.select(F.col("v").alias("c"), F.col("u").alias("a"), "fresh", F.xxhash64("u", "v").alias("draw"))
    some = Window.partitionBy("c", F.pmod("draw", F.lit(SALTS))).orderBy(F.desc("fresh"), "draw")
    reverse = reverse.withColumn("r", F.row_number().over(some)).where(F.col("r") <= params.neighbours)
    reverse = reverse.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("fresh"), "draw"))).where(F.col("r") <= params.neighbours)
    members = graph.select(F.col("u").alias("c"), F.col("v").alias("a"), "fresh").unionByName(reverse.select("c", "a", "fresh")).groupBy("c", "a").agg(F.max("fresh").alias("fresh"))
    news = members.where("fresh").select("c").distinct()
    last = graph.groupBy("u").agg(F.when(F.count("*") >= F.max("k"), F.min("s")).otherwise(F.lit(-2.0)).cast("float").alias("last"))
    known = nodes.join(last.withColumnRenamed("u", "id"), "id", "left").select(F.col("id").alias("a"), "x", F.coalesce("last", F.lit(-2.0).cast("float")).alias("last"))
    seated = members.join(news, "c", "left_semi").join(known, "a").select("c", "a", "fresh", "last", "x")

    def meetings(groups):
        """Edges from a list of (ids, fresh, last, x), those of like size compared together."""
        groups.sort(key=lambda g: len(g[0]))
        first = 0
        while first < len(groups):
            upto = first
            wide = 1 << (max(len(groups[first][0]), 2) - 1).bit_length()
            while upto < len(groups) and len(groups[upto][0]) <= wide and upto - first < max(1, (1 << 20) // wide**2):
                upto += 1
            part, n = groups[first:upto], upto - first
            first = upto
            ids, fresh = np.full((n, wide), -1, np.int64), np.zeros((n, wide), bool)
            last, x = np.full((n, wide), 9, np.float32), np.zeros((n, wide, dims), np.float32)
            for k, (i, f, w, y) in enumerate(part):
                ids[k, : len(i)], fresh[k, : len(i)], last[k, : len(i)], x[k, : len(i)] = i, f, w, y
            s = x @ x.transpose(0, 2, 1)
            # -1 may be an id: places beyond a group are told by `last`, which no similarity reaches.
            absent = last > 8
            bad = absent[:, None, :] | (s <= last[:, :, None]) | ~(fresh[:, :, None] | fresh[:, None, :]) | np.eye(wide, dtype=bool)
            s[bad] = -9
            k = min(params.given, wide - 1)
            best = np.argpartition(-s, k - 1, axis=2)[:, :, :k]
            score = np.take_along_axis(s, best, 2)
            g, a, j = np.nonzero(score > -8)
            yield edges_batch(ids[g, a], ids[g, best[g, a, j]], score[g, a, j])

    def local(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            c, a = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fresh, last, x = batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(), rows_of(batch.column(4), dims)
            if rest is not None:
                c, a, fresh, last, x = (np.concatenate(p) for p in zip(rest, (c, a, fresh, last, x), strict=True))
            cuts = [0, *(np.flatnonzero(np.diff(c)) + 1).tolist()]
            yield from meetings([(a[i:j], fresh[i:j], last[i:j], x[i:j]) for i, j in zip(cuts, cuts[1:])])
            k = cuts[-1]
            rest = tuple(p[k:].copy() for p in (c, a, fresh, last, x))
        if rest is not None:
            yield from meetings([rest[1:]])

    return seated.repartition("c").sortWithinPartitions("c").mapInArrow(local, "u long, v long, s float")


def audit(entries: DataFrame, homes: DataFrame, dims: int, params: DescentParams) -> tuple[float, DataFrame]:
    """The share of the sampled entries' links that lie inside families (homes: id, component), and links that do not: one for each sampled entry, family and task."""
    homed = entries.join(homes, "id", "left").select("id", F.coalesce("component", "id").alias("component"), "v")
    sample = homed.orderBy(F.xxhash64(F.lit(params.seed), "id"), "id").limit(params.audited).collect()
    ids = np.array([r["id"] for r in sample], np.int64)
    shared = entries.sparkSession.sparkContext.broadcast((ids, np.array([r["component"] for r in sample], np.int64), unit(np.array([r["v"] for r in sample], float))))

    def scan(batches):
        own, home, q = shared.value
        links = inside = 0
        missed = {}
        for batch in batches:
            i, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, len(i), 2048):
                x = unit(matrix(batch.column(2).slice(at, 2048), dims))
                hit = (q @ x.T >= params.threshold) & (own[:, None] != i[None, at : at + 2048])
                same = hit & (home[:, None] == c[None, at : at + 2048])
                links, inside = links + int(hit.sum()), inside + int(same.sum())
                for a, b in zip(*np.nonzero(hit & ~same), strict=True):
                    missed[(int(own[a]), int(c[at + b]))] = int(i[at + b])
        src, dst = [k[0] for k in missed], list(missed.values())
        yield pa.RecordBatch.from_arrays([pa.array([*src, None], pa.int64()), pa.array([*dst, None], pa.int64()), pa.array([0] * len(src) + [links]), pa.array([0] * len(src) + [inside])], ["u", "v", "links", "inside"])

    found = cut_lineage(homed.mapInArrow(scan, "u long, v long, links long, inside long"))
    total = found.agg(F.sum("links").alias("links"), F.sum("inside").alias("inside")).first()
    return (total["inside"] / total["links"] if total["links"] else 1.0), found.where("u is not null").select(F.col("u").alias("src"), F.col("v").alias("dst"))


def families(entries: DataFrame, dims: int, params: DescentParams) -> DataFrame:
    """id, component: what the refined graph holds together, up to a hair under the threshold."""
    nodes = cut_lineage(units(entries))
    n = nodes.count()
    bits = min(60, max(8, n.bit_length() + 4))
    graph, homes, extra = None, None, None
    for draw in range(params.redraws):
        graph = merged(graph, near_by_code(nodes, dims, bits, params.seed + draw, params), params)
        for _ in range(params.rounds):
            total = graph.agg(F.count("*").alias("n"), F.count(F.when(F.col("fresh"), 1)).alias("fresh")).first()
            if total["fresh"] <= params.settled * total["n"]:
                break
            graph = merged(graph, met(graph, nodes, dims, params), params)
        links = graph.where(F.col("s") >= params.threshold - LOOSE).select(F.col("u").alias("src"), F.col("v").alias("dst"))
        homes = connected_components(links if extra is None else links.unionByName(extra))
        recall, missed = audit(entries, homes, dims, params)
        if not missed.isEmpty():
            extra = missed if extra is None else extra.unionByName(missed)
            homes = connected_components(links.unionByName(extra))
        if recall >= params.recall:
            break
    return homes


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) of each vertex of a boolean adjacency matrix that is not its tree's first one."""
    root = np.full(len(linked), -1)
    for k in range(len(linked)):
        if root[k] < 0:
            root[k], edge = k, np.array([k])
            while len(edge):
                reached = np.flatnonzero(linked[edge].any(axis=0) & (root < 0))
                root[reached], edge = k, reached
    member = np.flatnonzero(root != np.arange(len(linked)))
    return member, root[member]


def block_links(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which cosines reach the threshold. Those that a matrix product's rounding could decide are taken again, term by term."""
    s = unit(x) @ unit(y).T
    linked = s >= threshold
    for a, b in np.argwhere(np.abs(s - threshold) < 1e-12).tolist():
        linked[a, b] = math.fsum(x[a] * y[b]) / math.sqrt(math.fsum(x[a] * x[a]) * math.fsum(y[b] * y[b])) >= threshold
    return linked


def settled(seats: DataFrame, dims: int, params: DescentParams) -> DataFrame:
    """id, links, other: from seats (family, p, q, side, id, w, v), sorted so by task, the weight of the entries each is linked with there; and, where links is null, edges of a spanning forest."""

    def settle(held):
        ids, w, x, side = (np.concatenate([h[k] for h in held]) for k in range(4))
        first = side == 0
        if first.all():
            linked = block_links(x, x, params.threshold)
            np.fill_diagonal(linked, False)
            counts, whole = linked @ w, linked
        else:
            a, b = np.flatnonzero(first), np.flatnonzero(~first)
            part = block_links(x[a], x[b], params.threshold)
            counts, whole = np.zeros(len(ids), np.int64), np.zeros((len(ids), len(ids)), bool)
            counts[a], counts[b] = part @ w[b], w[a] @ part
            whole[np.ix_(a, b)], whole[np.ix_(b, a)] = part, part.T
        member, root = forest(whole)
        return ids, counts, ids[member], ids[root]

    def emitted(out):
        ids, counts, member, root = (np.concatenate([o[k] for o in out]) for k in range(4))
        empty = lambda n: pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts.astype(np.int64)), empty(len(ids))], ["id", "links", "other"])
        yield pa.RecordBatch.from_arrays([pa.array(member), empty(len(member)), pa.array(root)], ["id", "links", "other"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            side, ids, w, x = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy(), matrix(batch.column(6), dims)
            cuts = [0, *(np.flatnonzero((np.diff(key, axis=0) != 0).any(axis=1)) + 1).tolist(), len(key)]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                if held and tuple(key[a]) != now:
                    out.append(settle(held))
                    held = []
                now = tuple(key[a])
                held.append((ids[a:b].copy(), w[a:b].copy(), x[a:b].copy(), side[a:b].copy()))
            if out:
                yield from emitted(out)
        if held:
            yield from emitted([settle(held)])

    return seats.select("family", "p", "q", "side", "id", "w", "v").repartition("family", "p", "q").sortWithinPartitions("family", "p", "q", "side", "id").mapInArrow(run, "id long, links long, other long")


def seated_families(members: DataFrame, dims: int, params: DescentParams) -> tuple[DataFrame, DataFrame]:
    """Seats for `settled`, and id, links, other of pairs in large families that the angles to the centre settle. members: family, id, w, v."""
    sizes = members.groupBy("family").agg(F.count("*").alias("m"))
    sized = cut_lineage(salted(members, sizes, "family", "id"))
    zero = F.lit(0).cast("long")
    small = sized.where(F.col("m") <= params.block).select("family", zero.alias("p"), zero.alias("q"), F.lit(0).alias("side"), "id", "w", "v")
    large = sized.where(F.col("m") > params.block)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, c: t + c * c))
    long_ = large.select("family", "id", "w", F.transform("v", lambda c: c / norm).alias("unit"), "v")
    means = long_.select("family", F.posexplode("unit").alias("d", "c")).groupBy("family", "d").agg(F.avg("c").alias("c"))
    centres = means.groupBy("family").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "c"))), lambda t: t["c"]).alias("centre"))
    length = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda t, c: t + c * c))
    dot = F.aggregate(F.zip_with("unit", "centre", lambda a, b: a * b), F.lit(0.0), lambda t, c: t + c)
    # A family without a direction has all angles open: 90 degrees.
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(length > 0, dot / length).otherwise(F.lit(0.0)))))
    # A bin is a hair narrower than its share of the link's angle, so that rounding leaves pairs open rather than settled.
    step = (math.acos(params.threshold) - 1e-6) / BINS
    binned = cut_lineage(salted(long_, centres, "family", "id").select("family", "id", "w", "v", F.floor(angle / step).alias("bin")))
    bins = cut_lineage(binned.groupBy("family", "bin").agg(F.count("*").alias("m"), F.sum("w").alias("w"), F.min("id").alias("low")))
    # At most pi / step bins a family.
    near = bins.groupBy("family").agg(F.sort_array(F.collect_list(F.struct("bin", "w", "low"))).alias("bins"))
    joined = salted(binned.drop("v"), near, "family", "id")
    sure = F.filter("bins", lambda b: b["bin"] + F.col("bin") + 2 <= BINS)
    none = F.lit(None).cast("long")
    own = F.when(F.col("bin") * 2 + 2 <= BINS, F.col("w")).otherwise(F.lit(0))
    links = F.aggregate(sure, F.lit(0).cast("long"), lambda t, b: t + b["w"]) - own
    by_angle = joined.where(F.size(sure) > 0).select("id", F.inline(F.array(F.struct(links.alias("links"), none.alias("other")), F.struct(none.alias("links"), F.get(sure, F.lit(0))["low"].alias("other")))))
    # The rest: pairs of parts, each of one bin and of at most about `block` entries.
    parts = bins.select("family", "bin", F.ceil(F.col("m") / params.block).alias("split")).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("split").cast("int") - 1)))
    # A part is numbered by its bin and place.
    parts = parts.withColumn("part", F.col("bin") * (1 << 32) + F.col("sub"))
    one, two = (parts.select("family", F.col("bin").alias(f"bin{k}"), F.col("part").alias(f"part{k}")) for k in (1, 2))
    open_ = (F.col("bin1") + F.col("bin2") + 2 > BINS) & (F.abs(F.col("bin1") - F.col("bin2")) <= BINS + 1)
    pairs = one.join(two, "family").where("part1 <= part2").where(open_)
    seats = pairs.select("family", F.col("part1").alias("part"), F.col("part1").alias("p"), F.col("part2").alias("q"), F.lit(0).alias("side")).unionByName(
        pairs.where("part1 < part2").select("family", F.col("part2").alias("part"), F.col("part1").alias("p"), F.col("part2").alias("q"), F.lit(1).alias("side"))
    )
    splits = parts.groupBy("family", "bin").agg(F.first("split").alias("split"))
    split = salted(binned, splits, ["family", "bin"], "id")
    dealt = split.withColumn("part", F.col("bin") * (1 << 32) + F.pmod(F.xxhash64("id", F.lit(1)), F.col("split")))
    return small.unionByName(dealt.join(seats, ["family", "part"]).select("family", "p", "q", "side", "id", "w", "v")), by_angle


def near_duplicates(vectors: DataFrame, params: DescentParams | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each vec_id of vectors (vec_id, embedding).

    n_links is the number of other vectors with a cosine of the threshold or more, component_id the smallest vec_id that links lead to, and kept whether that is
    the vector's own. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do those of another than the most frequent length (the
    larger, if two are). Rows that repeat a vec_id are one (the smallest vector, if they differ); rows without a vec_id are left out. Equal vectors are linked.
    Nothing comes of an empty table. Other columns are ignored.
    """
    params = params or DescentParams()
    spark = vectors.sparkSession
    rows = cut_lineage(usable(vectors))
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").distinct()
    found = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if found is None:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    dims = found["dims"]
    rows = rows.where(F.size("v") == dims)
    entries = cut_lineage(entries_of(rows))
    homes = families(entries, dims, params)
    members = entries.join(homes, "id").select(F.col("component").alias("family"), "id", "w", "v")
    seats, by_angle = seated_families(members, dims, params)
    told = cut_lineage(settled(seats, dims, params).unionByName(by_angle))
    counts = told.where("links is not null").groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(told.where("links is null").select(F.col("id").alias("src"), F.col("other").alias("dst")))
    own = entries.select("h1", "h2", "id", "w").join(counts, "id", "left").join(components, "id", "left")
    own = own.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    linked = salted(rows.select("vec_id", "h1", "h2"), own, ["h1", "h2"], "vec_id").select("vec_id", "n_links", "component_id")
    out = every.join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
