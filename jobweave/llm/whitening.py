"""Whitening of vectors by the principal components of their covariance.

Sums and the scatter of centred vectors are made by partition and added up; the driver holds only matrices of dimension by dimension, whose eigenvectors cyclic Jacobi rotations find,
and broadcasts the few columns that whiten. Entries are fixed-point integers, so sums are exact: the scatter is that of integers centred at the integer
nearest to the mean, which keeps products small, and what is left between it and the mean is taken off exactly before the one division.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAFE = 1 << 62  # of a sum of products in 64 bits
LARGEST = float(1 << 30)  # entries from here on are left out: sums of their products would outgrow 38 digits


@dataclass(frozen=True)
class WhiteningParams:
    scale: int = 1024
    shift: int = 100_000
    components: int = 8
    most_dims: int = 4096  # a matrix of this many rows and columns is held by the driver and each task
    sweeps: int = 60


@dataclass(frozen=True)
class Whitening:
    """n vectors with the sums of their entries, and for each component its unit vector (a column), eigenvalue and share of the trace."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    params: WhiteningParams


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, by cyclic Jacobi rotations.

    A sweep meets each pair of rows once, in rounds of pairs that share no row (a round-robin), so a round's rotations are applied together. A pair is turned
    while its entry counts against the geometric mean of its diagonal, not against the largest entry, so small eigenvalues of a positive matrix
    come out with their own precision. Each vector's largest entry is positive.
    """
    a = np.array(matrix, np.float64)
    d = len(a)
    v = np.eye(d)
    size = d + d % 2
    ring = np.arange(size)
    tiny = np.finfo(np.float64).tiny
    for _ in range(sweeps):
        turned = False
        for _ in range(max(size - 1, 0)):
            p, q = ring[: size // 2], ring[size // 2 :][::-1]
            real = (p < d) & (q < d)
            p, q = np.minimum(p, q)[real], np.maximum(p, q)[real]
            off = a[p, q]
            counts = np.abs(off) > np.maximum(1e-16 * np.sqrt(np.abs(a[p, p] * a[q, q])), tiny)
            p, q, off = p[counts], q[counts], off[counts]
            if len(p):
                turned = True
                tau = (a[q, q] - a[p, p]) / (2 * off)
                t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1, tau))
                c = 1 / np.hypot(1, t)
                s = t * c
                diagonal = a[p, p] - t * off, a[q, q] + t * off
                rows_p, rows_q = a[p].copy(), a[q].copy()
                a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
                for m in (a, v):
                    cols_p, cols_q = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = cols_p * c - cols_q * s, cols_p * s + cols_q * c
                a[p, p], a[q, q] = diagonal
                a[p, q] = a[q, p] = 0.0
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    else:
        raise ArithmeticError("the rotations do not converge")
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    v = v[:, order]
    v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0) if d else v
    return values[order], v


def usable(vectors: DataFrame, params: WhiteningParams) -> tuple[DataFrame, int]:
    """Rows vec_id, x (array<long>) of the fit list, and their dimensions (0: there are none)."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null and size(v) > 0").where(fine)
    found = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims = found["dims"] if found else 0
    if dims > params.most_dims:
        raise ValueError(f"vectors of {dims} entries; most_dims is {params.most_dims}")
    return rows.where(F.size("v") == dims).select("vec_id", F.transform("v", lambda c: F.floor(c * params.scale) + params.shift).alias("x")), dims


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def added(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """Exact sums by position of the partitions' (k, part) rows: a row for each position, however many rows there were. Objects are Python's integers."""
    out = np.zeros(int(np.prod(shape)), object)
    for r in parts.groupBy("k").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect():
        out[r["k"]] = int(r["s"])
    return out.reshape(shape)


def summed(rows: DataFrame, dims: int, first: list[int] | None, params: WhiteningParams) -> np.ndarray:
    """The sums of x - first by dimension and of all products of two, exact: (dims + 1, dims), the sums last. Without `first`, of the sums and the count alone: (1, dims + 1)."""

    def partial(batches):
        centre = np.array(first, np.int64) if first is not None else None
        total, flat = None, 0

        def emitted(value):
            value = value.ravel()
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(value), dtype=np.int64)), pa.array(map(str, value.tolist()))], ["k", "part"])

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = matrix(batch.column(0).slice(at, 4096), dims)
                if centre is None:
                    piece = np.append(x.sum(axis=0), len(x))[None, :]
                    bound = int(np.abs(x).max()) * len(x)
                else:
                    y = x - centre
                    most = int(np.abs(y).max())
                    bound = max(most, most**2) * len(y)
                    # A product of doubles is exact below 2**53, and much faster than one of integers.
                    if bound < 1 << 53:
                        z = y.astype(np.float64)
                        product = np.rint(z.T @ z).astype(np.int64)
                    else:
                        y = y if bound < SAFE else y.astype(object)
                        product = y.T @ y
                    piece = np.concatenate([product, y.sum(axis=0)[None, :]])
                if total is not None and flat + bound >= SAFE:
                    yield emitted(total)
                    total, flat = None, 0
                total, flat = piece if total is None else total + piece, flat + bound
        if total is not None:
            yield emitted(total)

    parts = rows.select("x").mapInArrow(partial, "k long, part string")
    return added(parts, (1, dims + 1) if first is None else (dims + 1, dims))


def fit(rows: DataFrame, dims: int, params: WhiteningParams) -> Whitening:
    """The whitening of the fit list (rows of `usable`): two passes, of sums and of the centred scatter."""
    sums = summed(rows, dims, None, params)[0].tolist()
    n, sums = sums[-1], sums[:-1]
    first = [(2 * s + n) // (2 * n) for s in sums]
    both = summed(rows, dims, first, params)
    scatter, left = both[:-1], both[-1]
    # n squared times the covariance, in integers.
    exact = scatter * n - left[:, None] * left[None, :]
    covariance = np.array([[v / n**2 for v in row] for row in exact.tolist()], np.float64)
    values, vectors = jacobi(covariance, params.sweeps)
    k = min(params.components, dims)
    trace = sum(exact.diagonal().tolist()) / n**2
    return Whitening(n, tuple(sums), vectors[:, :k], values[:k], values[:k] / trace if trace else np.zeros(k), params)


def projector(model: Whitening) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What tasks need: the integer nearest to each mean, the rest of the mean, and the columns that whiten. A component without variance has a zero column."""
    n = model.n
    near = np.array([(2 * s + n) // (2 * n) for s in model.sums], np.int64)
    rest = np.array([(s - int(m) * n) / n for s, m in zip(model.sums, near, strict=True)])
    with_variance = model.values > max(float(model.values.max(initial=0.0)), 0.0) * 1e-14
    columns = np.where(with_variance, model.vectors / np.sqrt(np.where(with_variance, model.values, 1.0)), 0.0)
    return near, rest, columns


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Of each row the sum over dimensions of (n * x - S) ** 2, exact."""
    total = np.array(sums, object)
    most = max(max(abs(n * int(x.min()) - min(sums)), abs(n * int(x.max()) - max(sums))), abs(n * int(x.min()) - max(sums)), abs(n * int(x.max()) - min(sums)), 1) if len(x) else 1
    if most**2 * x.shape[1] < SAFE and n * int(np.abs(x).max(initial=0)) < SAFE:
        y = n * x - total.astype(np.int64)
        return (y * y).sum(axis=1).tolist()
    y = n * x.astype(object) - total
    return (y * y).sum(axis=1).tolist()


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation (decimal), w (array<double>) of rows of `usable`."""
    near, rest, columns = projector(model)
    dims = len(near)
    shared = rows.sparkSession.sparkContext.broadcast((near, rest, columns))  # dimension by component

    def project(batches):
        near, rest, columns = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = matrix(part.column(1), dims)
                w = ((x - near) - rest) @ columns
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * columns.shape[1])
                # As text: an exact integer of any length.
                exact = pa.array([str(d) for d in deviations(x, model.n, model.sums)])
                yield pa.RecordBatch.from_arrays([part.column(0), exact, pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], ["vec_id", "deviation", "w"])

    out = rows.select("vec_id", "x").mapInArrow(project, "vec_id long, deviation string, w array<double>")
    return out.withColumn("deviation", F.col("deviation").try_cast("decimal(38,0)"))


def identity_error(projected: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened rows' own covariance minus the identity, measured over all of them; of components with variance."""
    k = len(model.values)
    shown = np.abs(projector(model)[2]).max(axis=0, initial=0.0) > 0

    def partial(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = batch.column(0).flatten().to_numpy().reshape(-1, k)
            total += np.concatenate([w.T @ w, w.sum(axis=0)[None, :]])
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int64)), pa.array(flat)], ["k", "part"])

    out = np.zeros((k + 1) * k)
    for r in projected.select("w").mapInArrow(partial, "k long, part double").groupBy("k").agg(F.sum("part").alias("s")).collect():
        out[r["k"]] = r["s"]
    out = out.reshape(k + 1, k) / model.n
    # The rows are centred before they are projected: the means are rounding alone.
    error = np.abs(out[:-1] - np.outer(out[-1], out[-1]) - np.eye(k))[shown][:, shown]
    return float(error.max(initial=0.0))


def components(vectors: DataFrame, params: WhiteningParams | None = None) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row for each usable row of vectors (vec_id, embedding) and each leading component.

    Vectors that are null or empty, or hold null or non-finite entries, take no part; nor do those of another than the most frequent length (the larger, if two are) or
    with an entry of 2**30 or more, of whose products no exact sums are kept. Rows that repeat a vec_id or a vector count each. With fewer dimensions than components, there are as
    many components as dimensions. A component without variance (one vector, or equal entries) has whitened 0 and explained 0, and is left out of
    identity_error. A deviation of more than 38 digits is null. Equal eigenvalues come in any order. Nothing comes of an empty table. Other columns are ignored.
    """
    params = params or WhiteningParams()
    rows, dims = usable(vectors, params)
    if not dims:
        return vectors.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    model = fit(rows, dims, params)
    projected = whitened(rows, model)
    error = identity_error(projected, model)
    share = F.array(*(F.lit(float(e)) for e in model.explained))
    out = projected.select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened"))
    return out.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))
