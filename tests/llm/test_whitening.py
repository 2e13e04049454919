import math
from fractions import Fraction

import numpy as np
import pytest

from jobweave.llm import queries, whitening
from jobweave.llm.whitening import WhiteningParams, components, jacobi

ROOT = "/root/testdata/sf0.001"


def plain(vectors):
    """x, exact covariance, deviations."""
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, s = len(x), [sum(col) for col in zip(*x, strict=True)]
    y = [[Fraction(n * a - b, n) for a, b in zip(row, s, strict=True)] for row in x]
    d = len(s)
    cov = [[sum(r[i] * r[j] for r in y) / n for j in range(d)] for i in range(d)]
    return x, s, cov, [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]


def held(rows, ids):
    """{vec_id: ...} and the whitened matrix, rows as in ids."""
    at = {i: k for k, i in enumerate(ids)}
    w = np.full((len(ids), max(r.component for r in rows)), np.nan)
    for r in rows:
        w[at[r.vec_id], r.component - 1] = r.whitened
    assert not np.isnan(w).any()
    return w


@pytest.mark.parametrize("d", [1, 2, 3, 8, 33])
def test_eigenvectors(d):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, 2 * d))
    a = a @ a.T
    values, vectors = jacobi(a)
    assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-13)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-12 * values[0])
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-11) and (np.diff(values) <= 0).all()


def test_small_eigenvalues_keep_their_precision():
    """A graded matrix, whose small eigenvalues an absolute criterion would lose."""
    scale = np.array([1.0, 1e-5, 1e-10, 1e-15])
    core = np.array([[2.0, 0.3, 0.2, 0.1], [0.3, 2.0, 0.3, 0.2], [0.2, 0.3, 2.0, 0.3], [0.1, 0.2, 0.3, 2.0]])
    values, _ = jacobi(scale[:, None] * core * scale[None, :])
    # The determinants of leading minors give the eigenvalues of a strongly graded matrix.
    minors = [np.linalg.det(core[:k, :k]) for k in range(5)]
    want = [scale[k] ** 2 * minors[k + 1] / minors[k] for k in range(4)]
    assert np.allclose(values, want, rtol=1e-8)
    assert jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0] and jacobi(np.zeros((0, 0)))[0].shape == (0,)


def test_against_exact_fractions(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(60, 10)) * 10.0 ** -np.arange(10.0) * 50).tolist()
    ids = list(range(60))
    bad = [(90, None), (91, [None] * 10), (92, [float("nan")] * 10), (93, [float("-inf")] * 10), (94, [1.0]), (95, []), (96, [1e30] * 10)]
    table = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in [*zip(ids, vectors, strict=True), *bad]], "vec_id long, embedding array<double>, x string, n int, w int").repartition(3)
    rows = components(table).collect()
    x, s, cov, deviation = plain(vectors)
    assert {r.vec_id for r in rows} == set(ids) and len(rows) == 60 * 8 and {r.n for r in rows} == {60}
    assert all(int(r.deviation) == deviation[r.vec_id] for r in rows)
    values, basis = np.linalg.eigh(np.array(cov, float))
    values, basis = values[::-1], basis[:, ::-1]
    w = held(rows, ids)
    want = (np.array(x, float) - np.array(s) / 60) @ basis[:, :8] / np.sqrt(values[:8])
    assert np.abs(np.abs(w) - np.abs(want)).max() < 1e-6 and np.allclose(w * w[0], want * want[0], atol=1e-5)
    assert all(abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9 for r in rows)
    error = np.abs(np.cov(w.T, bias=True) - np.eye(8)).max()
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-4 and abs(rows[0].identity_error - error) < 1e-9


def test_few_and_equal_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert components(spark.createDataFrame([], schema)).count() == 0
    assert components(spark.createDataFrame([(1, None)], schema)).count() == 0
    one = components(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect()
    assert [(r.component, r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [(1, 1, 0, 0, 0, 0), (2, 1, 0, 0, 0, 0)]
    line = components(spark.createDataFrame([(k, [float(k), 2.0 * k, 0.0]) for k in (1, 2, 3, 3)] + [(None, [1.0, 2.0, 0.0])], schema)).collect()
    assert len(line) == 15 and all(abs(r.explained - (r.component == 1)) < 1e-12 and (r.component == 1 or r.whitened == 0) for r in line)
    assert line[0].identity_error < 1e-9


def test_large_entries_stay_exact(spark):
    """Sums of products beyond 64 bits."""
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(50, 3)) * 2.0**26).tolist()
    rows = components(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>"), WhiteningParams(components=2)).collect()
    deviation = plain(vectors)[3]
    assert all(int(r.deviation) == deviation[r.vec_id] for r in rows) and rows[0].identity_error < 1e-9


def test_far_means_and_many_parts(spark):
    """Products of centred entries are small though the means are far from zero."""
    rng = np.random.default_rng(6)
    vectors = (rng.normal(size=(9000, 4)) + 1000).tolist()
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(2)
    rows, dims = whitening.usable(table, WhiteningParams())
    model = whitening.fit(rows, dims, WhiteningParams())
    x = np.floor(np.array(vectors) * 1024) + 100000
    assert list(model.sums) == x.sum(axis=0).astype(int).tolist() and model.n == 9000
    assert np.allclose(model.values, np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1], rtol=1e-10)


def test_query_against_its_contract(spark):
    out = queries.op13_jacobi_whitening(spark, ROOT)
    assert out.dtypes[:7] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    rows = out.collect()
    table = spark.read.parquet(f"{ROOT}/embeddings.parquet").collect()
    ids, vectors = [r.vec_id for r in table], [r.embedding for r in table]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for v in vectors])
    n, s = len(x), x.sum(axis=0)
    deviation = dict(zip(ids, ((n * x - s) ** 2).sum(axis=1).tolist(), strict=True))
    assert len(rows) == 8 * n and all(r.n == n and r.deviation == deviation[r.vec_id] for r in rows)
    values, basis = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    want = (x - s / n) @ basis[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    w = held(rows, ids)
    sign = np.sign((w * want).sum(axis=0))
    assert np.abs(w * sign - want).max() < 1e-9
    assert all(abs(r.explained / (values[::-1][r.component - 1] / values.sum()) - 1) < 1e-9 for r in rows)
    assert rows[0].identity_error <= 1e-4
