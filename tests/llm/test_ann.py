import numpy as np
import pytest

from jobweave.llm import queries
from jobweave.llm.ann import AnnParams, CrossPolytope, hadamard, nearest
from pyspark.sql import functions as F

ROOT = "/root/testdata/sf0.01"


def brute(vectors, query_ids, k=20):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids.tolist()], float)
    out = {}
    for q in query_ids:
        score = (np.array(vectors[q], float) * x).sum(axis=1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def collected(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_rotation_is_orthonormal():
    assert np.allclose(hadamard(np.eye(8)) @ hadamard(np.eye(8)).T, np.eye(8))
    index = CrossPolytope.over(5, 1000, 1.0, 2.0, AnnParams(block_rows=10))
    x = np.random.default_rng(1).normal(size=(40, 5))
    x *= 2 / np.linalg.norm(x, axis=1).max()
    assert len(index.sizes) == 2 and index.lift
    every = index.probes(x, 1 << 20)
    assert all(len(set(t)) == index.buckets for q in every.tolist() for t in q)
    assert index.codes(x).min() >= 0 and index.codes(x).max() < index.params.tables * index.buckets


def test_recall_on_the_table(spark):
    table = spark.read.parquet(f"{ROOT}/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in table.collect()}
    want = brute(vectors, [i for i in vectors if i % 20 == 0])
    got = collected(nearest(table, F.col("vec_id") % 20 == 0))
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    for q, own in got.items():
        exact = dict(brute(vectors, [q], k=len(vectors))[q])
        assert all(abs(exact[i] - s) < 1e-12 for i, s in own)
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))


def test_edges_ties_and_lengths(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=6).tolist()) for k in range(300)]
    rows += [(1000 + k, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]) for k in range(200)]  # one vector, many ids
    rows += [(1000, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0]), (2000, None), (2001, [0.0] * 6), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6), (2004, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6), (2005, [1.0]), (2006, [])]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, code string, rank int")
    vectors = {i: v for i, v in rows if i is not None and i < 2000}
    want = brute(vectors, [i for i in vectors if i % 20 == 0])
    for params in (AnnParams(recall=1.0), AnnParams(recall=1.0, block_rows=8, tables=2)):
        got = collected(nearest(table, F.col("vec_id") % 20 == 0, params))
        assert got.keys() == want.keys()
        assert recall(got, want) > 0.98
        assert got[1000] == want[1000] and got[1020] == want[1020]
    few = collected(nearest(table.where("vec_id < 3"), F.col("vec_id") == 0))
    assert [i for i, _ in few[0]] == [i for i, _ in brute({k: vectors[k] for k in range(3)}, [0])[0]]
    assert nearest(table.limit(0), F.col("vec_id") == 0).count() == 0
    assert nearest(table.where("vec_id = 7"), F.col("vec_id") == 7).count() == 0


def test_as_many_probes_as_the_recall_takes(spark):
    rng = np.random.default_rng(3)
    vectors = {k: rng.normal(size=16).tolist() for k in range(3000)}
    params = AnnParams(block_rows=1, tables=1)
    assert CrossPolytope.over(16, 3000, 1.0, 9.0, params).buckets > 2048
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    want = brute(vectors, range(0, 3000, 150))
    got = collected(nearest(table, F.col("vec_id") % 150 == 0, params))
    assert recall(got, want) >= params.recall


@pytest.mark.parametrize("n, dims", [(150, 8), (1500, 32), (6000, 24)])
def test_recall_at_several_sizes(spark, n, dims):
    rng = np.random.default_rng(n)
    vectors = {k: (rng.normal(size=dims) * rng.uniform(0.5, 2)).tolist() for k in range(n)}
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    want = brute(vectors, range(0, n, 20))
    got = collected(nearest(table, F.col("vec_id") % 20 == 0, AnnParams(block_rows=64)))
    assert recall(got, want) >= 0.9


def test_query_against_its_contract(spark):
    out = queries.op7_cross_polytope(spark, "/root/testdata/sf0.001")
    assert out.dtypes[:4] == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    want = brute(vectors, [i for i in vectors if i % 20 == 0])
    got = collected(out)
    assert got.keys() == want.keys() and all(len(own) == 20 for own in got.values()) and recall(got, want) >= 0.9
