import math

import numpy as np
import pytest

from jobweave.llm import descent, queries
from jobweave.llm.descent import DescentParams, near_duplicates

ROOT = "/root/testdata"


def brute(vectors, threshold=0.95):
    """(links, component) by comparing all pairs."""
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= threshold
    np.fill_diagonal(linked, False)
    low = list(range(len(ids)))

    def find(a):
        while low[a] != a:
            a = low[a]
        return a

    for a, b in np.argwhere(linked).tolist():
        p, q = sorted((find(a), find(b)))
        low[q] = p
    return {i: (int(linked[k].sum()), ids[find(k)]) for k, i in enumerate(ids)}


def collected(df):
    rows = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    out = {r.vec_id: (r.n_links, r.component_id) for r in rows}
    assert len(out) == len(rows)
    return out


def groups(rng, dims, lone, sizes, noise):
    """Lone vectors, and groups of noisy copies of one: of each size one group."""
    rows = [rng.normal(size=dims) for _ in range(lone)]
    for m in sizes:
        base = rng.normal(size=dims)
        rows += [base + noise * rng.normal(size=dims) for _ in range(m)]
    return {int(i): rows[k].tolist() for k, i in enumerate(rng.permutation(len(rows)))}


@pytest.mark.parametrize(
    "noise, params",
    [
        (0.1, DescentParams()),  # inside half the link's angle: settled by angles
        (0.2, DescentParams(block=16)),  # around it
        (0.3, DescentParams(block=16, neighbours=8, longest=16)),  # chains: about half of a group's pairs are links
        (0.2, DescentParams(block=16, neighbours=4, longest=8, tables=2, chunk=16)),
    ],
)
def test_groups_against_all_pairs(spark, noise, params):
    vectors = groups(np.random.default_rng(int(noise * 10)), 32, 400, [2, 2, 3, 5, 9, 40, 150], noise)
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>").repartition(4)
    want = brute(vectors)
    assert sum(n for n, _ in want.values()) > 20
    assert collected(near_duplicates(table, params)) == want


def test_edges(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=6).tolist()
    fine = {k: rng.normal(size=6).tolist() for k in range(40)}
    fine |= {100 + k: base for k in range(60)}  # equal
    fine |= {200: [2 * c for c in base], 201: [1e-200 * c for c in base], 202: [1e200 * c for c in base], 203: [-c for c in base], 204: [0.0, -0.0, 1.0, 0.0, 0.0, 0.0], 205: [0.0, 0.0, 1.0, 0.0, 0.0, 0.0]}
    bad = {300: None, 301: [0.0] * 6, 302: [1.0, None, 0.0, 0.0, 0.0, 0.0], 303: [float("nan")] * 6, 304: [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 305: [1.0], 306: []}
    rows = [*fine.items(), *bad.items(), (None, base), (100, base)]
    table = spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, id string, w int, family int")
    want = brute({i: (np.array(v) / np.abs(v).max()).tolist() for i, v in fine.items()}) | {i: (0, i) for i in bad}
    assert collected(near_duplicates(table)) == want
    assert want[100][0] == 62 and want[205] == (1, 204)
    assert near_duplicates(table.limit(0)).count() == 0
    assert collected(near_duplicates(table.where("vec_id = 300"))) == {300: (0, 300)}
    assert collected(near_duplicates(table.where("vec_id = 7"))) == {7: (0, 7)}


def test_cosines_at_the_threshold():
    """A hair on either side of the threshold."""
    x = np.array([[1.0, 0.0]])
    for angle in (math.acos(0.95), math.acos(0.95) + 1e-9, math.acos(0.95) - 1e-9):
        y = np.array([[math.cos(angle), math.sin(angle)]])
        want = y[0, 0] / math.sqrt(y[0, 0] ** 2 + y[0, 1] ** 2) >= 0.95
        assert descent.block_links(x, y, 0.95)[0, 0] == want


def test_forest_spans_each_component():
    rng = np.random.default_rng(1)
    linked = rng.random((60, 60)) < 0.02
    linked = linked | linked.T
    member, root = descent.forest(linked)
    low = {int(m): int(r) for m, r in zip(member, root, strict=True)}
    for a, b in np.argwhere(linked).tolist():
        assert low.get(a, a) == low.get(b, b)
    assert not set(low.values()) & low.keys()


def test_a_graph_that_misses_links_is_redrawn(spark):
    """With one table of short chunks and no refinement the audit finds links outside families; they are added, and other codes are drawn."""
    vectors = groups(np.random.default_rng(8), 24, 600, [2] * 60, 0.15)
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    params = DescentParams(tables=1, chunk=4, rounds=0, audited=400, redraws=3)
    want, got = brute(vectors), collected(near_duplicates(table, params))
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_query_against_its_contract(spark, sf):
    out = queries.op12_nn_descent(spark, f"{ROOT}/{sf}")
    assert out.dtypes[:4] == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{ROOT}/{sf}/embeddings.parquet").collect()}
    assert collected(out) == brute(vectors)
