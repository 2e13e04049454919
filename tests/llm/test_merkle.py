import hashlib
import zlib

import duckdb
import pytest

from jobweave.llm import merkle, queries
from jobweave.llm.manifest_sql import MANIFEST_SQL
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        first = at - at % 3
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + 3])))
        at //= 3
    return out


def brute(rows):
    """A plain manifest: one tree after another, each proof by walking up."""
    groups = {}
    for i, text, lang, source, n in rows:
        shown = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        leaf, presented = (h(*map(field, (i, source, lang, n, t))) for t in (text, shown))
        groups.setdefault(source, []).append((i is not None, i or 0, leaf, presented))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s])]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for at, (there, i, leaf, presented) in enumerate(sorted(groups[s])):
            way, back = path(trees[s], at) + path(top, k), presented
            for a, b in way:
                back = h(a, back, b)
            out.append((i if there else None, leaf, trees[s][-1][0], top[-1][0], h(*(a + b for a, b in way)), back, back == top[-1][0]))
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r))


def tampered():
    return F.when(queries.remainder(2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


#: A source of 40 rows, null and empty values, a lone row, two-byte letters in a source, repeated rows, a repeated id, a null id, a very long text.
EDGES = (
    [(k, f"text {k}\nmore", "en", "big", k) for k in range(100, 140)]
    + [(5, None, None, None, None), (6, "", "", "", 0), (7, "a\nb", "de", "é", 3), (8, "x\n" * 200_000, "en", "z", 400_000)]
    + [(9, "twice\n", "en", "pair", 6)] * 4
    + [(10, "one", "en", "pair", 3), (10, "two", "en", "pair", 3), (None, "no\nid", "en", "pair", 5), (None, None, None, "pair", None), (-3, "minus\n", "en", "pair", 6)]
)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_edges_against_a_plain_manifest(spark, levels):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in EDGES], SCHEMA + ", root string, at int").repartition(5)
    got = merkle.manifest(docs, tampered(), merkle.MerkleParams(levels=levels)).collect()
    assert in_order(got) == in_order(brute(EDGES))


def test_sql_on_the_edges():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    once = [r for k, r in enumerate(EDGES) if r not in EDGES[:k]]
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", once)
    assert in_order(con.execute(MANIFEST_SQL).fetchall()) == in_order(brute(once))


def test_one_row_one_source_and_nothing(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    (row,) = merkle.manifest(spark.createDataFrame([(1, "t", None, "s", 1)], SCHEMA)).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root == h("1:1", "1:s", "-", "1:1", "1:t") and row.proof_sha256 == h("") and row.verified
    rows = [(k, str(k), "en", "s", 1) for k in range(30)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), params=merkle.MerkleParams(levels=2)).collect()
    assert all(r.verified and r.subroot == r.root for r in got) and len({r.proof_sha256 for r in got}) == 30


def test_many_sources(spark):
    rows = [(k, "a\n", "en", f"s{k % 25}", 2) for k in range(60)]
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), tampered(), merkle.MerkleParams(levels=1)).collect()
    assert in_order(got) == in_order(brute(rows))


def test_each_change_of_a_field_is_seen(spark):
    docs = spark.createDataFrame([(1, "ab", "c", "s", 2), (2, "x", "y", "s", 1)], SCHEMA)
    assert not any(r.verified for r in merkle.manifest(docs, F.concat("text", F.lit(" "))).collect())
    # What moves from one field to the next is another leaf.
    leaves = {r.leaf for r in merkle.manifest(spark.createDataFrame([(1, "ab", "c", "s", 2), (1, "b", "ca", "s", 2), (1, None, "c", "s", 2), (1, "-", "c", "s", 2)], SCHEMA)).collect()}
    assert len(leaves) == 4


def test_query_against_its_contract(spark):
    root = "/root/testdata/sf0.001"
    out = queries.op11_merkle_manifest(spark, root)
    assert out.dtypes[:7] == [("doc_id", "bigint"), *[(c, "string") for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", "boolean")]
    rows = [tuple(r) for r in spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert in_order(out.collect()) == in_order(brute(rows))


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(EDGES[:3], SCHEMA)
    plan = merkle.manifest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
