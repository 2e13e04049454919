import re

from jobweave.llm.minhash import MinHashParams, _pair_blocks, near_duplicates

FOLD = {c: c + 32 for c in range(65, 91)}
SF = "/root/testdata/sf0.01"


def word_set(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1)))


def brute_force(rows, percent=85, n=3):
    sets = {i: word_set(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    seen = set()
    for ids in by_shingle.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * len(sets[a] | sets[b]):
                        x, y = sorted((find(a), find(b)))
                        root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_edges(spark):
    base = " ".join(f"w{k}" for k in range(120))
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (4, "One", 0), (5, "one", 0), (6, "one two", 0), (7, base, 0), (8, base.upper(), 0), (9, base + " tail", 0), (9, base + " tail", 0), (10, "x " * 50_000, 0), (11, "one two", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    out = near_duplicates(docs, MinHashParams(words=3, percent=85))
    assert got(out) == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (118, 7), 8: (118, 7), 9: (119, 7), 10: (1, 10), 11: (1, 11)}
    assert out.count() == 11
    assert got(near_duplicates(docs.limit(0), MinHashParams(words=3, percent=85))) == {}


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(near_duplicates(docs, MinHashParams(words=3, percent=85))) == brute_force(rows)


def test_families_over_many_blocks(spark):
    import random

    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"e{rng.randrange(6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_duplicates(docs, MinHashParams(words=3, percent=85, block_docs=16, hubs=3))
    assert got(out) == brute_force(rows)


def test_second_pass_blocks_are_bounded_and_meet_each_pair_once(spark):
    n, params = 600, MinHashParams(block_docs=50)
    rows = [(1, k, 10, k % 6 != 0) for k in range(n)] + [(2, 1000 + k, 10, False) for k in range(100)]
    members = spark.createDataFrame(rows, "family long, doc_id long, n_shingles long, probe boolean")
    blocks = {}
    for r in _pair_blocks(members, params).collect():
        assert r.family == 1
        blocks.setdefault(r.block, []).append((r.doc_id, r.probe))
    assert max(map(len, blocks.values())) < 4 * params.block_docs
    met = {}
    for held in blocks.values():
        for k, (a, p) in enumerate(held):
            for b, q in held[:k]:
                if p != q or all(x for _, x in held):
                    met[min(a, b), max(a, b)] = met.get((min(a, b), max(a, b)), 0) + 1
    assert met == {(a, b): 1 for a in range(n) for b in range(a + 1, n) if a % 6 or b % 6}
