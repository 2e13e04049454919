import hashlib
import random

import numpy as np
import pytest

from jobweave.llm import queries
from jobweave.llm.repeats import RepeatParams, Rolling, deduplicated, merged_order, repeated_starts, shard_transform

ROOT = "/root/testdata/sf0.01"
SMALL = RepeatParams(length=20, passage=10, gram=5, step=5, longest=12, group=4, batch_bytes=256, shards=3, grain=4)


def brute(texts, length):
    """For each text, which bytes a string that starts at two places covers."""
    count = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            count[t[k : k + length]] = count.get(t[k : k + length], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        until = 0
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                for i in range(max(k, until), k + length):
                    gone[i] = True
                until = k + length
        out.append(gone)
    return out


def summary(t, gone, told):
    kept = bytes(b for b, g in zip(t, gone) if not g)
    spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
    return len(t), sum(gone), spans, sum(told), hashlib.sha256(kept).hexdigest()


def test_merged_order_equals_a_full_sort():
    rng = np.random.default_rng(3)
    texts = [rng.integers(0, 3, rng.integers(8, 40)).astype(np.int64) for _ in range(9)]
    symbols = [np.concatenate([t, [1000 + k]]) for k, t in enumerate(texts)]
    suffixes, transforms, members = [], [], []
    for s in range(3):
        mine = list(range(s, 9, 3))
        symbol = np.concatenate([symbols[k] for k in mine])
        sizes = np.array([len(symbols[k]) for k in mine])
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        order, before = shard_transform(symbol, start, np.repeat(sizes, sizes), 64)
        where = [(k, i) for k in mine for i in range(len(symbols[k]))]
        suffixes += [where[o] for o in order]
        transforms.append(before)
        members += where
    place, common = merged_order(transforms, 64)
    got = [suffixes[p] for p in place]
    tail = lambda k, i: symbols[k][i:].tolist()
    assert got == sorted(members, key=lambda x: tail(*x))
    for a, b, c in zip(got, got[1:], common[1:].tolist()):
        same = next(n for n, (x, y) in enumerate(zip(tail(*a), tail(*b))) if x != y)
        assert c == same


def test_repeated_starts_against_brute_force(monkeypatch):
    rng = random.Random(1)
    for collide in (False, True):
        if collide:  # all hashes equal: the bytes decide
            monkeypatch.setattr("jobweave.llm.repeats.mix64", lambda x: x & np.uint64(3))
        for _ in range(20):
            pool = [bytes(rng.choice(b"ab") for _ in range(30)) for _ in range(3)]
            texts = [b"".join(rng.choice(pool)[: rng.randrange(10, 31)] for _ in range(4)) for _ in range(6)]
            starts = [rng.randrange(1, len(t) - 9) for t in texts]
            seen = {}
            for t, n in zip(texts, starts):
                for k in range(n):
                    for size in (10, 20):
                        if k + size <= len(t):
                            seen[t[k : k + size]] = seen.get(t[k : k + size], 0) + 1
            got = repeated_starts([np.frombuffer(t, np.uint8) for t in texts], np.array(starts), SMALL, Rolling())
            for t, n, level in zip(texts, starts, got):
                assert level.tolist() == [sum(k + size <= len(t) and seen[t[k : k + size]] > 1 for size in (10, 20)) for k in range(n)]


@pytest.mark.parametrize("hot", [False, True])
def test_small_strings_and_edges(spark, hot):
    rng = random.Random(7)
    words = ["alpha ", "béta ", "gamma ", "d ", "zz"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    passage = "the quick brown fox jumps over it. "
    texts += [None, "", "x" * 500, "ab" * 300, "short", "y" * 19, passage, passage, "y" * 20]
    if hot:
        texts += [f"{rng.randrange(10**6)} {passage}{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(k, t, "s", 2) for k, t in enumerate(texts)] + [(5, texts[5], "s", 2), (None, "null id " * 9, "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, d string, n int")
    data = [(t or "").encode() for _, t, *_ in rows]
    want = sorted(((i, *summary(t, g, p)) for (i, *_), t, g, p in zip(rows, data, brute(data, 20), brute(data, 10))), key=str)
    out = deduplicated(docs, SMALL, text=True, digest=True)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.n_passage, r.kept_sha256) for r in out.collect()), key=str)
    assert got == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in out.collect())
    assert deduplicated(docs.limit(0), SMALL).count() == 0


def covered(texts, length):
    """brute, for long texts."""
    seen = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            h = hash(t[k : k + length])
            seen[h] = seen.get(h, 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[hash(t[k : k + length])] > 1:
                gone[k : k + length] = True
        out.append(gone.tolist())
    return out


def held_against(rows, got):
    data = [(t or "").encode() for _, t in rows]
    want = sorted((i, *summary(t, g, p)) for (i, _), t, g, p in zip(rows, data, covered(data, 400), covered(data, 240)))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.n_passage, r.kept_sha256) for r in got) == want
    assert sum(w[2] for w in want) > 0 and sum(w[2] == 0 < w[4] for w in want) > 0


def test_query_on_the_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    got = queries.op6_suffix_dedup(spark, ROOT)
    assert got.dtypes[:5] == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("n_passage", "bigint")]
    held_against([(r.doc_id, r.text) for r in docs.collect()], got.collect())


@pytest.mark.parametrize("size", [300, 700])
def test_passage_of_very_many_texts(spark, size):
    """A third of all texts share one passage; more different fragments than a batch holds."""
    rng = random.Random(size)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = text(size)
    rows = [(k, text(rng.randrange(200, 500)) + (passage if k % 3 == 0 else "") + text(rng.randrange(0, 450))) for k in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = deduplicated(docs, RepeatParams(group=64), text=False, digest=True)
    data = [t.encode() for _, t in rows]
    want = sorted((i, *summary(t, g, p)) for (i, _), t, g, p in zip(rows, data, covered(data, 400), covered(data, 240)))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.n_passage, r.kept_sha256) for r in out.collect()) == want
