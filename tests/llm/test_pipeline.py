import hashlib
import sys

import numpy as np
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, "/root/repo")

import corpus_pipeline
from jobweave.llm import pii, quality, queries
from jobweave.llm.common import WordHasher
from jobweave.llm.decontaminate import SEPARATORS, DecontaminateParams, align, item_words
from jobweave.llm.queries import TOKENIZER, table
from tests.llm.test_minhash import brute_force

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return {r.doc_id: r for r in table(spark, ROOT, "documents").collect()}


def leaked(texts, items):
    """Every text against every item, aligned over the whole text."""
    params, hasher, out = DecontaminateParams(), WordHasher(SEPARATORS), set()
    for i, t in texts.items():
        data = np.frombuffer((t or "").encode(), np.uint8)
        words = hasher(data, np.array([0, len(data)]))[0]
        if any(align(w, words, params)[0] >= params.threshold * len(w) for w in items.values()):
            out.add(i)
    return out


def test_stages_against_brute_force(spark, rows):
    docs = table(spark, ROOT, "documents")
    model = quality.train(docs, table(spark, ROOT, "labels"))
    of = model.scorer()
    good = {i: r.text for i, r in rows.items() if of((r.text or "").encode()) >= model.params.threshold}
    groups = brute_force(list(good.items()), 80, 5)
    alone = {i: t for i, t in good.items() if groups[i][1] == i}
    items = item_words([(r.item_id, r.text) for r in table(spark, ROOT, "benchmark").collect()])
    bad = leaked(alone, items)
    kept = {i: t for i, t in alone.items() if i not in bad}
    assert len(rows) > len(good) > len(alone) > len(kept) > 0
    masked = {r.doc_id: r.text for r in pii.pseudonymised(docs.where(docs["doc_id"].isin(list(kept))), queries.surrogate_params(spark)).collect()}
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, ROOT).collect()}
    assert got.keys() == kept.keys()
    for i, t in masked.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_keep_the_columns_and_take_edges(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, None), (2, "", None, None, None), (None, "a b c d e f", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, ROOT)
            assert name == "bpe" or out.columns == docs.columns
            assert out.count() <= df.count()
