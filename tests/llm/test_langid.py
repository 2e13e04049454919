import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobweave.llm.langid import LangParams, fit, predict, train


def test_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    model = train(docs, learn)
    extra = spark.createDataFrame([(-1, None, 1.0), (-2, "", 1.0), (-3, "123 ... !", 1.0), (-4, "a", 1.0), (None, "the", 1.0), (-5, "the of and " * 20_000, 1.0)], "doc_id long, text string, score double")
    out = {r.doc_id: r for r in predict(docs.select("doc_id", "text").unionByName(extra, allowMissingColumns=True), model).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([out[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())
    assert out[-1].lang_pred == out[-2].lang_pred == out[-3].lang_pred == "und" and out[-4].lang_pred != "und" and out[-5].lang_pred == "en"
    assert predict(docs.limit(0), model).count() == 0
    assert train(docs.limit(0), learn).languages == ()
    assert {r.lang_pred for r in predict(docs.limit(5), train(docs.limit(0))).collect()} == {"und"}


def test_tables_are_the_convolution():
    params = LangParams(window=16, filters=3, epochs=1)
    model = fit([("a", "abc abd abe" * 9), ("b", "xyz xyw" * 9)], params)
    windows = np.random.default_rng(1).integers(0, 256, (5, 16)).astype(np.uint8)
    pooled = []
    for w, own in zip((2, 3, 4), model.filters):
        pooled.append(np.stack([sum(own[j][windows[:, t + j]] for j in range(w)) for t in range(13)]).max(axis=0))
    want = np.maximum(np.concatenate(pooled, axis=1) + model.bias, 0) @ model.dense + model.dense_bias
    assert np.allclose(model.logits(windows, model.tables()), want, atol=1e-4)


def test_dirty_languages_are_refused(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"), F.concat(F.lit("l"), (F.col("id") % 30).cast("string")).alias("lang"))
    with pytest.raises(ValueError, match="more than 20"):
        train(docs, None, LangParams(most_languages=20))
    assert len(train(docs, None, LangParams(most_languages=30, epochs=1)).languages) == 30


def test_predictions_against_plain_loops(spark):
    """Window by window, filter by filter, place by place."""
    params = LangParams(window=24, filters=2, epochs=1)
    model = fit([("a", "abc abd abe " * 9), ("b", "xyz xyw é " * 9)], params)
    texts = ["abc", "x", "xyz é" * 17, "abd xyw " * 30, "é"]
    for r in predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect():
        data = texts[r.doc_id].encode()
        total, weight, at = np.zeros(2), 0, 0
        while True:
            window = data[at : at + 24]
            padded = window + bytes(24 - len(window))
            pooled = []
            for w, own in zip((2, 3, 4), model.filters):
                for f in range(2):
                    pooled.append(max(sum(own[j][padded[p + j]][f] for j in range(w)) for p in range(24 - 3)))
            hidden = np.maximum(np.array(pooled) + model.bias, 0)
            total += (hidden @ model.dense + model.dense_bias) * len(window)
            weight += len(window)
            at += 24 - 3
            if at + 3 >= len(data):
                break
        p = np.exp(total / weight - (total / weight).max())
        p /= p.sum()
        assert r.lang_pred == model.languages[int(p.argmax())] and abs(r.score - p.max()) < 1e-4
