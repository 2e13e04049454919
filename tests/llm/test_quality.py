import zlib

import numpy as np
from pyspark.sql import functions as F

from jobweave.llm.quality import calibrated, score, train


def test_held_out_accuracy_and_edges(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    model = train(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    extra = spark.createDataFrame([(-1, None, "x"), (-2, "", "x"), (-3, "word " * 60_000, "x"), (None, "text", "x")], "doc_id long, text string, quality_score string")
    frame = docs.unionByName(extra, allowMissingColumns=True)
    out = score(frame, model)
    assert out.columns == [*docs.columns, "quality_score", "quality_pass"]
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == docs.count() + 4 and all(0 <= r.quality_score <= 1 and r.quality_pass == (r.quality_score >= 0.3) for r in rows.values())
    held = [(r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = np.array([rows[i].quality_pass == bool(q) for i, q in held])
    bad = np.array([q == 0 for _, q in held])
    assert right.mean() > 0.95 and right[bad].mean() > 0.8
    scores = np.array([rows[i].quality_score for i, _ in held])
    above = (scores[~bad][:, None] > scores[bad][None, :]).mean() + 0.5 * (scores[~bad][:, None] == scores[bad][None, :]).mean()
    print("auc", above, "bad kept", 1 - right[bad].mean(), "good kept", right[~bad].mean())
    assert above > 0.99 and right[~bad].mean() > 0.97


def test_calibration_never_falls():
    rng = np.random.default_rng(6)
    y = np.arange(400) % 4 > 0
    x = np.where(y, 0.1, -0.1) + rng.normal(0, 0.1, 400).round(2)
    curve = calibrated(x, y.astype(float), 0.75, 0.05)
    scores = curve(np.linspace(-2, 2, 2001))
    assert (np.diff(scores) > -1e-12).all() and 0 <= scores.min() < 0.1 and 0.9 < scores.max() <= 1
    assert abs(curve(x)[np.abs(x) < 0.05].mean() - y[np.abs(x) < 0.05].mean()) < 0.1


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.quality_score for r in score(docs, train(docs, none)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1), (1, 1), (7, None)], "doc_id long, quality int")
    assert all(r.quality_score > 0.9 for r in score(docs, train(docs, one)).collect())
    assert score(docs.limit(0), train(docs, none)).count() == 0
