"""Quality scores from compression.

Two zstandard dictionaries are built from bounded samples of good and bad labelled text. A text is compressed
block by block with each. The difference of the two sizes, normalised by the text's size, is all that the score reads: a monotone
calibration turns it into a probability. It is fitted by parts: each part of the sample is compressed with dictionaries of the others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

LEVEL = 3


@dataclass(frozen=True)
class QualityParams:
    sample_per_label: int = 3000  # labelled documents of each class that reach the driver
    window_chars: int = 2000  # of each, one window at a place that a hash picks
    dictionary_bytes: int = 112_640
    block_bytes: int = 1024
    folds: int = 3
    blend: float = 0.05  # of the logistic curve in the calibration, so that it rises everywhere
    threshold: float = 0.3


@dataclass(frozen=True)
class Calibration:
    """From differences to probabilities, never falling: a step function with its steps joined by lines, blended with a logistic curve."""

    at: tuple[float, ...]
    probability: tuple[float, ...]
    weights: tuple[float, float]
    blend: float

    def __call__(self, difference):
        x = np.asarray(difference, float)
        smooth = 1 / (1 + np.exp(-np.clip(self.weights[0] + self.weights[1] * x, -30, 30)))
        return (1 - self.blend) * np.interp(x, self.at, self.probability) + self.blend * smooth


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    calibration: Calibration | None  # None: every score is the base rate
    base_rate: float  # the score of an empty text
    params: QualityParams = field(default_factory=QualityParams)

    def scorer(self):
        good, bad = compressor(self.good), compressor(self.bad)

        def score(text: bytes) -> float:
            if not text or self.calibration is None:
                return self.base_rate
            return float(self.calibration(difference(text, good, bad, self.params.block_bytes)))

        return score


def compressor(content: bytes):
    dictionary = zstandard.ZstdCompressionDict(content)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False).compress


def difference(text: bytes, good, bad, size: int) -> float:
    """Bytes that the good dictionary saves over the bad one, for each byte of text."""
    return sum(len(bad(x)) - len(good(x)) for x in (text[k : k + size] for k in range(0, len(text), size))) / len(text)


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; the plain concatenation where there is too little text to train one."""
    samples = [x for x in samples if len(x) > 8]
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)[-size:] or b"\n" * 8


def labelled_sample(docs: DataFrame, labels: DataFrame, learn, params: QualityParams) -> list[tuple[int, bytes]]:
    """(label, window of the text): at most sample_per_label of each class, picked by a hash of doc_id."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learn).select(F.col("doc_id").alias("_id"), F.col("quality").alias("_label")).distinct()
    picked = None
    for label in (0, 1):
        part = known.where(F.col("_label") == label).orderBy(F.xxhash64(F.lit(41), "_id"), "_id").limit(params.sample_per_label)
        picked = part if picked is None else picked.unionByName(part)
    # Two classes of sample_per_label ids: a fixed bound, so this side is broadcast.
    text = F.col("text").cast("string")
    place = F.pmod(F.xxhash64(F.lit(43), "doc_id"), F.greatest(F.lit(1), F.length(text) - params.window_chars + 1)).cast("int") + 1
    rows = (
        docs.where("text is not null")
        .join(F.broadcast(picked), docs["doc_id"] == picked["_id"])
        .select("_label", F.substring(text, place, F.lit(params.window_chars)).alias("window"), F.xxhash64(F.lit(47), "doc_id").alias("_order"))
        .groupBy("_order", "_label")
        .agg(F.min("window").alias("window"))
        .collect()
    )
    return [(r["_label"], r["window"].encode()) for r in sorted(rows, key=lambda r: (r["_order"], r["_label"]))]


def train(docs: DataFrame, labels: DataFrame, learn=None, params: QualityParams | None = None) -> QualityModel:
    """learn: a predicate on labels' rows that may be learned from. Rows without a label of 0 or 1, or whose
    document is missing or null, teach nothing; of several texts of one doc_id the smallest window does. Without both classes, or with fewer than two texts of one, every score is the share of label 1 (0.5 without labels).
    """
    params = params or QualityParams()
    learn = F.lit(True) if learn is None else learn
    sample = labelled_sample(docs, labels, learn, params)
    counts = {r["quality"]: r["n"] for r in labels.where(F.col("quality").isin(0, 1) & learn).groupBy("quality").agg(F.count("*").alias("n")).collect()}
    good_n, bad_n = counts.get(1, 0), counts.get(0, 0)
    rate = good_n / (good_n + bad_n) if good_n + bad_n else 0.5
    by_label = {y: [t for label, t in sample if label == y] for y in (0, 1)}
    by_label = {y: [t for t in x if t] for y, x in by_label.items()}
    if min(map(len, by_label.values())) < 2:
        return QualityModel(b"\n" * 8, b"\n" * 8, None, rate, params)
    folds, found = min(params.folds, *map(len, by_label.values())), []
    for k in range(folds):
        bad, good = (compressor(dictionary([t for i, t in enumerate(x) if i % folds != k], params.dictionary_bytes)) for x in (by_label[0], by_label[1]))
        found += [(difference(t, good, bad, params.block_bytes), y) for y, x in by_label.items() for t in x[k::folds]]
    whole = {y: dictionary(x, params.dictionary_bytes) for y, x in by_label.items()}
    return QualityModel(whole[1], whole[0], calibrated(*map(np.array, zip(*found, strict=True)), rate, params.blend), rate, params)


def calibrated(x: np.ndarray, y: np.ndarray, rate: float, blend: float) -> Calibration:
    """The never falling curve of least squares (adjacent violators are pooled) and a logistic one by Newton steps; the classes are weighted to their share among all labels."""
    weight = np.where(y == 1, rate / y.mean(), (1 - rate) / (1 - y.mean()))
    pools = []  # weight of label 1, weight, first and last difference
    for at in np.unique(x):
        here = x == at
        pools.append([float(weight[here & (y == 1)].sum()), float(weight[here].sum()), at, at])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            good, total, _, last = pools.pop()
            pools[-1][:2] = pools[-1][0] + good, pools[-1][1] + total
            pools[-1][3] = last
    scale = max(float(x.std()), 1e-9)
    features, w, ridge = np.stack([np.ones(len(x)), x / scale], 1), np.zeros(2), 1e-3 * np.eye(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        step = np.linalg.solve((features * (weight * p * (1 - p))[:, None]).T @ features + ridge, features.T @ ((p - y) * weight) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    # A good dictionary that saves nothing on good text would turn the curve over: it then stays flat.
    weights = (float(w[0]), max(0.0, float(w[1])) / scale)
    return Calibration(tuple((a + b) / 2 for _, _, a, b in pools), tuple(g / n for g, n, _, _ in pools), weights, blend)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with quality_score (0 to 1) and quality_pass appended; a null text scores as an empty one.

    docs needs a text column; its other columns pass through, but for columns of these two names, which are replaced.
    """
    base = docs.drop("quality_score", "quality_pass")
    at = [c.lower() for c in base.columns].index("text")

    def scan(batches):
        of = model.scorer()
        for batch in batches:
            text = pc.fill_null(batch.column(at).cast(pa.large_string()), "").cast(pa.large_binary())
            scores = np.array([of(t.as_py()) for t in text], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores), pa.array(scores >= model.params.threshold)], [*batch.schema.names, "quality_score", "quality_pass"]
            )

    schema = StructType([*base.schema.fields, StructField("quality_score", DoubleType()), StructField("quality_pass", BooleanType())])
    return base.mapInArrow(scan, schema)
