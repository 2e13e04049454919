"""Language identification by a byte convolutional network.

Filters of widths 2, 3 and 4 over one-hot bytes, a maximum over each fixed-length window, and a softmax layer; trained in
numpy on a bounded sample of labelled text. Over one-hot bytes a convolution is a sum of table rows, so windows are scored with two
look-ups of byte pairs a position. A text's score is the softmax of its windows' mean logits, over the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobweave.llm.common import utf8_buffers

WIDTHS = (2, 3, 4)
REACH = max(WIDTHS) - 1
UNKNOWN = "und"


@dataclass(frozen=True)
class LangParams:
    sample_per_language: int = 1500  # labelled documents of each language that reach the driver
    most_languages: int = 1000  # values of lang that may be learned; more are an error, as they are no languages
    sample_chars: int = 600  # of each, one stretch at a place that a hash picks
    window: int = 256
    filters: int = 12  # of each width
    epochs: int = 6
    rate: float = 0.05
    seed: int = 20


@dataclass(frozen=True)
class LangModel:
    languages: tuple[str, ...]
    filters: tuple[np.ndarray, ...]  # one (width, 256, filters) for each width
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    params: LangParams

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The part of all filters that a pair of bytes adds at its place, and two places on."""
        w2, w3, w4 = self.filters
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
        none = np.zeros_like(w2[0])
        here = np.concatenate([pair(w2[0], w2[1]), pair(w3[0], w3[1]), pair(w4[0], w4[1])], axis=1) + self.bias
        onward = np.concatenate([pair(none, none), pair(w3[2], none), pair(w4[2], w4[3])], axis=1)
        return here.astype(np.float32), onward.astype(np.float32)

    def logits(self, windows: np.ndarray, tables) -> np.ndarray:
        """windows: bytes, a row each."""
        here, onward = tables
        wide = windows.astype(np.int32)
        pairs = wide[:, :-1] << 8 | wide[:, 1:]
        n = pairs.shape[1] - 2
        out = np.take(here, pairs[:, :n].ravel(), axis=0)
        out += np.take(onward, pairs[:, 2 : n + 2].ravel(), axis=0)
        pooled = out.reshape(len(windows), n, -1).max(axis=1)
        return np.maximum(pooled, 0) @ self.dense + self.dense_bias


def windows_of(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the windows that cover each text (they overlap by REACH), and the bounds of each text's windows."""
    lengths = np.diff(bounds)
    step = size - REACH
    counts = np.maximum(1, -(-(lengths - REACH) // step))
    counts[lengths == 0] = 0
    own = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(lengths)), counts)
    starts = bounds[text] + (np.arange(own[-1]) - own[text]) * step
    return starts, np.minimum(starts + size, bounds[text + 1]), own


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """The windows as rows of bytes, zeros after a text's end."""
    at = starts[:, None] + np.arange(size)
    rows = data[np.minimum(at, len(data) - 1)]
    if (ends - starts < size).any():
        rows[at >= ends[:, None]] = 0
    return rows


def fit(samples: list[tuple[str, str]], params: LangParams) -> LangModel:
    """samples: (language, text)."""
    languages = tuple(sorted({lang for lang, _ in samples}))
    rng = np.random.default_rng(params.seed)
    f, size = params.filters, params.window
    weights = [rng.normal(0, 0.3, (w, 256, f)) for w in WIDTHS]
    bias, dense, dense_bias = np.zeros(f * len(WIDTHS)), rng.normal(0, 0.3, (f * len(WIDTHS), len(languages))), np.zeros(len(languages))
    rows, labels = [], []
    for lang, text in samples:
        data = np.frombuffer(text.encode(), np.uint8)
        if len(data):
            starts, ends, _ = windows_of(data, np.array([0, len(data)]), size)
            rows.append(gathered(data, starts, ends, size))
            labels += [languages.index(lang)] * len(starts)
    if not rows:
        return LangModel((), tuple(weights), bias, dense, dense_bias, params)
    x, y = np.concatenate(rows), np.array(labels)
    share = np.bincount(y, minlength=len(languages))
    importance = (len(y) / np.maximum(share, 1) / len(languages))[y]
    state = [weights[0], weights[1], weights[2], bias, dense, dense_bias]
    squares = [np.full_like(s, 1e-6) for s in state]
    places = size - REACH
    for _ in range(params.epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), 128):
            some = order[k : k + 128]
            batch, n = x[some], len(some)
            pooled, best = [], []
            for w, own in zip(WIDTHS, weights, strict=True):
                conv = sum(own[j][batch[:, j : j + places]] for j in range(w))
                best.append(conv.argmax(axis=1))
                pooled.append(np.take_along_axis(conv, best[-1][:, None, :], axis=1)[:, 0])
            raw = np.concatenate(pooled, axis=1) + bias
            hidden = np.maximum(raw, 0)
            out = hidden @ dense + dense_bias
            p = np.exp(out - out.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[some]] -= 1
            p *= importance[some, None] / n
            back = (p @ dense.T) * (raw > 0)
            steps = [np.zeros_like(s) for s in weights] + [back.sum(axis=0), hidden.T @ p + 1e-4 * dense, p.sum(axis=0)]
            for i, w in enumerate(WIDTHS):
                part = back[:, i * f : (i + 1) * f]
                for j in range(w):
                    np.add.at(steps[i][j], (batch[np.arange(n)[:, None], best[i] + j], np.arange(f)), part)
            for s, q, g in zip(state, squares, steps, strict=True):
                q += g * g
                s -= params.rate * g / np.sqrt(q)
    return LangModel(languages, tuple(weights), bias, dense, dense_bias, params)


def train(docs: DataFrame, learn: Column | None = None, params: LangParams | None = None) -> LangModel:
    """Learns from rows with a lang and a text with a letter for which learn holds; a bounded sample of each language."""
    params = params or LangParams()
    text = F.col("text").cast("string")
    rows = docs.where(F.col("lang").isNotNull() & text.rlike(r"\p{L}") & (F.lit(True) if learn is None else learn))
    order = F.xxhash64(F.lit(params.seed), "doc_id")
    # Languages are few. Of a frequent one only rows with low hashes go on, many times the sample, so that the ranking below stays small.
    counts = {r.lang: r.n for r in rows.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")).limit(params.most_languages + 1).collect()}
    if len(counts) > params.most_languages:
        raise ValueError(f"more than {params.most_languages} different languages: clean the column or raise most_languages")
    shares = [F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4 * params.sample_per_language / n))]
    if shares:
        place = F.shiftrightunsigned(order, 11) / float(1 << 53)
        rows = rows.where(place < F.element_at(F.create_map(*[x if k % 2 == 0 else x.cast("double") for k, x in enumerate(shares)]), F.col("lang").cast("string")))
    offset = F.pmod(F.xxhash64(F.lit(params.seed + 1), "doc_id"), F.greatest(F.lit(1), F.length(text) - params.sample_chars + 1)).cast("int") + 1
    cut = rows.select(F.col("lang").cast("string").alias("lang"), order.alias("o"), F.substring(text, offset, F.lit(params.sample_chars)).alias("t"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "t"))
    sample = cut.withColumn("r", rank).where(F.col("r") <= params.sample_per_language).collect()
    return fit([(r.lang, r.t) for r in sorted(sample, key=lambda r: (r.lang, r.o, r.t))], params)


def predict(docs: DataFrame, model: LangModel) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of each row, from its whole text.

    `und` with score 0 for a null text, one without a letter, or a model that learned no language. Repeated and null doc_ids give
    their rows; other columns are ignored.
    """

    def scan(batches):
        tables, size = model.tables(), model.params.window
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            data, bounds = utf8_buffers(batch.column(1))
            starts, ends, own = windows_of(data, bounds, size)
            logits = np.zeros((len(starts), len(model.languages)))
            for k in range(0, len(starts), 64):
                logits[k : k + 64] = model.logits(gathered(data, starts[k : k + 64], ends[k : k + 64], size), tables)
            weight = (ends - starts).astype(float)
            texts = len(bounds) - 1
            best, score = np.full(texts, len(names) - 1), np.zeros(texts)
            full = np.flatnonzero(np.diff(own) > 0) if len(model.languages) else np.zeros(0, int)
            if len(full):
                total = np.add.reduceat(logits * weight[:, None], own[full], axis=0) / np.add.reduceat(weight, own[full])[:, None]
                p = np.exp(total - total.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best[full], score[full] = p.argmax(axis=1), p.max(axis=1)
            silent = ~batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            best[silent], score[silent] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(scan, "doc_id long, lang_pred string, score double")
