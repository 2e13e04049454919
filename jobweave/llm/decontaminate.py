"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

One scan counts, over all documents, in how many each word, word pair and triple of the test items occurs. Each position of an item gives as its seed the
shortest of these that is rare. A second scan looks the seeds up in every text; where enough of an item's seeds lie together, the
words there are aligned with the item's, so that edited copies score too.

Rare is what few documents hold (`rare_share`), what is not much more frequent than the item's own pairs (so a passage that leaked a million
times keeps its seeds), and in any case the rarer quarter of the item's words (so edits that leave no pair whole still leave seeds). Grams that
no document holds can find nothing and are no seeds. Frequent words are therefore none, and the work for a text does not grow with the benchmark but by the
documents that share rare grams with it.

A passage that reaches the threshold by replacements keeps two thirds of the words or more, so it holds seeds enough wherever most edits fall; this is no proof, and
the tests compare with full alignment.

The seeds are broadcast in parts of at most `part_items` items and about `part_bytes` bytes of text; a larger benchmark takes more scans, not more memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import U64, WordHasher, chunks, cut_lineage, shingle_hashes, utf8_buffers

#: What separates words: all ASCII but letters and digits.
SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())


@dataclass(frozen=True)
class DecontaminateParams:
    words: int = 3  # an item of fewer is found only as a whole text
    threshold: float = 0.5  # of the item's own score
    mismatch: float = -0.5
    gap: float = -0.5
    longest_gram: int = 3
    rare_share: float = 0.001  # of the documents; what fewer hold is rare
    rare_documents: int = 4  # at least
    rare_times: int = 4  # as frequent as the rarer quarter of the item's own pairs
    part_items: int = 20_000
    part_bytes: int = 16 << 20
    held_hits: int = 1 << 21  # hits that are sorted together

    def hits(self, m: int) -> int:
        """Seeds that call for a closer look, of an item of m words."""
        return 1 if m < 12 else 2

    def reach(self, m: int) -> int:
        """Words of the longest passage that can reach the threshold."""
        return m + int((1 - self.threshold) * m / -self.gap + 1e-9) if self.gap < 0 else 1 << 40


def align(item: np.ndarray, text: np.ndarray, params: DecontaminateParams) -> tuple[float, int, int]:
    """Best local alignment: score (1 a matching word), and the bounds of its words in text."""
    n = len(text)
    steps = np.arange(n + 1) * -params.gap
    above, from_above = np.zeros(n + 1), np.arange(n + 1)
    best = (0.0, 0, 0)
    for word in item:
        diagonal = above[:-1] + np.where(text == word, 1.0, params.mismatch)
        row, origin = np.zeros(n + 1), np.arange(n + 1)
        take = diagonal > 0
        row[1:][take], origin[1:][take] = diagonal[take], from_above[:-1][take]
        down = above + params.gap
        take = down > row
        row[take], origin[take] = down[take], from_above[take]
        # Gaps along the text: the best start to the left, less the gap's length.
        lifted = row + steps
        peak = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == peak, np.arange(n + 1), 0))
        row, origin = peak - steps, origin[source]
        end = int(row.argmax())
        if row[end] > best[0]:
            best = (float(row[end]), int(origin[end]), end)
        above, from_above = row, origin
    return best


class Lookup:
    """Members of a fixed set of hashes: a bitmap first, the sorted hashes for what passes it."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        bits = max(16, int(len(self.sorted) * 8).bit_length())
        self.mask = U64((1 << bits) - 1)
        self.bitmap = np.zeros(1 << bits, bool)
        self.bitmap[(self.sorted & self.mask).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in hashes that hold a member, and the member's index."""
        if not len(self.sorted) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.flatnonzero(self.bitmap[(hashes & self.mask).astype(np.int64)])
        index = np.minimum(np.searchsorted(self.sorted, hashes[place]), len(self.sorted) - 1)
        right = self.sorted[index] == hashes[place]
        return place[right], index[right]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows."""
    return words if n == 1 else shingle_hashes(words, n) if len(words) >= n else words[:0]


def found_grams(lookup: Lookup, words: np.ndarray, own: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place, member and text of the windows of up to `longest` words that are members, in order of places; own: the bounds of the texts' words."""
    places, members = [], []
    for n in range(1, longest + 1):
        place, index = lookup.find(grams(words, n))
        inside = np.searchsorted(own, place, "right") == np.searchsorted(own, place + n - 1, "right")
        places.append(place[inside])
        members.append(index[inside])
    place, index = np.concatenate(places), np.concatenate(members)
    order = np.argsort(place, kind="stable")
    place, index = place[order], index[order]
    return place, index, np.searchsorted(own, place, "right") - 1


def item_words(items: list[tuple[int, str]]) -> dict[int, np.ndarray]:
    """The words of each text by its place in items: several texts of one id are several items until the end."""
    hasher, out = WordHasher(SEPARATORS), {}
    for k, (_, text) in enumerate(items):
        data = np.frombuffer((text or "").encode(), np.uint8)
        words = hasher(data, np.array([0, len(data)]))[0]
        if len(words):
            out[k] = words
    return out


def benchmark_parts(benchmark: DataFrame, params: DecontaminateParams):
    """The items in parts of bounded size."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(-(-size["n"] // params.part_items), -(-size["bytes"] // params.part_bytes))
    for k in range(parts):
        yield [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()]


def seed_counts(docs: DataFrame, wanted: np.ndarray, params: DecontaminateParams) -> tuple[dict[int, int], int]:
    """The number of documents that hold each of the grams, and of all documents."""

    def scan(batches):
        hasher, lookup = WordHasher(SEPARATORS), Lookup(wanted)
        total, texts = np.zeros(len(lookup.sorted), np.int64), 0
        for batch in batches:
            data, bounds = utf8_buffers(batch.column(0))
            texts += len(bounds) - 1
            for first, last in chunks(bounds):
                part = bounds[first : last + 1]
                words, _, _, own = hasher(data[part[0] : part[-1]], part - part[0])
                _, index, text = found_grams(lookup, words, own, params.longest_gram)
                seen = np.unique(text * len(lookup.sorted) + index)
                np.add.at(total, seen % len(lookup.sorted), 1)
        held = np.flatnonzero(total)
        seeds = [*lookup.sorted[held].astype(np.int64).tolist(), None]
        yield pa.RecordBatch.from_arrays([pa.array(seeds, pa.int64()), pa.array([*total[held].tolist(), texts], pa.int64())], ["seed", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(scan, "seed long, n long")
    # One row at most for each gram of a part of the benchmark.
    rows = counted.groupBy("seed").agg(F.sum("n").alias("n")).collect()
    return {r.seed & 0xFFFFFFFFFFFFFFFF: r.n for r in rows if r.seed is not None}, sum(r.n for r in rows if r.seed is None)


def quarter(counts: list[int]) -> int:
    """The count that a quarter of the counts do not exceed."""
    return sorted(counts)[(len(counts) - 1) // 4] if counts else 0


def rare_seeds(words: dict[int, np.ndarray], counts: dict[int, int], docs: int, params: DecontaminateParams) -> tuple[np.ndarray, np.ndarray]:
    """seed, item: of each position of an item the shortest rare gram that begins there."""
    rows = set()
    for item_id, own in words.items():
        table = [grams(own, n).tolist() for n in range(1, params.longest_gram + 1)]
        held = [[counts.get(g, 0) for g in row] for row in table]
        pairs = held[1] if len(held) > 1 else []
        limit = max(params.rare_documents, params.rare_share * docs, params.rare_times * quarter(pairs), quarter([c for c in held[0] if c]))
        for k in range(len(own)):
            seed = next((row[k] for row, n in zip(table, held, strict=True) if k < len(row) and 0 < n[k] <= limit), None)
            if seed is not None:
                rows.add((seed, item_id))
    rows = sorted(rows)
    return np.array([r[0] for r in rows], U64), np.array([r[1] for r in rows], np.int64)


class Seeds:
    """Finds the stretches of texts that may hold a passage of an item."""

    def __init__(self, words_of: dict[int, np.ndarray], seed: np.ndarray, item: np.ndarray, params: DecontaminateParams):
        self.params, self.words_of = params, words_of
        self.items = np.unique(item)
        self.lookup = Lookup(seed)
        rank = np.searchsorted(self.items, item)
        self.post = np.searchsorted(self.lookup.sorted, seed) * max(1, len(self.items)) + rank  # sorted, as (seed, item) are
        self.rank = rank
        sizes = [len(words_of[i]) for i in self.items.tolist()]
        self.hits, self.reach = (np.array([f(m) for m in sizes], np.int64) for f in (params.hits, params.reach))
        self.distinct, self.cost = {}, max(0.0, min(-params.mismatch, -params.gap))

    def stretches(self, words: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, begin, end) of words; own: the bounds of the texts' words."""
        place, index, text = found_grams(self.lookup, words, own, self.params.longest_gram)
        yield from self._within(words, own, place, index, text, 0, len(self.items))

    def _within(self, words, own, place, index, text, low, high):
        if not len(place):
            return
        n = len(self.items)
        first, last = np.searchsorted(self.post, index * n + low), np.searchsorted(self.post, index * n + high)
        times = last - first
        total = int(times.sum())
        if total > self.params.held_hits and text[0] != text[-1]:
            # Fewer texts at once, then fewer items: a text is not cut.
            cut = int(np.searchsorted(text, text[len(text) // 2]))
            cut = cut or int(np.searchsorted(text, text[0], "right"))
            for part in (slice(0, cut), slice(cut, None)):
                yield from self._within(words, own, place[part], index[part], text[part], low, high)
            return
        if total > self.params.held_hits and high - low > 1:
            middle = (low + high) // 2
            yield from self._within(words, own, place, index, text, low, middle)
            yield from self._within(words, own, place, index, text, middle, high)
            return
        # The hits of each item in order of their places, in one number each.
        stride = len(words) + 1
        at = np.repeat(first - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(total)
        key = self.rank[at] * stride + np.repeat(place, times)
        key.sort()
        item, place = np.divmod(key, stride)
        end = np.arange(total) + self.hits[item] - 1
        begin = np.flatnonzero(end < total)
        end = end[begin]
        near = (item[begin] == item[end]) & (place[end] - place[begin] < self.reach[item[begin]])
        begin, end = begin[near], end[near]
        text = np.searchsorted(own, place[begin], "right") - 1
        same = place[end] < own[text + 1]
        begin, end, text = begin[same], end[same], text[same]
        if not len(begin):
            return
        item, reach = item[begin], self.reach[item[begin]]
        start, stop = np.maximum(own[text], place[end] - reach + 1), np.minimum(own[text + 1], place[begin] + reach)
        breaks = np.flatnonzero((np.diff(item) != 0) | (np.diff(text) != 0) | (start[1:] > stop[:-1])) + 1
        for a, b in zip([0, *breaks.tolist()], [*(breaks - 1).tolist(), len(item) - 1], strict=True):
            yield from self._dense(words, int(text[a]), int(self.items[item[a]]), int(start[a]), int(stop[b]))

    def _dense(self, words, text, item, start, stop):
        """The part of a stretch that can reach the threshold if every word of the item's counts, wherever it stands, and every other costs."""
        mine = self.words_of[item]
        if item not in self.distinct:
            self.distinct[item] = np.unique(mine)
        distinct, part = self.distinct[item], words[start:stop]
        held = distinct[np.minimum(np.searchsorted(distinct, part), len(distinct) - 1)] == part
        total = np.concatenate([[0.0], np.cumsum(np.where(held, 1.0, -self.cost))])
        wanted = self.params.threshold * len(mine) - 1e-9
        ends = np.flatnonzero(total - np.minimum.accumulate(total) >= wanted)
        if len(ends):
            begins = np.flatnonzero(np.maximum.accumulate(total[::-1])[::-1] - total >= wanted)
            yield text, item, start + int(begins[0]), start + int(ends[-1])


def leaks(docs: DataFrame, benchmark: DataFrame, params: DecontaminateParams | None = None) -> DataFrame:
    """doc_id, item_id, score (share of the item's own alignment score), start and end (bytes of the passage in the text).

    One row for each document and item whose best alignment reaches the threshold. Null or empty texts and items, items and
    documents without words and null ids give no rows; a repeated document gives its rows once, as does an id that several item texts have. An item under
    `words` words is found where its words stand in a row and fill the document. Other columns are ignored.
    """
    params = params or DecontaminateParams()
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    out = None
    for items in benchmark_parts(benchmark, params):
        words = item_words(items)
        if not words:
            continue
        wanted = [grams(w, n) for w in words.values() for n in range(1, params.longest_gram + 1)]
        counts, total = seed_counts(texts, np.unique(np.concatenate(wanted)), params)
        seeds = rare_seeds({i: w for i, w in words.items() if len(w) >= params.words}, counts, total, params)
        # At most part_items items and about part_bytes bytes: a fixed bound.
        found = _aligned(texts, spark.sparkContext.broadcast(([i for i, _ in items], words, seeds)), params)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "doc_id long, item_id long, score double, start long, end long")
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "start", "end")).alias("best")).select("doc_id", "item_id", "best.score", "best.start", "best.end")


def _aligned(texts: DataFrame, shared, params: DecontaminateParams) -> DataFrame:
    def scan(batches):
        item_ids, words_of, (seed, item) = shared.value
        hasher, seeds = WordHasher(SEPARATORS), Seeds(words_of, seed, item, params)
        short: dict[bytes, list[int]] = {}
        for i, w in words_of.items():
            if len(w) < params.words:
                short.setdefault(w.tobytes(), []).append(i)
        for batch in batches:
            data, bounds = utf8_buffers(batch.column(0))
            ids, rows = batch.column(1), []
            for first, last in chunks(bounds):
                part = bounds[first : last + 1]
                words, starts, stops, own = hasher(data[part[0] : part[-1]], part - part[0])
                whole = np.flatnonzero((np.diff(own) > 0) & (np.diff(own) < params.words)).tolist() if short else []
                found = [(t, i, int(own[t]), int(own[t + 1])) for t in whole for i in short.get(words[own[t] : own[t + 1]].tobytes(), [])]
                for t, i, begin, end in chain(found, seeds.stretches(words, own)):
                    mine = words_of[i]
                    score, x, y = align(mine, words[begin:end], params)
                    if score >= params.threshold * len(mine):
                        offset = int(part[t] - part[0])
                        rows.append((ids[first + t].as_py(), item_ids[i], score / len(mine), int(starts[begin + x]) - offset, int(stops[begin + y - 1]) - offset))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "start", "end"])

    return texts.mapInArrow(scan, "doc_id long, item_id long, score double, start long, end long")


def without_leaks(docs: DataFrame, benchmark: DataFrame, params: DecontaminateParams | None = None) -> DataFrame:
    """docs without the documents that hold a test item; rows with a null doc_id stay."""
    bad = cut_lineage(leaks(docs, benchmark, params).select(F.col("doc_id").alias("_leaked")).distinct())
    return docs.join(bad, docs["doc_id"].cast("long") == bad["_leaked"], "left_anti")
