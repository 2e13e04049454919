"""Shared pieces of the training-data operators: lineage cuts, vectorised word hashing, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.operators.lineage import cut_lineage

U64 = np.uint64
MASK_CHUNK = 1 << 20  # bytes that are scanned together; one longer text is a chunk of its own


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def utf8_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the bounds of its values; null counts as empty."""
    array = pc.fill_null(array.cast(pa.large_string()), "")
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    _, offsets, data = array.buffers()
    bounds = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray, size: int = MASK_CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of values of about `size` bytes together."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        yield first, last
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants that are the same on every machine."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 2654435761 % 2**63)) | U64(1)


class WordHasher:
    """64-bit hashes of all words of a run of texts at once, from prefix sums of a rolling polynomial.

    Words are maximal runs of bytes outside `separators`; A-Z fold to a-z. With `drop`, those bytes
    (punctuation) count as separators too.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, separators: bytes = b" \t\n\x0b\x0c\r", fold: bool = True):
        self.separator = np.zeros(256, bool)
        self.separator[list(separators)] = True
        self.value = seeded(256, 7)
        if fold:
            self.value[65:91] = self.value[97:123]
        self.power, self.inverse = np.ones(1, U64), np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, MASK_CHUNK + 1)
            for name, base in (("power", self.BASE), ("inverse", pow(self.BASE, -1, 2**64))):
                steps = np.full(n, base, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and end byte of each word, and the bounds of each text's words."""
        n = len(data)
        if n == 0:
            return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
        self._grow(n)
        inside = ~self.separator[data]
        first = np.zeros(n, bool)
        first[bounds[:-1][bounds[:-1] < n]] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | first[1:]
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        sums = np.zeros(n + 1, U64)
        np.cumsum(self.value[data] * self.power[:n], out=sums[1:])
        hashes = mix64((sums[stops] - sums[starts]) * self.inverse[starts] + (stops - starts).astype(U64))
        return hashes, starts, stops, np.searchsorted(starts, bounds)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows; of the whole sequence if it is shorter; none if it is empty."""
    if len(words) == 0:
        return words
    if len(words) < n:
        n = len(words)
    factors = seeded(n, 11 + n)
    last = len(words) - n + 1
    total = words[:last] * factors[0]
    for k in range(1, n):
        total += words[k : k + last] * factors[k]
    return mix64(total)


def connected_components(edges: DataFrame, partitions: int | None = None) -> DataFrame:
    """(id, component): the smallest id that each end of the edges (src, dst) reaches.

    Rounds of contraction: each vertex points to its smallest neighbour, pointers are doubled twice, and
    the edges move to the pointers' ends. Each round drops at least half of the vertices of every component;
    only ids are shuffled, and each round is checkpointed.
    """
    edges = cut_lineage(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).where("src <> dst").distinct())
    total = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        pointer = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("to"))
        for _ in range(2):
            onward = pointer.select(F.col("src").alias("to"), F.col("to").alias("further"))
            pointer = pointer.join(onward, "to").select("src", F.col("further").alias("to"))
        pointer = cut_lineage(pointer)
        ends = pointer.select(F.col("src").alias("dst"), F.col("to").alias("new_dst"))
        # Only what still joins two vertices is kept; repeats fold in the next round's minimum.
        edges = cut_lineage(edges.join(pointer, "src").join(ends, "dst").select(F.col("to").alias("src"), F.col("new_dst").alias("dst")).where("src <> dst"))
        total = pointer.select(F.col("src").alias("id"), F.col("to").alias("component")) if total is None else relabelled(total, pointer)
    if total is None:
        return edges.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    return cut_lineage(total)


def relabelled(components: DataFrame, pointer: DataFrame) -> DataFrame:
    """(id, component) after the components that have one moved along pointer (src, to)."""
    onward = pointer.select(F.col("src").alias("component"), F.col("to").alias("further"))
    return components.join(onward, "component", "left").select("id", F.coalesce("further", "component").alias("component"))
