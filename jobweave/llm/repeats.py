"""Removal of repeated byte strings by merged Burrows-Wheeler transforms.

A string of `passage` bytes that starts at two places has the same least hash of `gram` consecutive bytes at both. A scan
cuts each text into fragments: runs of starts whose strings share that least hash (the anchor), with the bytes up to `length` after
them. So all occurrences of a string of `passage` bytes or more start in fragments of one anchor. Equal fragments (a 128-bit
cryptographic digest of their bytes) are counted together; anchors with one fragment only hold nothing repeated and drop out. What is left
is grouped by anchor. A task takes whole groups in batches of bounded size. There a symbol is `step` bytes (equal hashes are
confirmed by their bytes), and the starts of a fragment that lie a multiple of `step` apart are a text of symbols. The texts are dealt to
shards; each shard's Burrows-Wheeler transform is built, and the transforms are merged by refining the interleave: each round sorts the
merged sequence stably by the preceding symbols, which orders suffixes by one more symbol, and the round in which two neighbours
part is their common prefix. The repeated intervals follow from the common prefixes of neighbouring starts.

An anchor with very many different fragments is split by the place of the string around the anchor and by the content that
all strings of that place share; only parts that share that content can share a string. What is still too large is split into single
starts, of which only digests are counted.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobweave.llm.common import U64, WordHasher, chunks, cut_lineage, mix64, seeded, text_or_empty, utf8_buffers
from jobweave.operators.lineage import written

NODE = ["h1", "h2"]
SPANS = "array<struct<first:int,last:int,whole:boolean>>"
SPANS_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("whole", pa.bool_())]))


@dataclass(frozen=True)
class RepeatParams:
    length: int = 400  # bytes of a string that is removed where it is repeated
    passage: int = 240  # bytes of a repeated string that is reported
    gram: int = 80  # bytes whose hash is an anchor; a string of `passage` holds passage - gram + 1 of them
    step: int = 80  # bytes of a symbol; divides length and passage
    longest: int = 256  # starts of a fragment
    group: int = 1024  # different fragments of a group that one batch may hold
    batch_bytes: int = 1 << 16  # what is merged at once fits a processor cache
    shards: int = 4
    grain: int = 16  # places that a part of a split group spans

    def __post_init__(self):
        if self.length % self.step or self.passage % self.step or not 0 < self.gram <= self.passage <= self.length or not 0 < self.grain <= self.passage:
            raise ValueError("step must divide length and passage; gram and grain must not exceed passage, nor passage length")


class Rolling:
    """64-bit hashes of any stretch of bytes, from prefix sums of a polynomial: they find what may be equal, bytes or digests confirm it."""

    def __init__(self):
        self.value, self.power, self.inverse = seeded(256, 23), np.ones(1, U64), np.ones(1, U64)

    def __call__(self, data: np.ndarray):
        n = len(data) + 1
        if len(self.power) < n:
            size = max(2 * n, 1 << 16)
            self.power, self.inverse = (np.full(size, b, U64) for b in (WordHasher.BASE, pow(WordHasher.BASE, -1, 2**64)))
            for x in (self.power, self.inverse):
                x[0] = 1
                np.multiply.accumulate(x, out=x)
        sums = np.zeros(n, U64)
        np.cumsum(self.value[data] * self.power[: n - 1], out=sums[1:])
        # Not mixed: differences of sums at the same place, taken to place 0.
        return lambda start, end: (sums[end] - sums[start]) * self.inverse[start]


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, place in the group) of each member."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def over_windows(of, values: np.ndarray, width: int) -> np.ndarray:
    """np.minimum or np.maximum over each window, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = of(out[:-have], out[have:])
        have *= 2
    return out if have == width else of(out[: len(out) - (width - have)], out[width - have :])


def holds_twice(h: np.ndarray, low: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """For each run of windows of one minimum whether that may occur in it twice (never a miss).

    A place is a minimum of some window if the greatest minimum of its windows is its own value; two such places of one value
    that a window's width parts at most are next to each other among them.
    """
    twice = np.zeros(len(first), bool)
    edge = np.zeros(width - 1, low.dtype)
    own = np.flatnonzero(over_windows(np.maximum, np.concatenate([edge, low, edge]), width) == h)
    again = np.flatnonzero((h[own[1:]] == h[own[:-1]]) & (np.diff(own) <= width))
    for a, b in zip(own[again].tolist(), own[again + 1].tolist()):
        begin, end = np.searchsorted(first, (max(0, b - width), min(a + 1, len(low) - 1)), "right")
        twice[max(0, begin - 1) : end] = True
    return twice


def digests(data: bytes | memoryview, start: np.ndarray, end: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two longs for each stretch: a digest of its bytes and of the number of its starts."""
    digest = hashlib.blake2b
    joined = b"".join([digest(data[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)])
    out = np.frombuffer(joined, np.int64).reshape(-1, 2).copy()
    out[:, 0] ^= mix64(starts.astype(U64)).astype(np.int64)
    return out


def fragments(data: np.ndarray, bounds: np.ndarray, rolling: Rolling, params: RepeatParams, counted: bool = True) -> tuple[np.ndarray, ...]:
    """anchor, h1, h2, number of starts, bytes, first start and (if counted) whether the anchor may occur twice, of the fragments of a run of texts, and whose they are."""
    width = params.passage - params.gram + 1
    ends = bounds[1:]
    text, place = spread(np.maximum(np.diff(bounds) - params.passage + 1, 0))
    if not len(text):
        return tuple(np.zeros(0, np.int64) for _ in range(8))
    valid = bounds[text] + place  # the starts: windows over a text's end are no one's
    of = rolling(data)
    at = np.arange(len(data) - params.gram + 1)
    h = mix64(of(at, at + params.gram))
    low = over_windows(np.minimum, h, width)
    mine = low[valid]
    run = np.concatenate([[0], np.flatnonzero((mine[1:] != mine[:-1]) | (text[1:] != text[:-1])) + 1])
    first, length = valid[run], np.diff(np.concatenate([run, [len(valid)]]))
    twice = holds_twice(h, low, first, width) if counted else np.zeros(len(first), bool)
    piece, place = spread(-(-length // params.longest))
    start = first[piece] + place * params.longest
    starts = np.minimum(first[piece] + length[piece] - start, params.longest)
    whose = text[run][piece]
    end = np.minimum(start + starts - 1 + params.length, ends[whose])
    key = digests(memoryview(data), start, end, starts)
    return low[start].astype(np.int64), key[:, 0], key[:, 1], starts.astype(np.int32), (end - start).astype(np.int32), (start - bounds[whose]).astype(np.int32), twice[piece], whose


def occurrences(texts: DataFrame, params: RepeatParams, counted: bool) -> DataFrame:
    """h1, h2, at (first start), d (digest of the text): the fragments of all texts (d, text).

    counted: with anchor, starts and size, one row for the equal fragments of a run of texts with their number n and whether the anchor
    occurs twice in one. An anchor that different fragments of the run have is shared for sure: they need no company to tell, and one row
    with n = 0 tells the others of that anchor.
    """

    def scan(batches):
        rolling = Rolling()
        for batch in batches:
            data, bounds = utf8_buffers(batch.column(1))
            found = []
            for a, b in chunks(bounds, 1 << 17):  # in a processor cache
                part = fragments(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], rolling, params, counted)
                found.append((*part[:-1], part[-1] + a))
            if not found:
                continue
            anchor, h1, h2, starts, size, at, twice, whose = (np.concatenate(x) for x in zip(*found, strict=True))
            if not counted or not len(anchor):
                if not counted:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (h1, h2, at.astype(np.int32))), batch.column(0).take(pa.array(whose))], ["h1", "h2", "at", "d"])
                continue
            order = np.lexsort((h2, h1, anchor))
            other = np.ones(len(order), bool)
            other[1:] = np.diff(anchor[order]) != 0
            new = other.copy()
            new[1:] |= (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)
            begin = np.flatnonzero(new)
            n = np.minimum(np.diff(np.concatenate([begin, [len(order)]])), 2)
            twin = np.logical_or.reduceat(twice[order], begin)
            pick, leads = order[begin], other[begin]
            alone = leads.copy()
            alone[:-1] &= leads[1:]
            witness = np.flatnonzero(leads & ~alone)
            rows = np.concatenate([pick, pick[witness]])
            none = np.zeros(len(witness), bool)
            sure, n, twin = (np.concatenate(x) for x in ((~alone, none), (n, none), (twin, none)))
            columns = [sure, *(c[rows] for c in (anchor, h1, h2, starts, size, at.astype(np.int32))), n.astype(np.int32), twin]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column(0).take(pa.array(whose[rows]))], [*COUNTED, "d"])

    return texts.mapInArrow(scan, "sure boolean, anchor long, h1 long, h2 long, starts int, size int, at int, n int, twice boolean, d binary" if counted else "h1 long, h2 long, at int, d binary")


COUNTED = ["sure", "anchor", "h1", "h2", "starts", "size", "at", "n", "twice"]
FRAGMENT = ["anchor", "h1", "h2", "starts", "size", "at", "n", "d"]


def shared(texts: DataFrame, params: RepeatParams) -> DataFrame:
    """anchor, h1, h2, starts, size, n (1, or 2 for more), at, d (one place where it occurs): the fragments that occur twice, share their anchor, or hold it twice."""

    def scan(batches):
        last, pending = None, None  # the anchor of the row before, and that row if nothing has joined it yet
        for batch in batches:
            if not batch.num_rows:
                continue
            lot, sure, n, twice = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "sure", "n", "twice"))
            near = np.zeros(len(lot), bool)
            same = (lot[1:] == lot[:-1]) & ~sure[1:] & ~sure[:-1]
            near[1:] |= same
            near[:-1] |= same
            if last is not None and not sure[0] and lot[0] == last:
                near[0] = True
                if pending is not None:
                    yield pending.select(FRAGMENT)
            keep = near | sure | (n > 1) | twice
            last = None if sure[-1] else lot[-1]
            pending = batch.slice(len(lot) - 1, 1) if not keep[-1] and n[-1] else None
            yield batch.take(pa.array(np.flatnonzero(keep & (n > 0)))).select(FRAGMENT)

    # Rows that are sure are dealt by their digests, so no anchor brings more rows together than it has runs of texts.
    lot = F.when(F.col("sure"), F.col("h1")).otherwise(F.col("anchor"))
    counted = occurrences(texts, params, True).repartition(lot).sortWithinPartitions("sure", "anchor")
    rows = counted.mapInArrow(scan, "anchor long, h1 long, h2 long, starts int, size int, at int, n int, d binary")
    place = F.min(F.struct("d", "at")).alias("place")
    folded = rows.groupBy("anchor", *NODE, "starts", "size").agg(F.least(F.lit(2), F.sum("n")).cast("int").alias("n"), place)
    return folded.select("anchor", *NODE, "starts", "size", "n", "place.at", "place.d")


def dense(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def stable_order(symbols: np.ndarray) -> np.ndarray:
    """A stable sort of ranks below 2**32, 16 bits at a time."""
    order = np.argsort((symbols & 0xFFFF).astype(np.uint16), kind="stable")
    if len(symbols) and int(symbols.max()) >> 16:
        order = order[np.argsort((symbols >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def shard_transform(symbol: np.ndarray, start: np.ndarray, size: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order and transform (the symbol before each suffix) of one shard's texts, by doubling.

    start and size: of the text of each position. The texts are read as rings; each ends with a symbol of its own,
    so the order is that of the suffixes.
    """
    at = np.arange(len(symbol)) - start
    rank, have = symbol, 1
    while have < rounds:
        rank = dense(rank * (int(rank.max()) + 1) + rank[start + (at + have) % size])
        have *= 2
    suffixes = stable_order(rank)
    return suffixes, symbol[(start + (at - 1) % size)[suffixes]]


def merged_order(transforms: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The merged order of all shards' suffixes as places in the chained shards, and the common prefix of each with the one before.

    Suffixes are ordered by `rounds` symbols; common prefixes are counted in symbols, `rounds` for more.
    """
    before = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), list(map(len, transforms)))
    block, common, n = np.zeros(len(before), np.int64), np.full(len(before), rounds, np.int32), len(before)
    common[0] = 0
    place = np.arange(n)
    for done in range(rounds):
        symbols = before[place]
        order = stable_order(symbols)
        symbols, old, shard = symbols[order], block[order], shard[order]
        split = np.ones(n, bool)
        split[1:] = (symbols[1:] != symbols[:-1]) | (old[1:] != old[:-1])
        common[split & (common == rounds)] = done
        block = np.cumsum(split) - 1
        # The suffixes of a shard keep their order, so the interleave alone says which is where.
        place[np.argsort(shard, kind="stable")] = np.arange(n)
        if block[-1] + 1 == n:
            break
    return place, common


def symbols_of(data: np.ndarray, at: np.ndarray, step: int, rolling: Rolling) -> np.ndarray:
    """Ranks of the `step` bytes at each place: equal ranks for equal bytes alone."""
    _, first, rank = np.unique(mix64(rolling(data)(at, at + step)), return_index=True, return_inverse=True)
    bodies = np.lib.stride_tricks.sliding_window_view(data, step)
    for k in range(0, len(at), 1 << 16):
        some = slice(k, k + (1 << 16))
        if not np.array_equal(bodies[at[some]], bodies[at[first[rank[some]]]]):  # two strings of one hash
            return dense(np.ascontiguousarray(bodies[at]).view(f"V{step}").ravel())
    return rank.astype(np.int64)


def repeated_starts(texts: list[np.ndarray], starts: np.ndarray, params: RepeatParams, rolling: Rolling) -> list[np.ndarray]:
    """For each fragment and each of its starts: 2 if its string of `length` bytes also starts elsewhere in these, 1 if its string of `passage` does, or 0."""
    step, rounds = params.step, params.length // params.step
    data, sizes = np.concatenate(texts), np.array(list(map(len, texts)))
    begins = np.cumsum(sizes) - sizes
    owner, residue = spread(np.minimum(starts, step))
    held = (sizes[owner] - residue) // step + 1  # whole symbols and an end
    chain, nth = spread(held)
    end = nth == held[chain] - 1
    at = residue[chain] + nth * step  # in the fragment
    symbol = np.zeros(len(at), np.int64)
    symbol[~end] = symbols_of(data, (begins[owner[chain]] + at)[~end], step, rolling)
    symbol[end] = int(symbol.max(initial=0)) + 1 + np.arange(int(end.sum()))
    shards = max(1, min(params.shards, len(texts)))
    position = np.arange(len(at))
    suffixes, transforms = [], []
    for s in range(shards):
        mine = position[owner[chain] % shards == s]
        lengths = held[owner % shards == s]
        order, before = shard_transform(symbol[mine], np.repeat(np.cumsum(lengths) - lengths, lengths), np.repeat(lengths, lengths), rounds)
        suffixes.append(mine[order])
        transforms.append(before)
    place, common = merged_order(transforms, rounds)
    suffix = np.concatenate(suffixes)[place]
    # The common prefixes of starts that follow each other among the starts: what lies between is no start of its fragment.
    live = np.flatnonzero((at < starts[owner[chain]])[suffix] & ~end[suffix])
    level = np.zeros(len(data), np.int8)
    if len(live) > 1:
        between = np.minimum.reduceat(common[: live[-1] + 1], live[:-1] + 1)
        longest = np.maximum(np.concatenate([between, [0]]), np.concatenate([[0], between]))
        where = suffix[live]
        level[begins[owner[chain[where]]] + at[where]] = (longest >= params.passage // step).astype(np.int8) + (longest >= rounds)
    return [level[b : b + k] for b, k in zip(begins.tolist(), starts.tolist(), strict=True)]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def spans_of(level: np.ndarray) -> list[dict]:
    return [{"first": a, "last": b, "whole": whole} for whole in (False, True) for a, b in zip(*(x.tolist() for x in runs(level > whole)), strict=True)]


def record(rows: list[tuple], names: list[str], kinds: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def merged_groups(nodes: DataFrame, params: RepeatParams) -> DataFrame:
    """key, h1, h2, spans (starts first..last - 1 that occur elsewhere in the group); nodes: key, h1, h2, starts, text."""

    def scan(batches):
        rolling, held, key, size = Rolling(), [], None, 0

        def flush():
            levels = repeated_starts([np.frombuffer(h[-1], np.uint8) for h in held], np.array([h[3] for h in held]), params, rolling)
            out = [(*h[:3], spans_of(level)) for h, level in zip(held, levels, strict=True) if level.any()]
            return record(out, ["key", *NODE, "spans"], (pa.int64(), pa.int64(), pa.int64(), SPANS_TYPE))

        for batch in batches:
            for k, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key and size >= params.batch_bytes:
                    yield flush()
                    held, size = [], 0
                key = k
                held.append((k, *row))
                size += len(row[-1])
        if held:
            yield flush()

    ordered = nodes.select("key", *NODE, "starts", "text").repartition("key").sortWithinPartitions("key", *NODE)
    return ordered.mapInArrow(scan, f"key long, h1 long, h2 long, spans {SPANS}")


def parts(nodes: DataFrame, grain: int, params: RepeatParams) -> DataFrame:
    """The parts of fragments of groups over the bound: from_key, from_h1, from_h2, offset and key, h1, h2, starts, size, n, anchor, text.

    A part holds the strings of a fragment whose first anchor lies in one stretch of `grain` places; its key is a hash of what they have in common.
    With a grain of 1 it is one start, and text is null. No part can repeat a string of its own: its strings differ in the anchor's place.
    """
    names = ["from_key", "from_h1", "from_h2", "offset", "key", *NODE, "starts", "size", "n", "anchor", "text"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())

    def scan(batches):
        rolling = Rolling()
        for batch in batches:
            out = []
            for key, h1, h2, anchor, starts, n, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(text, np.uint8)
                of = rolling(data)
                at = np.arange(len(data) - params.gram + 1)
                where = np.flatnonzero(mix64(of(at, at + params.gram)).astype(np.int64) == anchor)
                first = where[np.searchsorted(where, np.arange(starts))]
                stretch = (first - np.arange(starts)) // grain
                begin = np.flatnonzero(np.concatenate([[True], (np.diff(first) != 0) | (np.diff(stretch) != 0)]))
                count = np.diff(np.concatenate([begin, [starts]]))
                middle, s = first[begin], stretch[begin]
                core, to = middle - s * grain, middle - (s + 1) * grain + 1 + params.passage
                keys = digests(text, core, to, s)[:, 0] ^ anchor
                end = np.minimum(begin + count - 1 + params.length, len(data))
                own = digests(text, begin, end, count)
                for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
                    out.append((key, h1, h2, a, int(keys[k]), int(own[k, 0]), int(own[k, 1]), int(count[k]), b - a, n, anchor, text[a:b] if grain > 1 else None))
            yield record(out, names, kinds)

    return nodes.select("key", *NODE, "anchor", "starts", "n", "text").mapInArrow(
        scan, "from_key long, from_h1 long, from_h2 long, offset int, key long, h1 long, h2 long, starts int, size int, n int, anchor long, text binary"
    )


def whole_spans(starts: Column, size: Column, params: RepeatParams) -> Column:
    """The spans of a fragment that occurs twice: all of its starts, those of them with `length` bytes to go also as such."""
    span = lambda last, whole: F.struct(F.lit(0).alias("first"), last.cast("int").alias("last"), F.lit(whole).alias("whole"))
    long_ = F.least(starts, size - params.length + 1)
    return F.when(long_ > 0, F.array(span(starts, False), span(long_, True))).otherwise(F.array(span(starts, False)))


def by_size(nodes: DataFrame, params: RepeatParams) -> tuple[DataFrame, DataFrame | None]:
    """nodes (key, h1, ...) of groups within the bound, and of those over it (None if there are none)."""
    # Groups over the bound are few: their keys go to each of a number of lanes, so that a group's rows need not meet for this.
    lanes = 32
    sizes = nodes.groupBy("key").agg(F.count("*").alias("group")).where(F.col("group") > params.group)
    large = cut_lineage(sizes.select("key", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")))
    if large.isEmpty():
        return nodes, None
    laned = nodes.withColumn("lane", F.pmod("h1", F.lit(lanes)).cast("int"))
    return tuple(laned.join(large, ["key", "lane"], how).drop("lane") for how in ("left_anti", "left_semi"))


def split_groups(nodes: DataFrame, grains: tuple[int, ...], params: RepeatParams) -> DataFrame:
    """key, h1, h2, spans of the repeated strings of fragments of groups over the bound; nodes: key, h1, h2, anchor, starts, n, text, a row for each fragment."""
    split = written(parts(nodes, grains[0], params))
    below = split.groupBy("key", *NODE, "starts", "size").agg(F.min("anchor").alias("anchor"), F.least(F.lit(2), F.sum("n")).cast("int").alias("n"), F.min("text").alias("text"))
    below = written(below)
    names = ["key", *NODE, "spans"]
    found = below.where("n > 1").withColumn("spans", whole_spans(F.col("starts"), F.col("size"), params)).select(names)
    # A part that nothing shares its content with repeats nothing.
    company = below.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    open_ = below.join(company, "key", "left_semi")
    if grains[0] == 1:  # single starts, whose keys are their strings of `passage` bytes
        found = found.unionByName(open_.where("n = 1").withColumn("spans", whole_spans(F.col("starts"), F.lit(0), params)).select(names))
    else:
        small, large = by_size(open_, params)
        found = found.unionByName(merged_groups(small, params))
        found = found if large is None else found.unionByName(split_groups(large, grains[1:], params))
    moved = split.select("from_key", "from_h1", "from_h2", "offset", "key", *NODE).join(found, ["key", *NODE])
    shift = F.transform("spans", lambda s: F.struct((s["first"] + F.col("offset")).alias("first"), (s["last"] + F.col("offset")).alias("last"), s["whole"].alias("whole")))
    return moved.select(F.col("from_key").alias("key"), F.col("from_h1").alias("h1"), F.col("from_h2").alias("h2"), shift.alias("spans"))


def keyed(docs: DataFrame) -> DataFrame:
    """d (a digest of the text) and text of each row."""
    return docs.select(text_digest().alias("d"), text_or_empty().alias("text"))


def text_digest() -> Column:
    return F.unhex(F.substring(F.sha2(text_or_empty(), 256), 1, 32))


def cut_out(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, h1, h2, anchor, starts, n, text: the fragments wanted (with their place d, at and size), out of the texts (d, text)."""
    listed_ = wanted.groupBy("d").agg(F.collect_list(F.struct("anchor", *NODE, "starts", "size", "at", "n")).alias("f"))

    def scan(batches):
        for batch in batches:
            data, bounds = utf8_buffers(batch.column(0))
            body = memoryview(data)
            out = []
            for k, listed in enumerate(batch.column(1).to_pylist()):
                for f in listed:
                    a = int(bounds[k]) + f["at"]
                    out.append((f["anchor"], f["h1"], f["h2"], f["anchor"], f["starts"], f["n"], bytes(body[a : a + f["size"]])))
            yield record(out, ["key", *NODE, "anchor", "starts", "n", "text"], (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))

    return texts.join(listed_, "d").select("text", "f").mapInArrow(scan, "key long, h1 long, h2 long, anchor long, starts int, n int, text binary")


def repeats(docs: DataFrame, params: RepeatParams | None = None) -> DataFrame:
    """d, spans: for each different text with a repeated string, the starts (bytes, first..last - 1) of its repeated strings.

    A span is of strings of `passage` bytes, or of `length` bytes if whole. There is a row for each fragment of the text that has one. Repeated rows count as repeats of each
    other; a null text is empty.
    """
    params = params or RepeatParams()
    long_ = keyed(docs).where(F.octet_length("text") >= params.passage)
    fragment = written(shared(long_, params))
    # The bytes of the fragments, from the one text that each names; equal texts are one here. Where all fragments of an anchor occur twice there is nothing to compare.
    open_ = fragment.groupBy("anchor").agg(F.min("n").alias("least")).where("least = 1").select("anchor")
    nodes = written(cut_out(long_.dropDuplicates(["d"]), fragment.join(open_, "anchor")))
    small, large = by_size(nodes, params)
    compared = merged_groups(small, params)
    if large is not None:
        compared = compared.unionByName(split_groups(large, (params.grain, 1), params))
    compared = compared.select(*NODE, "spans")
    whole = fragment.where("n > 1").withColumn("spans", whole_spans(F.col("starts"), F.col("size"), params)).select(*NODE, "spans")
    # One row for each fragment: its spans are bounded by its starts.
    found = written(compared.unionByName(whole).groupBy(*NODE).agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans")))
    places = occurrences(long_, params, False).join(found, NODE).select("d", "at", "spans").dropDuplicates(["d", "at"])
    shift = F.transform("spans", lambda s: F.struct((s["first"] + F.col("at")).alias("first"), (s["last"] + F.col("at")).alias("last"), s["whole"].alias("whole")))
    return places.select("d", shift.alias("spans"))


def deduplicated(docs: DataFrame, params: RepeatParams | None = None, text: bool = True, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_passage and, as asked for, kept (the text's remaining bytes) and kept_sha256, of each row of docs.

    Every byte of a string of `length` bytes that also starts anywhere else (in any row, this one included) is removed; strings are judged
    on the input. n_passage counts the bytes of strings of `passage` bytes that do so, removed or not. Matches do not cross texts.
    Null text is empty; texts under `length` bytes keep all. Repeated rows and null doc_ids give their rows; other columns are ignored.
    """
    params = params or RepeatParams()
    marked = repeats(docs, params).groupBy("d").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    texts = keyed(docs).where(F.octet_length("text") >= params.passage).dropDuplicates(["d"])

    def scan(batches):
        for batch in batches:
            data, bounds = utf8_buffers(batch.column(1))
            out = []
            for k, spans in enumerate(batch.column(2).to_pylist()):
                own = data[bounds[k] : bounds[k + 1]]
                gone, told = np.zeros(len(own), bool), np.zeros(len(own), bool)
                for s in spans:
                    if s["whole"]:
                        gone[s["first"] : s["last"] - 1 + params.length] = True
                    else:
                        told[s["first"] : s["last"] - 1 + params.passage] = True
                kept = own[~gone].tobytes()
                out.append((int(gone.sum()), len(runs(gone)[0]), int(told.sum()), kept if text else None, hashlib.sha256(kept).hexdigest() if digest else None))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["d", "n_removed", "n_spans", "n_passage", "kept", "kept_sha256"])

    changed = texts.join(marked, "d").select("d", "text", "spans").mapInArrow(scan, "d binary, n_removed long, n_spans long, n_passage long, kept binary, kept_sha256 string")
    whole = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_digest().alias("d"),
        F.octet_length(whole).cast("long").alias("n_bytes"),
        *[F.encode(whole, "UTF-8").alias("own_kept")] * text,
        *[F.sha2(whole, 256).alias("own_sha256")] * digest,
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(changed, "d", "left").select(
        "doc_id",
        "n_bytes",
        *map(zero, ("n_removed", "n_spans", "n_passage")),
        *[F.coalesce("kept", "own_kept").alias("kept")] * text,
        *[F.coalesce("kept_sha256", "own_sha256").alias("kept_sha256")] * digest,
    )
