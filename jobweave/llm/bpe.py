"""Byte-level BPE, encoded by a walk over the trie of distinct words.

The encoding of a prefix extends the encoding of a shorter one by a single last token, so a trie node needs only
that token: the one suffix of the prefix that is a token, whose predecessor (the state of the node before it)
may stand next to it. The distinct words of a batch, sorted, are the trie in depth-first order; the stack of states
holds the current path, and a prefix that words share is encoded once. A word's tokens are read back from the
states. Two tokens may stand together unless a merge across their border comes before the merges that
use up the pieces at the border; that is settled from the pieces' ranks and remembered.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Fixed value: the split pattern of byte-level BPE files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NEVER = 1 << 60
BATCH_CHARS = 2_000_000
CACHE_WORDS, CACHE_BYTES = 400_000, 1 << 26  # of words and ids that a worker remembers between batches
ENDING = 4
SHORT = tuple(range(ENDING, 0, -1))


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(shifted)}


class ByteBPE:
    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        split = spec["pre_tokenizer"]
        if spec.get("normalizer") or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("only byte-level BPE files without normalizer and prefix space are read")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not read")
        back = byte_characters()
        raw = lambda token: bytes(back[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.merge: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            left, right, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.merge.setdefault((left, right), rank)
            parts.setdefault(made, (left, right, rank))
        self._spines(parts)
        self._reachable(parts)
        self.pattern = regex.compile(PATTERN)
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.sizes = list(map(len, self.bytes_of))
        self.joins: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _spines(self, parts: dict[int, tuple[int, int, int]]) -> None:
        """For each token, the pieces at its right and at its left border with the rank that uses each up."""
        self.right: list[list[tuple[int, int]]] = [[] for _ in self.bytes_of]
        self.left: list[list[tuple[int, int]]] = [[] for _ in self.bytes_of]
        for token in self.ids.values():
            for side, spine in ((1, self.right), (0, self.left)):
                piece, used = token, NEVER
                while True:
                    spine[token].append((piece, used))
                    if piece not in parts:
                        break
                    used = parts[piece][2]
                    piece = parts[piece][side]

    def _crosses(self, first: int, second: int, before: int = NEVER) -> bool:
        """Whether a merge across the border comes before `before` and before the pieces are used up."""
        merge = self.merge
        for a, used_a in self.right[first]:
            for b, used_b in self.left[second]:
                rank = merge.get((a, b))
                # Of equal merges the left one goes first: a is gone by its own rank, b is not.
                if rank is not None and rank < used_a and rank <= used_b and rank < before:
                    return True
        return False

    def _reachable(self, parts: dict[int, tuple[int, int, int]]) -> None:
        """Tokens that their own bytes encode to."""
        ok = {i for i in self.ids.values() if i not in parts}
        for token, (a, b, rank) in sorted(parts.items(), key=lambda x: x[1][2]):
            if a in ok and b in ok and not self._crosses(a, b, rank):
                ok.add(token)
        self.usable = {t: i for t, i in self.ids.items() if i in ok}
        # The lengths of the tokens with one ending, longest first, down to the ending's own: most substrings of a word are no tokens.
        lengths: dict[bytes, set[int]] = {}
        for t in self.usable:
            if len(t) > ENDING:
                lengths.setdefault(t[-ENDING:], set()).add(len(t))
        self.lengths = {end: (*sorted(own, reverse=True), *SHORT) for end, own in lengths.items()}

    def _encode_words(self, words: Iterable[str]) -> None:
        """Put the ids of new words into the cache, by a depth-first walk over their trie."""
        usable, joins, lengths, sizes = self.usable, self.joins, self.lengths, self.sizes
        last = [-1]  # the last token of each prefix on the path
        before = b""
        for word, text in sorted((w.encode(), w) for w in words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for depth in range(shared + 1, len(word) + 1):
                for length in lengths.get(word[depth - ENDING : depth], SHORT) if depth >= ENDING else SHORT:
                    start = depth - length
                    if start < 0:
                        continue
                    token = usable.get(word[start:depth])
                    if token is None:
                        continue
                    if start == 0:
                        break
                    pair = last[start] << 32 | token
                    fits = joins.get(pair)
                    if fits is None:
                        fits = joins[pair] = not self._crosses(last[start], token)
                    if fits:
                        break
                last.append(token)
            before = word
            tokens, depth = [], len(word)
            while depth:
                tokens.append(last[depth])
                depth -= sizes[last[depth]]
            self.cache[text] = np.array(tokens[::-1], "<u4").tobytes()
            self.held += len(text) + 4 * len(tokens)
        if len(joins) > 4 * CACHE_WORDS:
            joins.clear()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit integers."""
        findall, cache = self.pattern.findall, self.cache
        if len(cache) > CACHE_WORDS or self.held > CACHE_BYTES:
            cache.clear()
            self.held = 0
        pieces: list[list[tuple[bytes, list[str]]]] = []
        new: set[str] = set()
        for text in texts:
            runs = []
            parts = self.special_pattern.split(text) if self.special_pattern and any(s in text for s in self.special) else [text]
            for k, part in enumerate(parts):
                if k % 2:
                    runs.append((np.array([self.special[part]], "<u4").tobytes(), []))
                elif part:
                    words = findall(part)
                    runs.append((b"", words))
                    new.update(words)
            pieces.append(runs)
        self._encode_words(w for w in new if w not in cache)
        get = cache.__getitem__
        return [b"".join(own + b"".join(map(get, words)) for own, words in runs) for runs in pieces]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, ByteBPE] = {}


def loaded(spec: str) -> ByteBPE:
    """One tokenizer for each Python worker, with its cache of words."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = ByteBPE(spec)
    return _LOADED[key]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer_path: str, ids: bool = True, digests: bool = False, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and, as asked for, ids (array<int>), decoded (the text that the ids decode to), ids_sha256 and decoded_sha256.

    Null text encodes as the empty one (no tokens). Special tokens that a text spells out are their ids. Every row gives a row,
    repeated and null doc_ids too; other columns of docs are ignored. The file (a few MB, whatever the corpus) is read
    once on the driver and broadcast.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    schema = "doc_id long, n_tokens long" + ", ids array<int>" * ids + ", decoded string" * decoded + ", ids_sha256 string, decoded_sha256 string" * digests

    def rows(doc_ids: list, texts: list[str], bpe: ByteBPE) -> pa.RecordBatch:
        out = bpe.encode_batch(texts)
        columns = {"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array([len(x) // 4 for x in out], pa.int64())}
        if ids:
            bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])]).astype(np.int32)
            columns["ids"] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.frombuffer(b"".join(out), "<i4")))
        if decoded or digests:
            back = [bpe.decode(x) for x in out]
        if decoded:
            columns["decoded"] = pa.array(back, pa.string())
        if digests:
            columns["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())
            columns["decoded_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string())
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def scan(batches):
        bpe = loaded(spec.value)
        for batch in batches:
            held_ids, held, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), pc.fill_null(batch.column(1), ""), strict=True):
                text = text.as_py()
                held_ids.append(doc_id)
                held.append(text)
                size += len(text)
                if size >= BATCH_CHARS:
                    yield rows(held_ids, held, bpe)
                    held_ids, held, size = [], [], 0
            if held:
                yield rows(held_ids, held, bpe)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(scan, schema)
