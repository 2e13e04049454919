import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from jobweave.llm.bpe import ByteBPE, encode, read_tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
OURS, THEIRS = ByteBPE(read_tokenizer(PATH)), Tokenizer.from_file(PATH)


def ids(text):
    import numpy as np

    return np.frombuffer(OURS.encode_batch([text])[0], "<u4").tolist()


def same(text):
    want = THEIRS.encode(text, add_special_tokens=False).ids
    assert ids(text) == want, text
    assert OURS.decode(OURS.encode_batch([text])[0]) == THEIRS.decode(want, skip_special_tokens=False)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    same(text)


@given(st.text(alphabet="aeinorst '!.,\n\t0129éßñ", max_size=80))
@settings(max_examples=300, deadline=None)
def test_texts_with_many_merges(text):
    same(text)


def test_every_character_class():
    import unicodedata

    for c in range(0x3000):
        if unicodedata.category(chr(c)) not in ("Cs", "Cn"):
            same(f"a{chr(c)} {chr(c)}{chr(c)}b 1{chr(c)}")


def test_specials_and_random_bytes():
    rng = random.Random(5)
    for text in ("", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "   x   ", "it's we'll \n\n y", "aaaaaaaaaaaaaaaa", "\x1c\x1f\x85 x"):
        same(text)
    for _ in range(300):
        same("".join(rng.choice(["the", " of", "ing", "an", "é", "\n", "!!", "##", "x", "Th", "heit", "zu"]) for _ in range(rng.randrange(30))))


def test_frame(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(-1, None, 1), (-2, "", 2), (-3, "the " * 50_000, 3), (None, "x", 4), (-3, "dup", 5)], "doc_id long, text string, ids int")
    rows = docs.select("doc_id", "text").unionByName(extra.select("doc_id", "text")).collect()
    out = encode(docs.unionByName(extra, allowMissingColumns=True), PATH, digests=True, decoded=True).collect()
    want = []
    for r in rows:
        e = THEIRS.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(e), e, r.text or "", hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in e)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    key = lambda r: (str(r[0]), r[4])
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    assert encode(docs.limit(0), PATH).count() == 0
