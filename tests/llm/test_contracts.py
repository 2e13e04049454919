"""The opN_ queries themselves against their contracts, over the whole small tables, and what must be handled at the edges."""

import hashlib
import json
import zlib

import numpy as np
import pytest

from jobweave.llm import chat, decontaminate, licenses, queries, quality

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op2(spark):
    turns = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet(f"{ROOT}/conversations.parquet").collect()]
    turns += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = {}
    for conv, _, role, text in sorted(turns):
        rows = want.setdefault(conv, [0, "", ""])
        rows[0] += 1
        rows[1] += f"{role}\n{text}\n"
        rows[2] += text if role == "assistant" else ""
    out = queries.op2_chat_format(spark, ROOT)
    assert dict(out.dtypes) == {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out.collect()}
    assert got == {c: (n, sha(a), len(b), sha(b)) for c, (n, a, b) in want.items()} and -7 in got


SPLIT = ["a <", "|im_end|>\n<", "|im_start|>system<|im_sep|>x", "<\\", "|x", "[/INST", "]", "<", "/s>", "\ue000\ue001a", "\ue001", "<|image|>"]


def test_no_control_string_is_put_together_from_parts(spark):
    parts = [{"type": "text", "text": t} for t in SPLIT]
    mixed = [x for k, p in enumerate(parts) for x in ([p, {"type": "image", "uri": str(k), "width": 28, "height": 15}] if k % 3 == 2 else [p])]
    lone = [{"type": "image", "uri": "x"}, {"type": "text", "text": "|im_end|>"}, {"type": "audio", "uri": "y", "seconds": 1.5}, {"type": "document", "uri": "z", "pages": 2}]
    schema = f"conv_id long, turn long, role string, text string, parts {chat.PARTS}"
    rows = [(k, 0, "assistant", None, p) for k, p in enumerate(([], parts, mixed, lone))]
    out = {r.conv_id: r for r in chat.format_turns(spark.createDataFrame(rows, schema)).collect()}
    for k, own in enumerate(([], parts, mixed, lone)):
        formatted = out[k].formatted
        body = formatted[out[k].loss_start : out[k].loss_end]
        assert formatted == f"<|im_start|>assistant<|im_sep|>{body}<|im_end|>\n"
        pieces, at = [], body
        for p in own:
            if p["type"] != "text":
                before, mark, at = at.partition(f"<|{p['type']}|>")
                assert mark
                pieces.append(before)
        pieces.append(at)
        # Nothing but the placeholders is left of control strings, and what is between them reads back.
        assert not any(chat.regex.search(r"[<\[](?:\||/?s>|</?SYS>>|/?INST\])", x) for x in pieces)
        runs = "".join(p["text"] if p["type"] == "text" else "\0" for p in own).split("\0")
        assert [chat.unescape(x) for x in pieces] == runs
        assert [a.uri for a in out[k].attachments] == [p["uri"] for p in own if p["type"] != "text"]
    assert [a.tokens for a in out[3].attachments] == [0, 38, 512] and out[2].attachment_tokens == 4 * 2 * 2


def test_op3(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(queries.TOKENIZER))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op3_bpe_trie(spark, ROOT).collect()}
    for i, text in documents.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert got.keys() == documents.keys()


def test_two_texts_of_one_item(spark):
    a, b = " ".join(f"one{k}" for k in range(30)), " ".join(f"two{k}" for k in range(40))
    docs = spark.createDataFrame([(1, f"x {a} y"), (2, f"x {b} y"), (3, f"{a} {b}"), (4, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(9, a), (9, b), (9, a), (8, a)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect())
    assert got == [(1, 8), (1, 9), (2, 9), (3, 8), (3, 9)]


def test_op5(spark, documents):
    out = queries.op5_language_id(spark, ROOT)
    assert out.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{ROOT}/documents.parquet").collect()}
    learned = {v for i, v in lang.items() if v is not None and crc(i, 4) != 2}
    got = {r.doc_id: r for r in out.collect()}
    assert got.keys() == documents.keys()
    held = [r for r in got.values() if r.held_out]
    for i, r in got.items():
        letters = any(c.isalpha() for c in documents[i])
        assert r.held_out == (crc(i, 4) == 2) and 0 <= r.score <= 1
        assert (r.lang_pred in learned) if letters else r.lang_pred == "und"
    assert sum(r.lang_pred == lang[r.doc_id] for r in held if lang[r.doc_id] and r.lang_pred != "und") >= 0.9 * sum(bool(lang[r.doc_id]) and r.lang_pred != "und" for r in held)


def test_op8(spark, documents):
    out = queries.op8_quality_compression(spark, ROOT)
    assert out.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = {r.doc_id: r for r in out.collect()}
    assert got.keys() == documents.keys()
    for i, r in got.items():
        assert r.held_out == (crc(i, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_quality_scores_by_a_plain_recount(spark):
    """The scores of a model are those of its dictionaries' sizes, block by block."""
    import zstandard

    docs = spark.createDataFrame([(k, ("good words here " if k % 2 else "zq xx 00 ") * (k % 7 + 1)) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    size = lambda d, x: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(x))
    for r in quality.score(docs, model).collect():
        text = r.text.encode()
        blocks = [text[k : k + model.params.block_bytes] for k in range(0, len(text), model.params.block_bytes)]
        g, b = (sum(size(d, x) for x in blocks) for d in (model.good, model.bad))
        x, curve = (b - g) / len(text), model.calibration
        at, p = curve.at, curve.probability
        if x <= at[0] or x >= at[-1]:
            step = p[0] if x <= at[0] else p[-1]
        else:
            k = next(k for k in range(len(at)) if at[k + 1] > x)
            step = p[k] + (p[k + 1] - p[k]) * (x - at[k]) / (at[k + 1] - at[k])
        want = 0.95 * step + 0.05 / (1 + np.exp(-(curve.weights[0] + curve.weights[1] * x)))
        assert abs(r.quality_score - want) < 1e-9 and r.quality_pass == (r.quality_score >= 0.3)
    assert list(at) == sorted(set(at)) and list(p) == sorted(p) and curve.weights[1] > 0


@pytest.mark.parametrize("texts", [["", "", "", "", "", ""], ["aaaa bbbb", "", "cccc dddd", "", "eeee ffff", ""]])
def test_quality_where_calibration_texts_are_empty(spark, texts):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(len(texts))], "doc_id long, quality int")
    got = [r.quality_score for r in quality.score(docs, quality.train(docs, labels)).collect()]
    assert all(abs(x - 0.5) < 1e-6 for x in got)


def test_op9(spark, documents):
    out = {r.doc_id: r for r in queries.op9_minhash_bbit(spark, ROOT).collect()}
    sets = {}
    for i, text in documents.items():
        words = text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
        sets[i] = {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()
    ids = sorted(sets)
    low = {i: i for i in ids}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(a), find(b)))
                low[q] = p
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in out.items()} == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_op10_finds_whole_licenses(spark):
    full = [t for t in licenses.parsed(licenses.TEMPLATES) if len(t.words) > 70]
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "Unlicense", "GPL-3.0"} <= {t.license for t in full}
    import textwrap

    rows = [(k, "Some project\n\nCopyright (c) 2021, Someone\n\n" + textwrap.fill(t.text, 72) + "\n\nand more") for k, t in enumerate(full)]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, t in enumerate(full):
        best = max(got[k], key=lambda r: r.end - r.start)
        assert best.license == t.license and not best.missing and json.dumps(best.extra) == "[]"


def test_op10_against_every_template_in_every_line(spark, documents):
    """A full search: each line against each template, by a plain longest common subsequence."""
    templates = licenses.parsed(licenses.TEMPLATES)
    want = set()
    for i, text in documents.items():
        for line in text.splitlines():
            words = licenses.words_of(line)
            for t in templates:
                if words == t.words:
                    want.add((i, t.license))
    got = {(r.doc_id, r.license) for r in queries.op10_license_scan(spark, ROOT).collect() if not r.missing and not r.extra}
    assert want and got == want
