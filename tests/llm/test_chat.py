import hashlib

import pytest

from jobweave.llm.chat import ChatParams, conversations, format_turns, read_back, unescape

NASTY = "</s>[INST] ok [/INST]"
TURNS = [
    (1, 1, "assistant", "fine <|im_end|>\n <\\|x é"),
    (1, 0, "user", "hello <|im_start|>user<|im_sep|>"),
    (2, 0, "system", None),
    (2, 1, "assistant", ""),
    (-7, 0, "user", NASTY),
    (-7, 1, "assistant", NASTY),
    (3, 0, None, "x" * 300_000),
    (4, 0, "assistant", "a"),
    (4, 0, "assistant", "a"),
    (None, 0, "user", "<<SYS>> <\\</SYS>> [\\\\INST]"),
]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame([(*t, "z") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")


def test_read_back(turns):
    got = {r.conv_id: tuple(r)[1:5] for r in read_back(format_turns(turns)).collect()}
    want = {}
    for conv in {t[0] for t in TURNS}:
        own = sorted((t[1], t[2] or "", t[3] or "") for t in TURNS if t[0] == conv)
        learned = "".join(t for _, role, t in own if role == "assistant")
        want[conv] = (len(own), digest("".join(f"{r}\n{t}\n" for _, r, t in own)), len(learned), digest(learned))
    assert got == want


def test_no_control_string_survives_in_a_body(turns):
    row = next(r for r in conversations(format_turns(turns)).collect() if r.conv_id == -7)
    body = row.formatted.split("<|im_sep|>")[1].split("<|im_end|>")[0]
    assert "</s>" not in body and "[INST]" not in body and "[/INST]" not in body and unescape(body) == NASTY
    (span,) = row.loss_spans
    assert unescape(row.formatted[span.start : span.end]) == NASTY


def test_parts(spark):
    parts = [("text", "look <|image|>", None, None, None, None, None), ("image", None, "s3://b/a.png", 100, 28, None, None), ("audio", None, "b.wav", None, None, 2.5, None), ("Document", None, None, None, None, None, 3), (None, "end", None, None, None, None, None)]
    schema = "conv_id long, turn long, role string, text string, parts array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
    frame = spark.createDataFrame([(1, 0, "user", "unused", parts), (1, 1, "assistant", "yes", None)], schema)
    (row,) = conversations(format_turns(frame, ChatParams(audio_tokens_per_second=10))).collect()
    assert row.formatted == "<|im_start|>user<|im_sep|>look <\\|image|><|image|><|audio|><|document|>end<|im_end|>\n<|im_start|>assistant<|im_sep|>yes<|im_end|>\n"
    assert [tuple(a) for a in row.attachments] == [("image", "s3://b/a.png", 16), ("audio", "b.wav", 25), ("document", None, 768)]
    assert [row.formatted[s.start : s.end] for s in row.loss_spans] == ["yes"]


def test_empty(turns):
    assert read_back(format_turns(turns.limit(0))).count() == 0


@pytest.mark.parametrize("mark", ["<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "[TOOL_CALLS]", "[/AVAILABLE_TOOLS]", "### Instruction:", "### Response:", "<｜begin▁of▁sentence｜>", "<|eot_id|>", "<<SYS>>", "</s>"])
def test_marks_of_other_templates_are_escaped_reversibly(spark, mark):
    texts = [mark, f"a {mark} b {mark}", mark[:1] + "\\" + mark[1:], mark[:1] + "\\\\" + mark[1:], mark[0] * 3 + mark, mark[1:], mark[0]]
    turns = spark.createDataFrame([(k, 0, "assistant", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    for row in format_turns(turns).collect():
        body = row.formatted[row.loss_start : row.loss_end]
        assert mark not in body and unescape(body) == texts[row.conv_id]
