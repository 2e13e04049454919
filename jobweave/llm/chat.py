"""Chat formatting with typed content parts.

A visitor turns each part (text, image, audio, document) into its piece of the turn: text, whose control strings are escaped in each run of
parts between attachments, or one placeholder for each attachment, whose reference and expanded token count are recorded in order. A turn is
`<|im_start|>role<|im_sep|>body<|im_end|>` and a line feed. Turns are formatted row by row in built-in functions; a conversation
is its turns' pieces in order, so even one that holds a large share of all rows is formatted and read back as a stream.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
#: Control strings of this template and of others in use, by their first sign. Whatever begins with <| or <｜ is one too.
ANGLE = "s /s bos eos pad unk start_of_turn end_of_turn start_of_image end_of_image start_of_audio end_of_audio"
SQUARE = "INST /INST TOOL_CALLS /TOOL_CALLS TOOL_RESULTS /TOOL_RESULTS AVAILABLE_TOOLS /AVAILABLE_TOOLS SYSTEM_PROMPT /SYSTEM_PROMPT MODEL_SETTINGS /MODEL_SETTINGS IMG IMG_BREAK IMG_END TOOL_CONTENT ARGS"
HEADINGS = "System User Human Assistant Instruction Input Response"
#: What follows <, [ or # in one of them.
REST = rf"\\*(?:[|｜]|(?:{ANGLE.replace(' ', '|')})>|</?SYS>>|(?:{SQUARE.replace(' ', '|')})\]|## (?:{HEADINGS.replace(' ', '|')}):)"
ESCAPABLE, ESCAPED = rf"([<\[#])(?={REST})", rf"([<\[#])\\(?={REST})"
_ESCAPED = regex.compile(ESCAPED)


@dataclass(frozen=True)
class ChatParams:
    patch: int = 14  # pixels a side of an image patch; each patch is one token
    audio_tokens_per_second: float = 25.0
    document_tokens_per_page: int = 256
    loss_role: str = "assistant"


PARTS = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    """A backslash after the first character of each control string (and one more where there are some): reversible."""
    return F.regexp_replace(text, ESCAPABLE, r"$1\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


#: An attachment's place while text is joined; texts that hold these two characters are quoted meanwhile.
HERE, QUOTE = "\ue000", "\ue001"


def visit(part: Column, params: ChatParams) -> Column:
    """struct(text, attachment): attachment is null for text; unknown types count as text, missing sizes as 0 tokens."""
    kind = F.lower(F.coalesce(part["type"], F.lit("text")))
    side = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / params.patch)
    tokens = (
        F.when(kind == "image", side(part["width"]) * side(part["height"]))
        .when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * params.audio_tokens_per_second))
        .when(kind == "document", F.coalesce(part["pages"], F.lit(0)).cast("long") * params.document_tokens_per_page)
    )
    attached = kind.isin("image", "audio", "document")
    quoted = F.replace(F.replace(F.coalesce(part["text"], F.lit("")), F.lit(QUOTE), F.lit(QUOTE + "b")), F.lit(HERE), F.lit(QUOTE + "a"))
    return F.struct(
        F.when(attached, F.lit(HERE)).otherwise(quoted).alias("text"),
        F.when(attached, F.struct(kind.alias("type"), part["uri"].alias("uri"), tokens.cast("long").alias("tokens"))).alias("attachment"),
    )


def body_of(seen: Column, attachments: Column) -> Column:
    """All text between two attachments is escaped as one, so no control string can be put together from several parts."""
    unquoted = lambda t: F.replace(F.replace(t, F.lit(QUOTE + "a"), F.lit(HERE)), F.lit(QUOTE + "b"), F.lit(QUOTE))
    runs = F.transform(F.split(F.array_join(F.transform(seen, lambda s: s["text"]), ""), HERE), lambda t: escape(unquoted(t)))
    placeholders = F.transform(attachments, lambda a: F.concat(F.lit("<|"), a["type"], F.lit("|>")))
    return F.array_join(F.zip_with(runs, placeholders, lambda t, a: F.concat(t, F.coalesce(a, F.lit("")))), "")


def format_turns(turns: DataFrame, params: ChatParams | None = None) -> DataFrame:
    """conv_id, turn, role, formatted, loss_start, loss_end, attachments (type, uri, tokens; in order) and attachment_tokens of each row.

    A turn's content is its `parts` (see PARTS) if the column is there and not null, else its `text`; null is empty. A null role is
    an empty one. loss_start and loss_end bound the body within `formatted` (code points) where the role is the loss role, else both are null.
    Repeated rows and turns stay; other columns are dropped.
    """
    params = params or ChatParams()
    text_part = F.from_json(F.lit("{}"), "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>")
    parts = F.array(text_part.withField("text", F.coalesce(F.col("text").cast("string"), F.lit(""))) if "text" in turns.columns else text_part)
    if "parts" in turns.columns:
        parts = F.coalesce(F.col("parts").cast(PARTS), parts)
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    seen = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.transform(parts, lambda p: visit(p, params)).alias("_seen"))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEPARATOR))
    attachments = F.filter(F.transform("_seen", lambda s: s["attachment"]), lambda a: a.isNotNull())
    body = body_of(F.col("_seen"), attachments)
    loss = F.col("role") == params.loss_role
    return seen.select(
        "conv_id",
        "turn",
        "role",
        F.concat(head, body, F.lit(END)).alias("formatted"),
        F.when(loss, F.length(head)).alias("loss_start"),
        F.when(loss, F.length(head) + F.length(body)).alias("loss_end"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("attachment_tokens"),
    )


def conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted (all turns in order), loss_spans and attachments: one row for each conversation, as a training example.

    A row holds a whole conversation; where one may be too long for a row, use format_turns' rows and read_back.
    """
    turn = F.struct("turn", "role", "formatted", "loss_start", "loss_end", "attachments")
    held = formatted.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    starts = F.aggregate(F.transform("t", lambda x: F.length(x["formatted"])), F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
    spans = F.filter(
        F.transform("t", lambda x, i: F.struct((F.get(F.col("_at"), i) + x["loss_start"]).alias("start"), (F.get(F.col("_at"), i) + x["loss_end"]).alias("end"))), lambda s: s["start"].isNotNull()
    )
    return held.withColumn("_at", starts).select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["formatted"]), "").alias("formatted"), spans.alias("loss_spans"), F.flatten(F.transform("t", lambda x: x["attachments"])).alias("attachments")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted turns say, a row for each conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns come in order of turn and role (null first), and those of one turn and role in order of their formatted text. The rows of a conversation are streamed through running digests.
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def scan(batches):
        now, open_, state = None, False, None

        def close():
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            done = []
            for conv, text, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if not open_ or conv != now:
                    if open_:
                        done.append(close())
                    now, open_, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, _, body = text.removeprefix(START).removesuffix(END).partition(SEPARATOR)
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                if start is not None:
                    learned = unescape(text[start:end])
                    state[2] += len(learned)
                    state[3].update(learned.encode())
                state[4] += len(text)
            yield rows(done)
        if open_:
            yield rows([close()])

    def rows(done):
        columns = list(zip(*done, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions(*(F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "formatted")))
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(scan, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
