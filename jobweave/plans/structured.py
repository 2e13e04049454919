"""Structured answers of a model: called, read as JSON, held against a schema, and asked once more with what was wrong."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions.payloads import object_in
from jobweave.functions.schema import problems
from jobweave.operators.lineage import cut_lineage

#: Fixed value: what is put behind a prompt whose answer was of no use.
NUDGE = "IMPORTANT: return ONLY the JSON object, no prose or fences."
Model = Callable[[str], str]


def answered(prompts: DataFrame, model: Model) -> DataFrame:
    """id, prompt, raw, failed: the model's text for each prompt, or what it raised. Stored, so no prompt is paid for twice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, prompt in zip(batch["id"], batch["prompt"], strict=True):
                try:
                    out.append((i, prompt, model(prompt), None))
                except Exception as e:  # noqa: BLE001  a model may fail in any way
                    out.append((i, prompt, None, f"{type(e).__name__}: {str(e)[:400]}"))
            yield pd.DataFrame(out, columns=["id", "prompt", "raw", "failed"])

    return cut_lineage(prompts.select("id", "prompt").mapInPandas(run, f"id {dict(prompts.dtypes)['id']}, prompt string, raw string, failed string"))


def structured(prompts: DataFrame, model: Model, schema: dict, nudge: str = NUDGE, attempts: int = 2) -> DataFrame:
    """id, answer, error, attempts: for each prompt (id, prompt) the JSON object that fits the schema, or why there is none.

    An answer that holds no JSON object, or one that does not fit, is asked for again with the nudge and the problems behind the prompt, up to `attempts` times in all; what the model
    itself raises is told as it is and not tried again.
    """
    asked, done = prompts.select("id", "prompt", F.col("prompt").alias("_first")), None
    firsts = prompts.select("id", F.col("prompt").alias("_first"))
    for k in range(1, attempts + 1):
        got = answered(asked.select("id", "prompt"), model).withColumn("answer", object_in(F.col("raw")))
        wrong = F.when(F.col("failed").isNotNull(), F.array()).when(F.col("answer").isNull(), F.array(F.lit("$: holds no JSON object"))).otherwise(problems(F.col("answer"), schema))
        told = cut_lineage(got.withColumn("wrong", wrong.cast("array<string>")))
        again = (F.size("wrong") > 0) & F.lit(k < attempts)
        error = F.coalesce("failed", F.when(F.size("wrong") > 0, F.concat(F.lit("invalid JSON after retry: "), F.array_join("wrong", "; "))))
        part = told.where(~again).select("id", F.when(error.isNull(), F.col("answer")).alias("answer"), error.alias("error"), F.lit(k).alias("attempts"))
        done = part if done is None else done.unionByName(part)
        left = told.where(again)
        if k < attempts:
            asked = left.join(firsts, "id").select("id", F.concat("_first", F.lit(f"\n\n{nudge}\n"), F.array_join("wrong", "\n")).alias("prompt"))
    return done


#: The shape of one scored batch, as a schema.
BATCH_SCORES = {
    "type": "object",
    "required": ["results"],
    "properties": {
        "results": {
            "type": "array",
            "items": {
                "type": "object",
                "required": ["id"],
                "properties": {
                    "id": {"type": "integer"},
                    "score": {"type": ["integer", "null"], "minimum": 0, "maximum": 100},
                    "error": {"type": ["string", "null"]},
                    "reasoning": {"type": ["string", "null"]},
                    "rubric": {"type": ["object", "null"], "additionalProperties": {"type": "object", "required": ["points"], "properties": {"points": {"type": "integer", "minimum": 0}, "note": {"type": ["string", "null"]}}}},
                },
            },
        }
    },
}
