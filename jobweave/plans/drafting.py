"""The draft plan: prompt, writer, cleaning, status, and a tailored score of what was written."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobweave.functions.text import banned_in, exfil_in, rendered, untrusted
from jobweave.operators.lineage import cut_lineage, dealt
from jobweave.operators.state import drafted
from jobweave.sources.sinks import storable

Writer = Callable[[str, str], str]  # (kind, prompt) -> markdown
KINDS = ["resume", "cover_letter"]


@dataclass(frozen=True)
class Drafted:
    drafts: DataFrame  # job_id, kind, markdown as they may be stored
    applications: DataFrame  # job_id, status
    failed: DataFrame  # job_id, kind, error


def prompts(jobs: DataFrame, template: str, nonce: str) -> DataFrame:
    """job_id, kind, prompt of jobs (id, title, company_name, description); what others wrote is fenced by the nonce and cleaned of it."""
    others = ("title", "company_name", "description")
    values = {"nonce": F.lit(nonce)} | {c: F.col(c) for c in ("kind", *others)}
    # Cleaned once for a job, not for each of its kinds.
    fenced = jobs.select("id", *[untrusted(F.col(c), nonce).alias(c) for c in others])
    return fenced.withColumn("kind", F.explode(F.array(*map(F.lit, KINDS)))).select(F.col("id").alias("job_id"), "kind", rendered(template, values).alias("prompt"))


def written(asked: DataFrame, writer: Writer, attempts: int = 2) -> DataFrame:
    """job_id, kind, markdown, error: each prompt is one call, tried again if it fails or comes back empty; a failure stops nobody else."""

    def one(kind: str, prompt: str) -> tuple[str | None, str | None]:
        error = "empty answer"
        for _ in range(attempts):
            try:
                text = writer(kind, prompt)
            except Exception as e:  # noqa: BLE001  a writer may fail in any way
                error = str(e)[:400]
                continue
            if text and text.strip():
                return text, None
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(k, p) for k, p in zip(b["kind"], b["prompt"], strict=True)]
            yield pd.DataFrame({"job_id": b["job_id"], "kind": b["kind"], "markdown": [g[0] for g in got], "error": [g[1] for g in got]})

    return asked.mapInPandas(run, f"job_id {dict(asked.dtypes)['job_id']}, kind string, markdown string, error string")


def generated(jobs: DataFrame, applications: DataFrame, template: str, writer: Writer, nonce: str) -> Drafted:
    """Drafts of both kinds for jobs, cleaned; a job with both gets an application in the status drafted, unless it is further on (applications: job_id, status)."""
    # Cleaned before they are stored: each of the checks behind would clean every text anew.
    answers = cut_lineage(written(prompts(dealt(jobs, "id"), template, nonce), writer).withColumn("markdown", storable(F.col("markdown"))))
    clean = answers.where("markdown is not null").select("job_id", "kind", "markdown")
    clean = clean.where((F.size(banned_in(F.col("markdown"))) == 0) & (F.size(exfil_in(F.col("markdown"))) == 0))
    whole = clean.groupBy("job_id").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in KINDS]).where(" AND ".join(KINDS)).select(F.col("job_id").alias("_job"))
    joined = applications.join(whole, applications["job_id"] == whole["_job"], "full")
    status = F.when(F.col("_job").isNotNull(), drafted(F.col("status"))).otherwise(F.col("status"))
    return Drafted(clean, joined.select(F.coalesce("job_id", "_job").alias("job_id"), status.alias("status")), answers.where("error is not null").select("job_id", "kind", "error"))
