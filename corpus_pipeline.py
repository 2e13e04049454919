"""The corpus pipeline: documents from raw rows to token ids, a stage for each step.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows that the one before it kept. Stages drop rows or
rewrite text and return the columns of documents; the last returns each document's token ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm import bpe, decontaminate, minhash, pii, quality
from jobweave.llm.queries import TOKENIZER, surrogate_params, table
from jobweave.operators.lineage import removed, shared_folder


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier passes; it learns from all labelled rows of this stage's input."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("quality_pass").select(*docs.columns)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8), the one with the smallest doc_id."""
    dropped = minhash.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_dropped"))
    return docs.join(dropped, docs["doc_id"] == dropped["_dropped"], "left_anti").select(*docs.columns)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars follows the new text."""
    out = pii.pseudonymised(docs, surrogate_params(spark)).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, and digests of the ids and of the text that they decode to."""
    return bpe.encode(docs, TOKENIZER, ids=True, digests=True)


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicate_filter), ("decontamination", benchmark_filter), ("pii", pii_surrogates), ("bpe", tokens)]

#: Compression, minima and alignments have no SQL form; tests compare run() with the stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written as Parquet to the shared folder and read again. A stage's folder goes once the next is written."""
    folder = shared_folder(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/pipeline-{uuid.uuid4().hex}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                removed(spark, before)
            before = path
    return docs
