"""Keys, fingerprints and small arithmetic."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from jobweave.functions.text import cross_title, normal_company

#: Fixed values of the similarity rule: least cleaned length, words in a shingle, greatest distance.
LEAST_CHARS, SHINGLE, NEAR = 200, 3, 3


def source_key(source: Column, source_id: Column) -> Column:
    return F.sha2(F.concat(source, F.lit("|"), source_id), 256)


def cross_key(company: Column, title: Column, location: Column | None = None) -> Column:
    """One key for the same role on several boards; null where company or title is too thin."""
    c, t = normal_company(company), cross_title(title, location)
    return F.when((F.length(c) >= 2) & (F.length(t) >= 4), F.sha2(F.concat(c, F.lit("|"), t), 256))


def cleaned(description: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(description, F.lit("")), "<[^>]+>", " "))


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Runs of n words of small letters and digits; none in a shorter text."""
    words = F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), F.lit(1))

    def of(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1)))
        return F.when(F.size(w) >= n, F.transform(places, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    # The words are bound to a variable, as an inner lambda would find them anew for each place.
    return F.get(F.transform(F.array(words), of), F.lit(0))


@F.pandas_udf(StringType())
def simhash(description: pd.Series) -> pd.Series:
    """64-bit SimHash of a description in 16 hex digits, over 8-byte BLAKE2b of its shingles; null where there is too little text.

    BLAKE2b is not among Spark's functions, so this one is an Arrow UDF; simhash_md5 stays in the JVM.
    """
    tag, word, places = re.compile("<[^>]+>"), re.compile("[a-z0-9]+"), np.arange(63, -1, -1, dtype=np.uint64)

    def one(text: str | None) -> str | None:
        text = tag.sub(" ", text or "").lower()
        words = word.findall(text)
        if len(text) < LEAST_CHARS or len(words) < SHINGLE:
            return None
        # Shingles are stretches of the joined words.
        joined, ends = " ".join(words).encode(), np.cumsum([len(w) + 1 for w in words]) - 1
        begins = np.concatenate([[0], ends[: -SHINGLE] + 1]).tolist()
        digests = b"".join([hashlib.blake2b(joined[a:b], digest_size=8).digest() for a, b in zip(begins, ends[SHINGLE - 1 :].tolist(), strict=True)])
        votes = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).astype(np.int64)
        ones = 2 * votes.sum(axis=0) > len(votes)
        return f"{int((ones.astype(np.uint64) << places).sum()):016x}"

    return description.map(one)


def simhash_md5(rows: DataFrame, key: str, description: Column) -> DataFrame:
    """key, print: the same vote over the first 16 hex digits of each shingle's MD5, without Python.

    A row for each shingle, and a count for each bit, which is combined before the shuffle; rows with too little text go.
    """
    text = cleaned(description)
    grams = rows.select(F.col(key), text.alias("t")).where(F.length("t") >= LEAST_CHARS).select(key, F.explode(shingles(F.col("t"))).alias("s")).select(key, F.md5("s").alias("m"))
    parts = grams.select(key, *[F.conv(F.substring("m", k, 8), 16, 10).cast("long").alias(c) for k, c in ((1, "a"), (9, "b"))])
    bit = lambda c, k: F.shiftright(c, k).bitwiseAND(F.lit(1).cast("long"))
    # Two counts in one long: a text has fewer shingles than 2**31.
    votes = parts.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(bit("a", k) + F.shiftleft(bit("b", k), 32)).alias(f"v{k}") for k in range(32)])

    def half(count) -> Column:
        total = F.lit(0).cast("long")
        for k in range(32):
            total = total + F.when(2 * count(F.col(f"v{k}")) > F.col("n"), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.lpad(F.lower(F.hex(total)), 8, "0")

    low = lambda v: v.bitwiseAND(F.lit(0xFFFFFFFF))
    return votes.select(key, F.concat(half(low), half(lambda v: F.shiftright(v, 32))).alias("print"))


def has_simhash(description: Column) -> Column:
    """Whether there is text enough for a fingerprint."""
    text = cleaned(description)
    return (F.length(text) >= LEAST_CHARS) & (F.regexp_count(text, F.lit("[a-z0-9]+")) >= SHINGLE)


def halves(fingerprint: Column) -> tuple[Column, Column]:
    """A fingerprint's two halves as longs (all 64 bits do not fit a signed one)."""
    return tuple(F.conv(F.substring(fingerprint, k, 8), 16, 10).cast("long") for k in (1, 9))


def hamming(a: Column, b: Column) -> Column:
    (a1, a2), (b1, b2) = halves(a), halves(b)
    return F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))


def score_band(score: Column) -> Column:
    return F.when(score.isNull(), "none").when(score >= 80, "strong").when(score >= 65, "good").otherwise("weak")


def half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def percent(points: Column, weight: Column) -> Column:
    """Rounded half up and kept within 0 and 100; 0 without a weight."""
    share = half_up(points / F.nullif(weight.cast("double"), F.lit(0.0)) * 100)
    return F.when(weight > 0, F.greatest(F.lit(0), F.least(F.lit(100), share))).otherwise(F.lit(0)).cast("long")


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, half_up(done / F.nullif(total.cast("double"), F.lit(0.0)) * 100)).otherwise(F.lit(100)).cast("long")
