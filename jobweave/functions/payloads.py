"""JSON out of untrusted text: model answers, pages, envelopes."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from jobweave.functions.text import strip

OPEN_OR_CLOSE = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)


def first_object(text: str) -> str | None:
    """The first balanced {...} of a text, braces inside strings not counted; null if none closes."""
    start, depth = text.find("{"), 0
    if start < 0:
        return None
    for m in OPEN_OR_CLOSE.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if depth == 0:
            return text[start : m.end()]
    return None


def _is_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except ValueError:
        return False


@F.pandas_udf(StringType())
def _balanced(text: pd.Series) -> pd.Series:
    found = text.map(first_object, na_action="ignore")
    return found.where(found.map(lambda x: isinstance(x, str) and _is_object(x)), None)


def object_in(text: Column) -> Column:
    """The JSON object of a chatty answer: a fenced block first, then the first balanced object of the whole; null if neither parses."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.coalesce(_balanced(F.nullif(fence, F.lit(""))), _balanced(text))


def whole_numbers(c: Column) -> Column:
    """An untrusted count: a whole number or null."""
    return F.when(c.cast("string").rlike(r"^\s*[+-]?\d{1,18}\s*$"), F.trim(c.cast("string")).try_cast("long"))


def job_posting_ld(page: Column) -> Column:
    """The first JSON-LD object of a page with the type JobPosting: on its own, in an array or in @graph; a JSON string or null."""
    blocks = F.regexp_extract_all(page, F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), F.lit(1))
    alone = F.transform(blocks, strip)
    listed = lambda b: F.coalesce(F.from_json(b, "array<string>"), F.array(b))
    graph = lambda o: F.coalesce(F.from_json(F.get_json_object(o, "$['@graph']"), "array<string>"), F.array().cast("array<string>"))
    every = F.flatten(F.transform(F.flatten(F.transform(alone, listed)), lambda o: F.concat(F.array(o), graph(o))))
    kind = lambda o: F.get_json_object(o, "$['@type']")
    types = lambda o: F.coalesce(F.from_json(kind(o), "array<string>"), F.array(kind(o)))
    return F.get(F.filter(every, lambda o: F.exists(types(o), lambda t: F.coalesce(F.lower(t) == "jobposting", F.lit(False)))), F.lit(0))
