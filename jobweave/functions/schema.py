"""A JSON schema as one expression: what is wrong with a JSON text, each problem with its path, without Python.

Types (object, array, string, integer, number, boolean, null, or a list of them), properties, required, additionalProperties (a schema or false), items, enum, minimum, maximum, minLength, maxLength,
minItems and maxItems are compiled; another keyword that restricts is refused, as leaving it out would let wrong answers pass.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

KNOWN = {"type", "properties", "required", "additionalProperties", "items", "enum", "minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems", "title", "description", "default"}
NONE = "array<string>"
#: What a value may be called in Spark for each type of a schema.
KINDS = {"object": r"^OBJECT", "array": r"^ARRAY", "string": r"^STRING$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": r"^BOOLEAN$", "null": r"^VOID$"}


def none() -> Column:
    return F.array().cast(NONE)


def when(test: Column, message: Column) -> Column:
    return F.when(test, F.array(message)).otherwise(none())


def inner(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def checked(value: Column, schema: dict, at: Column) -> Column:
    """The problems of a variant; at: its path as text."""
    unknown = set(schema) - KNOWN
    if unknown:
        raise ValueError(f"keywords that are not compiled: {', '.join(sorted(unknown))}")
    called = F.schema_of_variant(value)
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else list(kinds or [])
    is_a = lambda kind: F.coalesce(called.rlike(KINDS[kind]), F.lit(False))
    out = []
    if kinds:
        fits = F.lit(False)
        for k in kinds:
            fits = fits | is_a(k)
        out.append(when(~fits, F.concat(at, F.lit(": is "), F.lower(F.regexp_extract(called, r"^[A-Z]+", 0)), F.lit(f", not {' or '.join(kinds)}"))))
    if "enum" in schema:
        allowed = [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in schema["enum"]]
        out.append(when(~F.to_json(value).isin(allowed), F.concat(at, F.lit(f": is none of {', '.join(allowed)}"))))
    number = inner(value, "$", "double")
    text = F.length(inner(value, "$", "string"))
    size = F.size(inner(value, "$", "array<variant>"))
    for word, kind, test, say in (
        ("minimum", "number", lambda b: number < F.lit(float(b)), "is under"),
        ("maximum", "number", lambda b: number > F.lit(float(b)), "is over"),
        ("minLength", "string", lambda b: text < b, "is shorter than"),
        ("maxLength", "string", lambda b: text > b, "is longer than"),
        ("minItems", "array", lambda b: size < b, "has fewer items than"),
        ("maxItems", "array", lambda b: size > b, "has more items than"),
    ):
        if word in schema:
            out.append(when(is_a(kind) & test(schema[word]), F.concat(at, F.lit(f": {say} {schema[word]}"))))
    named = schema.get("properties", {})
    for name, own in named.items():
        child, path = inner(value, "$[" + json.dumps(name, ensure_ascii=False) + "]", "variant"), F.concat(at, F.lit(f".{name}"))
        missing = when(is_a("object") & child.isNull(), F.concat(path, F.lit(": is missing"))) if name in schema.get("required", []) else none()
        out.append(F.when(child.isNull(), missing).otherwise(checked(child, own, path)))
    out += [when(is_a("object") & inner(value, "$[" + json.dumps(n, ensure_ascii=False) + "]", "variant").isNull(), F.concat(at, F.lit(f".{n}: is missing"))) for n in schema.get("required", []) if n not in named]
    more = schema.get("additionalProperties")
    if more is not None and more is not True:
        entries = F.filter(F.map_entries(inner(value, "$", "map<string,variant>")), lambda e: ~e["key"].isin(list(named)) if named else F.lit(True))
        problem = lambda e: F.array(F.concat(at, F.lit("."), e["key"], F.lit(": is not known"))) if more is False else checked(e["value"], more, F.concat(at, F.lit("."), e["key"]))
        out.append(F.when(is_a("object"), F.flatten(F.transform(entries, problem))).otherwise(none()))
    if "items" in schema:
        each = F.transform(inner(value, "$", "array<variant>"), lambda x, k: checked(x, schema["items"], F.concat(at, F.lit("["), k.cast("string"), F.lit("]"))))
        out.append(F.when(is_a("array"), F.flatten(each)).otherwise(none()))
    return F.coalesce(F.concat(*out), none()) if out else none()


def problems(text: Column, schema: dict) -> Column:
    """array<string>: what is wrong with a JSON text by the schema, as "path: problem", `$` the whole; empty where it is valid."""
    value = F.try_parse_json(text)
    return F.when(value.isNull(), F.array(F.lit("$: is not JSON"))).otherwise(checked(value, schema, F.lit("$")))
