"""Check JSON text against a JSON schema with column expressions.

The schema is compiled to expressions over a parsed variant column, so documents are
checked where they lie, without a row leaving the JVM. Supported: type, enum, minLength,
maxLength, minimum, maximum, minItems, maxItems, items, required, properties, oneOf.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from foliospark.functions import text as tx

Check = Callable[[Column, Column], Column]

# How Spark names the kinds of a variant value, by the schema's type names.
KINDS = {
    "string": ("STRING",),
    "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
    "integer": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
    "boolean": ("BOOLEAN",),
    "array": ("ARRAY",),
    "object": ("OBJECT",),
}


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _none() -> Column:
    return F.array().cast("array<string>")


def _message(holds: Column, *parts: Column | str) -> Column:
    """One message if ``holds``."""
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.when(holds, F.array(text)).otherwise(_none())


def _range_checks(schema: dict, low: str, high: str, label: str, size: Callable[[Column], Column]) -> list[Check]:
    bounds = [(low, "below", lambda s, limit: s < limit), (high, "above", lambda s, limit: s > limit)]
    return [
        lambda v, path, key=key, word=word, breaks=breaks: _message(
            breaks(size(v), F.lit(schema[key])), path, f": {label} ", size(v), f" {word} {key} {schema[key]}"
        )
        for key, word, breaks in bounds
        if schema.get(key) is not None
    ]


def _elements(schema: dict) -> Check:
    return lambda v, path: F.flatten(
        F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: violations(x, schema, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
    )


def _field(name: str, required: bool, schema: dict | None) -> Check:
    def check(v: Column, path: Column) -> Column:
        inner = F.try_variant_get(v, f"$['{name}']", "variant")
        absent = inner.isNull() | F.is_variant_null(inner)
        place = F.concat(path, F.lit(f".{name}"))
        found = _message(F.lit(required), place, ": required field is missing")
        return F.when(absent, found).otherwise(violations(inner, schema, place) if schema else _none())

    return check


def _checks_by_type(schema: dict) -> list[Check]:
    """The checks that apply once the type is right."""
    kind = schema.get("type")
    as_type = lambda t: lambda v: F.try_variant_get(v, "$", t)
    if kind == "string":
        return _range_checks(schema, "minLength", "maxLength", "length", lambda v: F.length(as_type("string")(v)))
    if kind in ("number", "integer"):
        return _range_checks(schema, "minimum", "maximum", "value", as_type("double"))
    if kind == "array":
        items = [_elements(schema["items"])] if isinstance(schema.get("items"), dict) else []
        return _range_checks(schema, "minItems", "maxItems", "items", lambda v: F.size(as_type("array<variant>")(v))) + items
    if kind == "object" or not kind and isinstance(schema.get("properties"), dict):
        properties, required = schema.get("properties") or {}, schema.get("required") or []
        return [_field(n, n in required, properties.get(n)) for n in dict.fromkeys([*required, *properties])]
    return []


def violations(value: Column, schema: dict, path: Column) -> Column:
    """array<string> of what a variant value violates."""
    if isinstance(schema.get("oneOf"), list):
        fits = sum((F.when(F.size(violations(value, s, path)) == 0, 1).otherwise(0) for s in schema["oneOf"]), F.lit(0))
        return _message(fits != 1, path, ": fits ", fits, " sub-schemas of oneOf instead of 1")
    found = []
    if isinstance(schema.get("enum"), list):
        allowed = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in schema["enum"]]
        found.append(_message(~F.to_json(value).isin(allowed), path, ": value ", F.to_json(value), " is not allowed"))
    checks = [c(value, path) for c in _checks_by_type(schema)]
    rest = F.concat(*checks) if checks else _none()
    kinds = KINDS.get(schema.get("type"), ())
    if kinds or checks:
        right = _kind(value).isin(*(kinds or KINDS["object"]))
        wrong = F.array(F.concat(path, F.lit(f": expected {schema['type']}"))) if kinds else _none()
        found.append(F.when(right, rest).otherwise(wrong))
    return F.concat(*found) if found else _none()


def strip_fence(text: Column | str) -> Column:
    """JSON inside a Markdown code fence, or the text itself."""
    trimmed = tx.strip(text)
    inner = F.regexp_extract(trimmed, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(inner != "", inner).otherwise(trimmed)


def check(text: Column | str, schema: dict) -> Column:
    """array<string> of violations; text that is not JSON gives a single message."""
    parsed = F.try_parse_json(strip_fence(text))
    return F.when(parsed.isNull(), F.array(F.lit("$: not valid JSON"))).otherwise(violations(parsed, schema, F.lit("$")))
