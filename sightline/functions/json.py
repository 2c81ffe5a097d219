"""Lenient reading of JSON that models wrote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient(text: Column, schema: str) -> Column:
    """The value of the first reading that parses: as it is, inside a code fence, the first object or array, without trailing commas."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1)
    mended = F.regexp_replace(body, r",\s*([}\]])", "$1")
    parse = lambda c: F.from_json(F.when(F.try_parse_json(c).isNotNull(), c), schema)
    return F.coalesce(*[parse(F.nullif(F.trim(c), F.lit(""))) for c in (text, fence, body, mended)])


def whole_objects(text: Column) -> Column:
    """Complete flat objects of an array that breaks off."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda o: F.try_parse_json(o).isNotNull())


def entities(text: Column) -> Column:
    """array<struct<name, context, type>> from either shape: ["n"] or [{name, context, type}]; nameless elements are left out."""
    items = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    one = lambda e: F.struct(
        F.trim(F.coalesce(F.get_json_object(e, "$.name"), F.when(~e.startswith("{"), e))).alias("name"), F.get_json_object(e, "$.context").alias("context"), F.get_json_object(e, "$.type").alias("type")
    )
    return F.filter(F.transform(items, one), lambda x: x["name"].isNotNull() & (x["name"] != ""))


def vector(text: Column) -> Column:
    return F.from_json(text, "array<float>")
