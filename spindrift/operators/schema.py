"""A small JSON Schema compiled to one VARIANT expression: all errors of a record in one pass, without a second look at the line.

Keywords: type (one or several), properties, required, additionalProperties (false), minLength, maxLength, pattern, enum, minimum, maximum, items, minItems,
maxItems. As in the drafts, a keyword says nothing about values of other types, and a number without a fraction is an integer.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

# The schema of a crawl record.
CRAWL_RECORD = {
    "type": "object",
    "properties": {
        "url": {"type": "string", "minLength": 1}, "url_normalized": {"type": "string"}, "depth": {"type": "number"}, "parent_url": {"type": ["string", "null"]}, "fragments": {"type": "array"},
        "discovered_at": {"type": ["number", "string", "null"]}, "queued_at": {"type": ["number", "string", "null"]}, "crawled_at": {"type": ["number", "string", "null"]}, "response_time_ms": {"type": ["number", "null"]},
        "status_code": {"type": ["number", "null"]}, "content_type": {"type": ["string", "null"]}, "content_length": {"type": ["number", "null"]}, "title": {"type": ["string", "null"]}, "links": {"type": "array"},
    },
    "required": ["url", "depth", "status_code", "content_type", "links"],
}

ERRORS = "array<struct<path:string,message:string>>"
ROOT = "<root>"
KEYWORDS = {"type", "properties", "required", "additionalProperties", "minLength", "maxLength", "pattern", "enum", "minimum", "maximum", "items", "minItems", "maxItems"}


def _is(kind: Column, v: Column, name: str) -> Column:
    """Whether a value, of which kind is the head of its VARIANT type, is of a JSON type."""
    number = kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    tests = {
        "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID", "array": kind == "ARRAY", "object": kind == "OBJECT", "number": number,
        "integer": number & (F.try_variant_get(v, "$", "double") == F.floor(F.try_variant_get(v, "$", "double"))),
    }
    return F.coalesce(tests[name], F.lit(False))


def _shown(v: Column) -> Column:
    """A value as messages have it: strings in single quotes, all else as JSON."""
    return F.coalesce(F.concat(F.lit("'"), F.when(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0) == "STRING", F.try_variant_get(v, "$", "string")), F.lit("'")), F.to_json(v))


def errors(v: Column, schema: dict, at: Column | None = None) -> Column:
    """Array of (path, message): where and how the VARIANT v departs from schema. Paths are names and places joined by arrows."""
    unknown = set(schema) - KEYWORDS
    if unknown:
        raise ValueError(f"keywords {', '.join(sorted(unknown))} aren't supported")
    here = F.coalesce(at, F.lit(ROOT)) if at is not None else F.lit(ROOT)
    kind = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    found: list[tuple[Column, Column]] = []  # (whether it is broken, message)
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        good = F.lit(False)
        for name in names:
            good = good | _is(kind, v, name)
        found.append((~good, F.concat(_shown(v), F.lit(" is not of type " + ", ".join(f"'{n}'" for n in names)))))
    if "enum" in schema:
        allowed = [json.dumps(x) for x in schema["enum"]]
        found.append((~F.to_json(v).isin(allowed), F.concat(_shown(v), F.lit(f" is not one of [{', '.join(allowed)}]"))))
    is_text, is_number, is_list, is_object = kind == "STRING", _is(kind, v, "number"), kind == "ARRAY", kind == "OBJECT"
    if "minLength" in schema:
        few = " should be non-empty" if schema["minLength"] == 1 else " is too short"
        found.append((is_text & (F.char_length(text) < schema["minLength"]), F.concat(_shown(v), F.lit(few))))
    if "maxLength" in schema:
        found.append((is_text & (F.char_length(text) > schema["maxLength"]), F.concat(_shown(v), F.lit(" is too long"))))
    if "pattern" in schema:
        found.append((is_text & ~text.rlike(schema["pattern"]), F.concat(_shown(v), F.lit(f" does not match '{schema['pattern']}'"))))
    if "minimum" in schema:
        found.append((is_number & (number < schema["minimum"]), F.concat(_shown(v), F.lit(f" is less than the minimum of {schema['minimum']}"))))
    if "maximum" in schema:
        found.append((is_number & (number > schema["maximum"]), F.concat(_shown(v), F.lit(f" is greater than the maximum of {schema['maximum']}"))))
    items = F.when(is_list, F.try_variant_get(v, "$", "array<variant>"))
    for word, test, message in (("minItems", lambda n, m: n < m, " is too short"), ("maxItems", lambda n, m: n > m, " is too long")):
        if word in schema:
            found.append((is_list & test(F.size(items), schema[word]), F.concat(_shown(v), F.lit(message))))
    field = lambda name: F.try_variant_get(v, "$[" + json.dumps(name) + "]", "variant")
    for name in schema.get("required", []):
        found.append((is_object & field(name).isNull(), F.lit(f"'{name}' is a required property")))
    if schema.get("additionalProperties") is False:
        own = F.map_keys(F.when(is_object, F.try_variant_get(v, "$", "map<string,variant>")))
        more = F.array_except(own, F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>"))
        found.append((is_object & (F.size(more) > 0), F.concat(F.lit("Additional properties are not allowed: "), F.array_join(more, ", "))))
    none = F.lit(None).cast("struct<path:string,message:string>")
    parts = [F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.struct(here.alias("path"), message.alias("message"))) for broken, message in found], none))]
    step = lambda place: place if at is None else F.concat(at, F.lit(" -> "), place)
    for name, inner in schema.get("properties", {}).items():
        value = field(name)
        parts.append(F.when(is_object & value.isNotNull(), errors(value, inner, step(F.lit(name)))))
    if "items" in schema:
        parts.append(F.flatten(F.transform(items, lambda x, i: errors(x, schema["items"], step(i.cast("string"))))))
    empty = F.array().cast(ERRORS)
    return F.concat(*[F.coalesce(p, empty) for p in parts])


def validated(lines: DataFrame, schema: dict | None = None) -> tuple[DataFrame, Observation]:
    """(line_number, record, errors) of each of lines(ordinal, line) that isn't blank, and the counts of lines, records without errors, errors, and
    malformed lines that whatever job runs over it observes. A malformed line has one error and no record."""
    record = F.try_parse_json("line")
    malformed = F.array(F.struct(F.lit("<line>").alias("path"), F.format_string("Line %d: Invalid JSON", F.col("ordinal") + 1).alias("message")))
    # the parsed record comes out of a generator, so that each of the many expressions over it doesn't parse the line again
    parsed = lines.where(F.trim("line") != "").select((F.col("ordinal") + 1).alias("line_number"), "ordinal", F.explode(F.array(record)).alias("record"))
    rows = parsed.select("line_number", "record", F.when(F.col("record").isNull(), malformed).otherwise(errors(F.col("record"), schema or CRAWL_RECORD)).cast(ERRORS).alias("errors"))
    seen = Observation()
    counts = {"lines": F.count(F.lit(1)), "valid": F.count_if(F.size("errors") == 0), "errors": F.coalesce(F.sum(F.size("errors")), F.lit(0)), "malformed": F.count_if(F.col("record").isNull())}
    return rows.observe(seen, *[c.alias(name) for name, c in counts.items()]), seen


def error_rows(lines: DataFrame, schema: dict | None = None) -> DataFrame:
    """(line_number, path, message), a row an error."""
    return validated(lines, schema)[0].select("line_number", F.inline("errors"))


def valid_lines(lines: DataFrame, schema: dict | None = None) -> DataFrame:
    """(line_number, record) of the records without errors."""
    return validated(lines, schema)[0].where(F.size("errors") == 0).select("line_number", "record")
