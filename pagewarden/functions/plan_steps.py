"""Typed steps of a plan: every field that an action has, coerced and with its default, from a step's JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# What a scroll and a wait may name, and their defaults.
DIRECTIONS = ["up", "down", "left", "right"]
CONDITIONS = ["navigation", "selector", "timeout"]
PIXELS, TIMEOUT_MS = 300, 2000
# End of the fixed values.

TARGET = "struct<elementId string, selector string, rect string>"


def _kind(step: Column, path: str) -> Column:
    """The JSON type of a field: a SQL type's name, VOID for null, null where it is missing."""
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(step), f"$.{path}", "variant"))


def _raw(step: Column, path: str) -> Column:
    return F.get_json_object(step, f"$.{path}")


def whole_number(step: Column, path: str, default: Column) -> Column:
    """Struct (value, fault) of a field as an integer: numbers lose their fraction, booleans are 1 and 0, a string may be an integer with spaces
    around it and single underscores within; a missing field is the default, anything else a fault.  Integers beyond 64 bits are null."""
    kind, raw = _kind(step, path), _raw(step, path)
    plain = F.regexp_replace(F.regexp_replace(raw, r"^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$", ""), "_", "")
    written = raw.rlike(r"^[ \t\n\r\x0B\f]*[+-]?[0-9]+(?:_[0-9]+)*[ \t\n\r\x0B\f]*$")
    value = (
        F.when(kind.isNull(), default.cast("long"))
        .when(kind == "BOOLEAN", (raw == "true").cast("long"))
        .when(kind == "STRING", F.when(written, plain.try_cast("long")))
        .when((kind == "BIGINT") | kind.startswith("DECIMAL"), F.regexp_replace(raw, r"\..*$", "").try_cast("long"))
        .when(kind == "DOUBLE", raw.try_cast("double").try_cast("long"))
    )
    fault = F.when((kind == "STRING") & ~written, "UNCAUGHT_VALUE_ERROR").when((kind == "VOID") | kind.startswith("OBJECT") | kind.startswith("ARRAY"), "UNCAUGHT_TYPE_ERROR")
    return F.struct(value.alias("value"), fault.alias("fault"))


def as_text(step: Column, path: str) -> Column:
    """A field as text: strings as they are, true and false capitalised, null as None, numbers and nested values as their JSON; null where it is missing."""
    kind, raw = _kind(step, path), _raw(step, path)
    return F.when(kind == "BOOLEAN", F.initcap(raw)).when(kind == "VOID", "None").otherwise(raw)


def truthy_text(step: Column, path: str) -> Column:
    """A field as text, null where it is missing, null, empty, zero or false."""
    raw = _raw(step, path)
    empty = raw.isNull() | ((_kind(step, path) != "STRING") & (raw.isin("false", "[]", "{}") | raw.rlike(r"^-?0+(\.0*)?([eE].*)?$"))) | (raw == "")
    return F.when(~empty, as_text(step, path))


def _target(step: Column, path: str) -> Column:
    return F.struct(_raw(step, f"{path}.elementId").alias("elementId"), _raw(step, f"{path}.selector").alias("selector"), _raw(step, f"{path}.rect").alias("rect"))


def typed_step(step: Column, place: Column, targeted: list[str]) -> Column:
    """Struct of a step that has no fault: fields that its action doesn't have are null.  ``place`` counts steps from 0."""
    act = _raw(step, "action")
    none = F.lit(None)
    has = lambda name: _kind(step, name).isNotNull()
    only = lambda when, value: F.when(when, value)
    low = lambda name, default: F.lower(F.coalesce(as_text(step, name), F.lit(default)))
    direction, condition = low("direction", "down"), low("condition", "timeout")
    direction = F.when(direction.isin(*DIRECTIONS), direction).otherwise("down")
    condition = F.when(condition.isin(*CONDITIONS), condition).otherwise("timeout")
    scope = F.coalesce(truthy_text(step, "scope"), F.lit("all_except_current"))
    numbers = F.array_sort(F.array_distinct(F.from_json(_raw(step, "tab_numbers"), "array<int>")))
    span = F.struct(_raw(step, "tab_range.start").cast("int").alias("start"), _raw(step, "tab_range.end").cast("int").alias("end"))
    origin = F.when(has("from"), _target(step, "from")).otherwise(_target(step, "source"))
    return F.struct(
        whole_number(step, "step", place + 1)["value"].alias("step"),
        act.alias("action"),
        F.coalesce(as_text(step, "description"), F.lit("")).alias("description"),
        only(act.isin(*targeted, "drag") | (act.isin("key", "scroll") & has("target")), _target(step, "target")).alias("target"),
        only(act == "drag", origin).alias("from"),
        only(act.isin("type", "select"), as_text(step, "value")).alias("value"),
        only(act == "key", F.coalesce(truthy_text(step, "key"), truthy_text(step, "value"), F.lit("Enter"))).alias("key"),
        only(act.isin("navigate", "opentab"), truthy_text(step, "url")).alias("url"),
        only(act == "scroll", direction).alias("direction"),
        only(act == "scroll", whole_number(step, "pixels", F.lit(PIXELS))["value"]).alias("pixels"),
        only(act == "wait", condition).alias("condition"),
        only(act == "wait", whole_number(step, "timeout_ms", F.lit(TIMEOUT_MS))["value"]).alias("timeout_ms"),
        only((act == "wait") & (condition == "selector"), F.coalesce(as_text(step, "selector"), F.lit(""))).alias("selector"),
        only(act == "closetabs", scope).alias("scope"),
        F.coalesce(only((act == "closetabs") & (scope == "tab_numbers"), numbers), none.cast("array<int>")).alias("tab_numbers"),
        only((act == "closetabs") & (scope == "tab_range"), span).alias("tab_range"),
    )


def typed_steps(plan: Column, targeted: list[str]) -> Column:
    """The steps of a valid plan (``json_plans.parse_plan``) as typed structs; null for a plan with an error."""
    return text.let(plan, lambda p: F.when(p["error"].isNull(), F.transform(p["steps"], lambda s, i: typed_step(s, i, targeted))))
