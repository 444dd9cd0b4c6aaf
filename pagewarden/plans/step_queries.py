"""Typed steps, integer coercion, editable targets and escaped strings over texts derived from orders, beside SQL that has the answers of each shape."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_plans as J
from ..functions import plan_steps
from . import query
from .order_queries import dealt, shaped

#: A step, and its fields after validation; its step number is 1 where it has none.
STEPS = [
    ('{"action": "click", "target": {"elementId": "e{k}"}, "step": 2.0}', {"step": 2, "action": "click", "target": {"elementId": "e{k}"}}),
    ('{"action": "scroll", "pixels": 300.9, "direction": "UP"}', {"action": "scroll", "direction": "up", "pixels": 300}),
    ('{"action": "scroll", "pixels": -1.5, "direction": "sideways", "step": true}', {"action": "scroll", "direction": "down", "pixels": -1}),
    ('{"action": "scroll", "pixels": " +1_000 ", "step": " 7 "}', {"step": 7, "action": "scroll", "direction": "down", "pixels": 1000}),
    ('{"action": "scroll", "description": "down {k}"}', {"action": "scroll", "description": "down {k}", "direction": "down", "pixels": 300}),
    ('{"action": "wait"}', {"action": "wait", "condition": "timeout", "timeout_ms": 2000}),
    ('{"action": "wait", "condition": "SELECTOR", "selector": "#s{k}", "timeout_ms": "{k}"}', {"action": "wait", "condition": "selector", "timeout_ms": "{k}", "selector": "#s{k}"}),
    ('{"action": "wait", "condition": "moon", "timeout_ms": 2e3}', {"action": "wait", "condition": "timeout", "timeout_ms": 2000}),
    ('{"action": "key"}', {"action": "key", "key": "Enter"}),
    ('{"action": "key", "key": "", "value": "Tab{k}", "target": {"selector": "#a"}}', {"action": "key", "target": {"selector": "#a"}, "key": "Tab{k}"}),
    ('{"action": "key", "key": 0, "value": false}', {"action": "key", "key": "Enter"}),
    ('{"action": "type", "value": true, "target": {}}', {"action": "type", "target": {}, "value": "True"}),
    ('{"action": "select", "value": {k}, "description": null, "target": {"rect": {"x":1}}}', {"action": "select", "description": "None", "target": {"rect": '{"x":1}'}, "value": "{k}"}),
    ('{"action": "drag", "source": {"elementId": "a{k}"}, "target": {"elementId": "b"}}', {"action": "drag", "target": {"elementId": "b"}, "from": {"elementId": "a{k}"}}),
    ('{"action": "opentab", "url": "https://x.org/{k}"}', {"action": "opentab", "url": "https://x.org/{k}"}),
    ('{"action": "closetabs", "scope": ""}', {"action": "closetabs", "scope": "all_except_current"}),
    ('{"action": "closetabs", "scope": "tab_numbers", "tab_numbers": [5, 2, 2]}', {"action": "closetabs", "scope": "tab_numbers", "tab_numbers": [2, 5]}),
    ('{"action": "closetabs", "scope": "tab_range", "tab_range": {"start": 3, "end": 1}}', {"action": "closetabs", "scope": "tab_range", "tab_range": {"start": 3, "end": 1}}),
    ('{"action": "screenshot", "value": "x"}', {"action": "screenshot"}),
]
ORDER = ("step", "action", "description", "target", "from", "value", "key", "url", "direction", "pixels", "condition", "timeout_ms", "selector", "scope", "tab_numbers", "tab_range")


def written(fields: dict) -> str:
    """A step's fields as Spark writes them: in order, without nulls; a number that holds the key has no quotes."""
    whole = {"step": 1, "description": "", **fields}
    return json.dumps({c: whole[c] for c in ORDER if c in whole}, separators=(",", ":")).replace('"timeout_ms":"{k}"', '"timeout_ms":{k}')


@query(f"SELECT id, step FROM {shaped('step', [(written(f),) for _, f in STEPS])}")
def f3_typed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with every field that their action has, coerced and with defaults."""
    raw = [(f'{{"tasks": [{s}]}}',) for s, _ in STEPS]
    steps = plan_steps.typed_steps(J.parse_plan(F.col("raw"), F.lit("do it")), J.TARGETED)
    return dealt(spark, sf_dir, "raw", raw).select("id", F.to_json(steps[0]).alias("step"))


#: A field of a scroll or wait step, and the fault of the plan.
NUMBERS = [
    ('"step": {k}', None), ('"step": 1.99', None), ('"step": "{k}"', None), ('"step": "1.0"', "UNCAUGHT_VALUE_ERROR"), ('"step": "one {k}"', "UNCAUGHT_VALUE_ERROR"), ('"step": ""', "UNCAUGHT_VALUE_ERROR"), ('"step": null', "UNCAUGHT_TYPE_ERROR"), ('"step": [{k}]', "UNCAUGHT_TYPE_ERROR"),
    ('"step": false', None), ('"pixels": "1__0"', "UNCAUGHT_VALUE_ERROR"), ('"pixels": "_1"', "UNCAUGHT_VALUE_ERROR"), ('"pixels": "- 1"', "UNCAUGHT_VALUE_ERROR"), ('"pixels": {"a": {k}}', "UNCAUGHT_TYPE_ERROR"), ('"pixels": 1e2', None), ('"timeout_ms": "x"', None),
]


@query(f"SELECT id, error FROM {shaped('error', [(e,) for _, e in NUMBERS])}")
def f2_number_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans whose numbers are floats, padded strings, booleans, nulls or no numbers at all."""
    raw = [(f'{{"tasks": [{{"action": "scroll", {n}}}]}}',) for n, _ in NUMBERS]
    return dealt(spark, sf_dir, "raw", raw).select("id", J.parse_plan(F.col("raw"), F.lit("do it"))["error"].alias("error"))


MAIL, GO_ON = "https://mail.google.com/mail/u/0", "write to {k} AGENT CONTINUATION: step 2"
BODY = '[{"elementId": "b{k}", "editable": true, "label": "Message Body"}, {"elementId": "s{k}", "editable": false}, {"editable": true}]'
#: Intent, page, elements, plan, error.
EDITORS = [
    (GO_ON, MAIL, BODY, '{"tasks": [{"action": "type", "target": {"elementId": "b{k}"}, "value": "x"}]}', None),
    (GO_ON, MAIL, BODY, '{"tasks": [{"action": "type", "target": {"elementId": "s{k}"}, "value": "x"}]}', "COMPOSER_NEEDS_TYPE"),
    (GO_ON, MAIL, BODY, '{"tasks": [{"action": "type", "target": {"elementId": "gone"}, "value": "x"}]}', "COMPOSER_NEEDS_TYPE"),
    (GO_ON, MAIL, BODY, '{"tasks": [{"action": "type", "value": "x"}]}', "COMPOSER_NEEDS_TYPE"),
    (GO_ON, MAIL, BODY, '{"tasks": [{"action": "type", "target": {"elementId": "b{k}"}}, {"action": "key", "key": "TAB"}]}', "COMPOSER_NEEDS_TYPE"),
    (GO_ON, MAIL, BODY, '{"tasks": [{"action": "opentab", "url": "{k}"}]}', "COMPOSER_OPEN"),
    (GO_ON, MAIL, '[{"elementId": "b{k}", "editable": true, "label": "Inbox"}]', '{"tasks": [{"action": "click"}]}', None),
    (GO_ON, "https://x.org/", BODY, '{"tasks": [{"action": "click"}]}', None),
    ("write to {k}", MAIL, BODY, '{"tasks": [{"action": "click"}]}', None),
]


@query(f"SELECT id, error FROM {shaped('error', [(r[4],) for r in EDITORS])}")
def n3_editor_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An open mail editor is found by its elements, and only typing into an editable one of them fills it."""
    rows = dealt(spark, sf_dir, "intent page elements plan", [r[:4] for r in EDITORS])
    return rows.select("id", J.stale_plan(F.col("intent"), F.col("page"), F.lit(""), F.col("plan"), F.col("elements")).alias("error"))


#: JSON texts with escapes, and whether they hold personal data.
ESCAPED = [
    (r'{"a": "user{k}@mail.com"}', True), ('{"a": {"b": ["user{k}\\u0040mail.com"]}}', True), (r'{"a": ["call\n9876543210 {k}"]}', True), (r'{"a": "tab\t9876543210 "}', True), (r'{"us{k}@mail.com": "x"}', False), (r'{"a": "user{k}\\u0040mail.com"}', False),
    (r'{"a": "quote \" u{k}@mail.com"}', True), (r'{"a": "back\\", "b": "u{k}@mail.com"}', True), (r'{"a": "x" , "u{k}@mail.com" : 1}', False), (r'"u{k}@mail.com"', True), ("[]", False), ("{k}", False), (r'{"a": "😀 {k}"}', False),
]


@query(f"SELECT id, raw_pii = 'True' AS raw_pii FROM {shaped('raw_pii', [(str(p),) for _, p in ESCAPED])}")
def t15_escaped_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "j", [(j,) for j, _ in ESCAPED]).select("id", J.contains_raw_pii(F.col("j")).alias("raw_pii"))
