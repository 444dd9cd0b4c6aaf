"""Numbers and texts of steps as Python's own conversions give them, and decoded strings of nested JSON."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from pagewarden.functions import json_plans as J
from pagewarden.functions import plan_steps

VALUES = ["0", "7", "-7", "2.0", "2.99", "-2.99", "1e3", "1.5e2", "true", "false", "null", "[]", "[1]", "{}", '{"a":1}', '""', '" "', '" 12 "', '"\\t-5\\n"', '"+5"', '"1_000"', '"1__0"', '"_1"', '"1_"', '"2.0"', '"1e3"', '"abc"', '"0x10"', '"- 1"', "9007199254740993", "1234567890123456789", '"9007199254740993"']


def python_int(text: str):
    try:
        return int(json.loads(text)), None
    except ValueError:
        return None, "UNCAUGHT_VALUE_ERROR"
    except TypeError:
        return None, "UNCAUGHT_TYPE_ERROR"


def test_integers_are_pythons(spark):
    rows = spark.createDataFrame([(v, f'{{"n": {v}}}') for v in VALUES], "v string, j string")
    got = {r.v: tuple(r.x) for r in rows.select("v", plan_steps.whole_number(F.col("j"), "n", F.lit(3)).alias("x")).collect()}
    assert got == {v: python_int(v) for v in VALUES}
    assert tuple(spark.sql("SELECT '{}' AS j").select(plan_steps.whole_number(F.col("j"), "n", F.lit(3))).first()[0]) == (3, None)


def test_texts_are_pythons(spark):
    plain = [v for v in VALUES if not v.startswith(("[", "{")) and "e" not in v or v in ("true", "false")]
    rows = spark.createDataFrame([(v, f'{{"n": {v}}}') for v in VALUES], "v string, j string")
    got = {r.v: (r.s, r.t) for r in rows.select("v", plan_steps.as_text(F.col("j"), "n").alias("s"), plan_steps.truthy_text(F.col("j"), "n").isNotNull().alias("t")).collect()}
    assert {v: got[v][0] for v in plain} == {v: str(json.loads(v)) for v in plain}
    assert {v: got[v][1] for v in VALUES} == {v: bool(json.loads(v)) for v in VALUES}


def test_strings_of_nested_json(spark):
    values = [{"a": "x\n\"y\"\\", "k@y.org": ["b", {"c": "é😀@", "d": ["", None, 1, True]}]}, [], "s", {"a": "u{k}"}, {"a: ": ", \"b\": "}, 5, None]
    texts = [json.dumps(v) for v in values] + [json.dumps(v, ensure_ascii=False, indent=1) for v in values]

    def leaves(v):
        if isinstance(v, dict):
            v = list(v.values())
        return [v] if isinstance(v, str) else [s for x in v for s in leaves(x)] if isinstance(v, list) else []

    frame = spark.createDataFrame(list(enumerate([*texts, "not json", ""])), "id int, j string")
    got = {r.id: r.s for r in frame.select("id", J.string_values(F.col("j")).alias("s")).collect()}
    assert got == {k: leaves(v) for k, v in enumerate(values * 2)} | {len(texts): None, len(texts) + 1: None}
    hits = spark.createDataFrame([('{"a":"user\\u0040mail.com"}',), ('{"a":"call\\n9876543210"}',), ('{"user@mail.com":1}',), (None,)], "j string")
    assert [r[0] for r in hits.select(J.contains_raw_pii(F.col("j"))).collect()] == [True, True, False, False]
