"""The plan, gate and receipt operators over texts derived from orders: each order takes one of a list of shapes by its key and holds
the key itself, so the rows grow with the table.  The SQL has the answer of each shape, with the key put in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import json_plans as J
from ..functions import text
from ..operators.redaction import strategy
from ..sources import pages as P
from . import plan_queries, query, spread, table
from .geometry_queries import F20, flat
from .plan_queries import values


def dealt(spark: SparkSession, sf_dir: str, names: str, shapes: list[tuple]) -> DataFrame:
    """id and the named texts of each order's shape, ``{k}`` replaced by its key."""
    k, n = F.col("o_orderkey"), names.split()
    lit = lambda v: F.lit(v).cast("string")
    shape = F.element_at(F.array(*[F.struct(*[lit(v).alias(c) for c, v in zip(n, s, strict=True)]) for s in shapes]), (k % len(shapes) + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), shape.alias("s"))
    return rows.select("id", *[F.replace(f"s.{c}", F.lit("{k}"), F.col("id").cast("string")).alias(c) for c in n])


def shaped(names: str, shapes: list[tuple]) -> str:
    """SQL of the same rows: id and the named values of each order's shape."""
    n = names.split()
    put = lambda c: f"replace(CAST(v.{c} AS VARCHAR), '{{k}}', CAST(o_orderkey AS VARCHAR)) AS {c}"
    return f"(SELECT o_orderkey AS id, {', '.join(map(put, n))} FROM orders JOIN {values([(k, *s) for k, s in enumerate(shapes)])} AS v(k, {', '.join(n)}) ON o_orderkey % {len(shapes)} = v.k)"


#: Raw outputs with text around them, and the fault of each.
RAW = [(f"Reply {{k}}: {raw}", error) for raw, error in plan_queries.RAW]


@query(f"SELECT id, coalesce(nullif(regexp_extract(raw, '(?s)```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1), ''), CASE WHEN instr(raw, '{{') > 0 AND length(regexp_extract(raw, '(?s)^(.*\\}})', 1)) >= instr(raw, '{{') THEN substr(regexp_extract(raw, '(?s)^(.*\\}})', 1), instr(raw, '{{')) END) AS json FROM {shaped('raw', [(r,) for r, _ in RAW])}")
def f1_order_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "raw", [(r,) for r, _ in RAW]).select("id", J.extract_json(F.col("raw")).alias("json"))


@query(f"SELECT id, error FROM {shaped('error', [(e,) for _, e in RAW])}")
def f2_order_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "raw", [(r,) for r, _ in RAW]).select("id", J.parse_plan(F.col("raw"), F.lit("do it"))["error"].alias("error"))


@query(f"SELECT id, error IS NULL AS ok FROM {shaped('error', [(e,) for _, e in RAW])}")
def f3_order_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(spark, sf_dir, "raw", [(r,) for r, _ in RAW])
    return rows.select("id", J.parse_plan(F.col("raw"), F.lit("do it"))["error"].isNull().alias("ok"))


@query(f"SELECT id, error FROM {shaped('error', [(e,) for _, e in plan_queries.SECOND])}")
def f5_order_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "plan", [(p,) for p, _ in plan_queries.SECOND]).select("id", J.second_verdict(F.col("plan")).alias("error"))


@query(f"SELECT id, pass = 'True' AS pass FROM {shaped('pass', [(str(p),) for _, p in plan_queries.GATE])}")
def f6_order_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "state", [(s,) for s, _ in plan_queries.GATE]).select("id", J.privacy_gate(F.col("state")).alias("pass"))


RESPONSES = [('{"output_text": "a{k}"}', "a{k}"), ('{"output_text": "", "steps": [{"content": [{"text": "b"}, {"text": "{k}"}]}]}', "b{k}"), ('{"outputs": [{"text": "{k}"}, {"text": "e"}]}', "{k}e"), ("{}", None)]


@query(f"SELECT id, answer FROM {shaped('answer', [(a,) for _, a in RESPONSES])}")
def f16_order_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "r", [(r,) for r, _ in RESPONSES]).select("id", J.response_text(F.col("r")).alias("answer"))


SEARCHES = [
    ("play song {k}", "https://x.org/", "youtube", "song {k}", "https://www.youtube.com/results?search_query=song+{k}", "false"),
    ("play mix {k} on youtube music", "https://x.org/", "youtube", "mix {k}", "https://www.youtube.com/results?search_query=mix+{k}", "false"),
    ("search for red shoes {k} on amazon", "https://x.org/", "amazon", "red shoes {k}", "https://www.amazon.in/s?k=red+shoes+{k}", "true"),
    ("find part {k} in wiki", "https://x.org/", "wikipedia", "part {k}", "https://en.wikipedia.org/w/index.php?search=part+{k}", "true"),
    ("play {k} on spotify", "https://x.org/", None, None, None, None),
    ("click button {k}", "https://x.org/", None, None, None, None),
    ("search for cats {k} on google", "https://www.google.com/search?q=cats", None, None, None, None),
]


@query(f"SELECT id, site, query, url, CAST(task_complete AS BOOLEAN) AS task_complete FROM {shaped('site query url task_complete', [r[2:] for r in SEARCHES])}")
def n1_order_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(spark, sf_dir, "intent page", [r[:2] for r in SEARCHES])
    return rows.select("id", J.direct_search(F.col("intent"), F.col("page")).alias("d")).select("id", "d.site", "d.query", "d.url", "d.task_complete")


TABS = [("close all tabs except this tab", "all_except_current", "", None, None), ("close tabs 3 to {k}", "tab_range", "", "3", "{k}"), ("remove tabs {k}, 2 and {k}", "tab_numbers", "numbers", None, None), ("open tab {k}", None, None, None, None)]


@query(f"SELECT id, scope, CASE numbers WHEN 'numbers' THEN array_to_string(list_sort(list_distinct([2, id])), ',') ELSE numbers END AS numbers, CAST(first AS INT) AS first, CAST(last AS INT) AS last FROM {shaped('scope numbers first last', [r[1:] for r in TABS])} WHERE id > 0")
def n2_order_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(spark, sf_dir, "intent", [(r[0],) for r in TABS]).filter("id > 0").select("id", J.tab_command(F.col("intent")).alias("t"))
    return rows.select("id", "t.scope", F.when(F.col("t").isNotNull(), F.array_join(F.col("t.numbers").cast("array<string>"), ",")).alias("numbers"), F.col("t.start").alias("first"), F.col("t.end").alias("last"))


@query(f"SELECT id, error FROM {shaped('error', [(r[4],) for r in plan_queries.STALE])}")
def n3_order_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(spark, sf_dir, "intent page visible plan", [r[:4] for r in plan_queries.STALE])
    return rows.select("id", J.stale_plan(*[F.col(c) for c in ("intent", "page", "visible", "plan")]).alias("error"))


@query(f"SELECT id, fresh = 'True' AS fresh FROM {shaped('fresh', [(str(f),) for _, f in plan_queries.FRESH])}")
def n4_order_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "plan", [(p,) for p, _ in plan_queries.FRESH]).select("id", J.needs_fresh_plan(F.col("plan")).alias("fresh"))


TYPED = [("search mail {k}", plan_queries.PROSE + "{k}", "ed{k}", "ed{k}"), ("search mail", "short {k}", "ed{k}", "planned"), ("subject {k}", plan_queries.PROSE, "ed{k}", "planned"), ("search mail", plan_queries.PROSE, None, "planned")]


@query(f"SELECT id, target FROM {shaped('target', [(r[3],) for r in TYPED])}")
def n5_order_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "descriptor value editor", [r[:3] for r in TYPED]).select("id", plan_queries.type_target().alias("target"))


#: States, whether they pass, and the counts of a receipt: elements, forms, visual texts, redacted regions.
STATES = [
    ('{"interactiveElements": [{"a": "{k}"}, {"a": 2}], "forms": [], "privacy": {"sanitized": true, "rawScreenshotIncluded": false, "redactedRegionCount": {k}}}', "OK", 2, 0, 0, "{k}"),
    ('{"visualText": [1, {k}, 3], "privacy": {"sanitized": false}}', "NOT_SANITIZED", 0, 0, 3, "0"),
    ('{"forms": [{"mail": "u{k}@mail.com"}], "privacy": {"sanitized": true, "rawScreenshotIncluded": false}}', "RAW_PII", 0, 1, 0, "0"),
    ("not json {k}", "INVALID_JSON", 0, 0, 0, "0"),
]


@query(f"SELECT id, status FROM {shaped('status', [(r[1],) for r in STATES])}")
def s10_order_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "s", [(r[0],) for r in STATES]).select("id", plan_queries.state_status().alias("status"))


@query(f"SELECT id, CAST(elements AS INT) AS elements, CAST(forms AS INT) AS forms, CAST(visual_text AS INT) AS visual_text, CAST(redacted AS INT) AS redacted FROM {shaped('elements forms visual_text redacted', [r[2:] for r in STATES])}")
def a8_order_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "s", [(r[0],) for r in STATES]).select("id", *plan_queries.receipt_counts())


SIDES = [("1.0", "2.0", "3.0", "4.0"), ("1", "2", "10", "20"), ("5", "6", "3", "3"), ("0", "0", "1", "1"), (None, None, None, None)]


@query(f"SELECT id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(width AS DOUBLE) AS width, CAST(height AS DOUBLE) AS height FROM {shaped('x y width height', SIDES)}")
def f20_order_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "j", [(j,) for _, j in F20]).select("id", G.any_rect(F.col("j")).alias("r")).select("id", *flat("r"))


KINDS = [("FACE", "BLUR"), ("EMAIL", "BLACKOUT"), ("PERSON", "BLACKOUT")]


@query(f"SELECT id, category, strategy FROM {shaped('category strategy', KINDS)}")
def p12_order_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "category", [(c,) for c, _ in KINDS]).select("id", "category", strategy(F.col("category")).alias("strategy"))


TAGS = [("button", None, "button"), ("input", "true", "input"), ("textarea", None, "textarea"), ("a", "true", "link"), ("h1", "true", "contenteditable"), ("h3", None, "heading"), ("div", "", "contenteditable"), ("div", "false", "div"), ("h7", None, "h7"), ("select", None, "select")]


@query(f"SELECT id, tag, category FROM {shaped('tag category', [(t, c) for t, _, c in TAGS])}")
def p2_order_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dealt(spark, sf_dir, "tag editable", [(t, e) for t, e, _ in TAGS])
    attrs = F.when(F.col("editable").isNotNull(), F.create_map(F.lit("contenteditable"), "editable")).otherwise(F.create_map().cast("map<string,string>"))
    return rows.withColumn("attrs", attrs).select("id", "tag", P.category().alias("category"))


SEVERITIES = [("EMAIL", "HIGH"), ("PASSWORD", "CRITICAL"), ("PHONE", "HIGH"), ("UNKNOWN_{k}", "HIGH")]


@query(f"SELECT id, category, severity FROM {shaped('category severity', SEVERITIES)}")
def j12_order_severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "category", [(c,) for c, _ in SEVERITIES]).select("id", "category", text.severity(F.col("category")).alias("severity"))


BOXES = [("Account Holder", "Max Power {k}", "PERSON", "Max Power {k}"), ("Passport: Z{k}", "", "GOVERNMENT_ID", "Z{k}"), ("Bank Account Number", "", None, None), ("hello", "world {k}", None, None)]


@query(f"SELECT id AS box, category, value FROM {shaped('category value', [r[2:] for r in BOXES])} WHERE category IS NOT NULL")
def j2_order_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.names import label_values

    rows = dealt(spark, sf_dir, "first second", [r[:2] for r in BOXES])
    nodes = rows.select(F.col("id").alias("box"), F.posexplode(F.filter(F.array("first", "second"), lambda t: t != "")).alias("ord", "text"))
    return label_values(nodes)


def pictures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Recognised texts and regions of a picture for each customer."""
    c = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("image_id")))
    lay = lambda rows, names: F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r[1:], names.split(), strict=True)]) for r in rows]))
    texts = c.select("image_id", lay([(1, *r[1:]) for r in plan_queries.OCR], "text_id text x1 y1 x2 y2"))
    texts = texts.withColumn("text", F.replace("text", F.lit("rohan@"), F.concat(F.lit("u"), F.col("image_id").cast("string"), F.lit("@"))))
    return texts, c.select("image_id", lay(plan_queries.FIELDS, "region_id x y width height"))


@query("SELECT c_custkey AS image_id, v.* FROM customer, (VALUES (1, 'EMAIL', 'LABEL_AND_UI_CONTEXT', 1), (2, 'EMAIL', 'TEXT_PATTERN', NULL), (3, 'PIN', 'LABEL_AND_UI_CONTEXT', 2), (3, 'SECRET_KEY', 'LABEL_AND_UI_CONTEXT', 2)) AS v(text_id, type, detection_source, region)")
def m13_customer_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.vision import sensitive_information

    return sensitive_information(*pictures(spark, sf_dir), 640, 480).select("image_id", "text_id", "type", "detection_source", F.col("region_id").alias("region"))


@query("SELECT c_custkey AS image_id, 4 AS texts, 2 AS regions, 4 AS sensitive FROM customer")
def a6_customer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_queries.vision_summary(*pictures(spark, sf_dir))
