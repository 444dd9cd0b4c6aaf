"""Queries of plans: extraction, validation, rewriting, prompts and receipts.

The inputs are literal, as the tables hold no plans; where SQL has the rows, they are worked out by hand from the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import json_plans as J
from ..functions import text
from . import query, rows_of, table
from .text_queries import quoted

RAW = [
    ('{"type": "answer", "answer": "two"}', None),
    ('```json\n{"type": "tasks", "tasks": [{"action": "click", "target": {"elementId": "e1"}}]}\n```', None),
    ('Sure: {"tasks": [{"action": "fly"}]} done', "UNKNOWN_ACTION"),
    ("no braces", "NO_JSON"),
    ("} before {", "NO_JSON"),
    ('{"type": "poem"}', "BAD_TYPE"),
    ('{"tasks": []}', "EMPTY_TASKS"),
    ('{"type": "answer", "answer": " "}', "EMPTY_ANSWER"),
    ('{"type": "answer", "answer": "x", "tasks": [{"action": "click"}]}', "ANSWER_WITH_TASKS"),
    ('{"type": "mixed", "answer": "x"}', "MIXED_INCOMPLETE"),
    ('{"tasks": [{"action": "type", "target": {}}]}', "VALUE_REQUIRED"),
    ('{"tasks": [{"action": "navigate"}]}', "URL_REQUIRED"),
    ('{"tasks": [{"action": "closetabs", "scope": "tab_numbers", "tab_numbers": [0]}]}', "BAD_TAB_NUMBERS"),
    ('{"tasks": [{"action": "closetabs", "scope": "tab_numbers", "tab_numbers": [2,2,5]}]}', None),
    ('{"tasks": [{"action": "closetabs", "scope": "tab_range", "tab_range": {"start": 3}}]}', "BAD_TAB_RANGE"),
    ('{"tasks": [{"action": "scroll", "direction": "sideways", "pixels": "abc"}]}', "UNCAUGHT_VALUE_ERROR"),
    ('{"requires_screenshot": true, "tasks": [{"action": "click"}]}', "SCREENSHOT_WITH_TASKS"),
    ('{"requires_screenshot": true, "tasks": []}', None),
    ('{"tasks": "later"}', "TASKS_NOT_LIST"),
    ('{"tasks": [{"action": "click", "target": "e1"}]}', "TARGET_NOT_OBJECT"),
    ('{"tasks": [{"action": "click"}', "INVALID_JSON"),
    ('{"tasks": [7]}', "STEP_NOT_OBJECT"),
]


def values(rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in r) + ")" for r in rows) + ")"


def raw_rows(spark: SparkSession) -> DataFrame:
    return rows_of(spark, "id int, raw string", [(k, r) for k, (r, _) in enumerate(RAW)])


@query(f"SELECT id, coalesce(nullif(regexp_extract(raw, '(?s)```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1), ''), CASE WHEN instr(raw, '{{') > 0 AND length(regexp_extract(raw, '(?s)^(.*\\}})', 1)) >= instr(raw, '{{') THEN substr(regexp_extract(raw, '(?s)^(.*\\}})', 1), instr(raw, '{{')) END) AS json FROM {values([(k, r) for k, (r, _) in enumerate(RAW)])} AS v(id, raw)")
def f1_extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_rows(spark).select("id", J.extract_json(F.col("raw")).alias("json"))


@query(f"SELECT id, error FROM {values([(k, e) for k, (_, e) in enumerate(RAW)])} AS v(id, error)")
def f2_parse_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_rows(spark).select("id", J.parse_plan(F.col("raw"), F.lit("do it"))["error"].alias("error"))


@query(f"SELECT id, error IS NULL AS ok FROM {values([(k, e) for k, (_, e) in enumerate(RAW)])} AS v(id, error)")
def f3_step_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_rows(spark).select("id", J.parse_plan(F.col("raw"), F.lit("do it")).alias("p")).select("id", F.col("p.error").isNull().alias("ok"))


@query("SELECT id, action, CAST(element_id AS VARCHAR) AS element_id, CAST(NULL AS VARCHAR) AS selector FROM (VALUES (1, 'click', 'e1'), (13, 'closetabs', NULL)) AS v(id, action, element_id)")
def f4_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raw_rows(spark).select("id", J.parse_plan(F.col("raw"), F.lit("do it")).alias("p")).filter("p.error IS NULL").select("id", F.explode("p.steps").alias("t"))
    return p.select("id", F.get_json_object("t", "$.action").alias("action"), F.get_json_object("t", "$.target.elementId").alias("element_id"), F.get_json_object("t", "$.target.selector").alias("selector"))


SECOND = [
    ('{"tasks": [{"step": 1, "action": "click", "target": {"elementId": "e"}}]}', None), ('{"tasks": [{"step": 0, "action": "click", "target": {"elementId": "e"}}]}', "BAD_STEP"),
    ('{"tasks": [{"step": 1, "action": "click", "target": {}}]}', "TARGET_REQUIRED"), ('{"type": "mixed", "tasks": []}', None), ('{"tasks": []}', "EMPTY_TASKS"), ('{"x": 1}', "NO_TASKS"), ("[1]", "NOT_OBJECT"),
    ('{"tasks": [' + ", ".join('{"step": 1, "action": "screenshot"}' for _ in range(51)) + "]}", "TOO_MANY_STEPS"), ('{"tasks": [{"step": 1, "action": "opentab", "url": ""}]}', "URL_REQUIRED"),
]


@query(f"SELECT id, error FROM {values([(k, e) for k, (_, e) in enumerate(SECOND)])} AS v(id, error)")
def f5_second_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "id int, plan string", [(k, p) for k, (p, _) in enumerate(SECOND)])
    return rows.select("id", J.second_verdict(F.col("plan")).alias("error"))


GATE = [
    ('{"privacy": {"sanitized": true, "rawScreenshotIncluded": false}}', True), ('{"privacy": {"sanitized": "true", "rawScreenshotIncluded": false}}', False), ('{"privacy": {"sanitized": 1, "rawScreenshotIncluded": false}}', False),
    ('{"privacy": {"sanitized": true}}', False), ('{"privacy": {"sanitized": true, "rawScreenshotIncluded": null}}', False), ('{"privacy": {"sanitized": true, "rawScreenshotIncluded": true}}', False),
    ('{"privacy": {"sanitized": true, "rawScreenshotIncluded": false, "redactionMap": {}}}', False), ('{"privacy": {"sanitized": true, "rawScreenshotIncluded": false, "redactionMap": []}}', True), ("{}", False),
]


@query(f"SELECT id, pass FROM {values([(k, p) for k, (_, p) in enumerate(GATE)])} AS v(id, pass)")
def f6_privacy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "id int, state string", [(k, s) for k, (s, _) in enumerate(GATE)])
    return rows.select("id", J.privacy_gate(F.col("state")).alias("pass"))


@query("SELECT conv_id, 'Page URL: https://x.org/' || conv_id || chr(10) || 'Page Title: ' || role || chr(10) || chr(10) || 'User Task: ' || CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 80) || '... [truncated]' END || chr(10) || chr(10) || 'Respond with tasks.json:' AS prompt FROM conversations WHERE turn = 0")
def f14_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.prompts import user_prompt

    own = table(spark, sf_dir, "conversations").filter("turn = 0")
    return own.select("conv_id", user_prompt(F.concat(F.lit("https://x.org/"), F.col("conv_id").cast("string")), F.col("role"), text.truncate(F.col("text"), 80)).alias("prompt"))


@query("""SELECT conv_id, '[{"role":"system","content":"You plan browser steps."},{"role":"user","content":' || CAST(to_json(text) AS VARCHAR) || '}]' AS messages FROM conversations WHERE turn = 0""")
def f15_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.prompts import messages

    own = table(spark, sf_dir, "conversations").filter("turn = 0")
    return own.select("conv_id", F.to_json(messages(F.lit("You plan browser steps."), F.col("text"))).alias("messages"))


RESPONSES = [('{"output_text": "a"}', "a"), ('{"output_text": "", "steps": [{"content": [{"text": "b"}, {"text": "c"}]}]}', "bc"), ('{"outputs": [{"text": "d"}, {"text": "e"}]}', "de"), ("{}", None)]


@query(f"SELECT id, CAST(answer AS VARCHAR) AS answer FROM {values([(k, a) for k, (_, a) in enumerate(RESPONSES)])} AS v(id, answer)")
def f16_response_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "id int, r string", [(k, r) for k, (r, _) in enumerate(RESPONSES)])
    return rows.select("id", J.response_text(F.col("r")).alias("answer"))


SEARCHES = [
    ("play khat song", "https://x.org/", "youtube", "khat song", "https://www.youtube.com/results?search_query=khat+song", False),
    ("play despacito on youtube music", "https://x.org/", "youtube", "despacito", "https://www.youtube.com/results?search_query=despacito", False),
    ("search for red shoes on amazon", "https://x.org/", "amazon", "red shoes", "https://www.amazon.in/s?k=red+shoes", True),
    ("find spark in wiki", "https://x.org/", "wikipedia", "spark", "https://en.wikipedia.org/w/index.php?search=spark", True),
    ("play x on spotify", "https://x.org/", None, None, None, None),
    ("click the button", "https://x.org/", None, None, None, None),
    ("search for cats on google", "https://www.google.com/search?q=cats", None, None, None, None),
    ("search for pyspark on github and open", "https://x.org/", "github", "pyspark", "https://github.com/search?q=pyspark&type=repositories", True),
]


@query("SELECT id, CAST(site AS VARCHAR) AS site, CAST(query AS VARCHAR) AS query, CAST(url AS VARCHAR) AS url, CAST(task_complete AS BOOLEAN) AS task_complete FROM " + values([(k, *r[2:]) for k, r in enumerate(SEARCHES)]) + " AS v(id, site, query, url, task_complete)")
def n1_direct_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "id int, intent string, page string", [(k, *r[:2]) for k, r in enumerate(SEARCHES)])
    return rows.select("id", J.direct_search(F.col("intent"), F.col("page")).alias("d")).select("id", "d.site", "d.query", "d.url", "d.task_complete")


TABS = [("close all tabs except this tab", "all_except_current", "", None, None), ("close all other tabs but keep the current tab, not pinned", "all_unpinned_except_current", "", None, None), ("close tabs 3 to 7", "tab_range", "", 3, 7), ("remove tabs 5, 2 and 5", "tab_numbers", "2,5", None, None), ("open a tab", None, None, None, None), ("close the window", None, None, None, None)]


@query("SELECT id, CAST(scope AS VARCHAR) AS scope, CAST(numbers AS VARCHAR) AS numbers, CAST(first AS INT) AS first, CAST(last AS INT) AS last FROM " + values([(k, *r[1:]) for k, r in enumerate(TABS)]) + " AS v(id, scope, numbers, first, last)")
def n2_tab_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "id int, intent string", [(k, r[0]) for k, r in enumerate(TABS)])
    return rows.select("id", J.tab_command(F.col("intent")).alias("t")).select("id", "t.scope", F.when(F.col("t").isNotNull(), F.array_join(F.col("t.numbers").cast("array<string>"), ",")).alias("numbers"), F.col("t.start").alias("first"), F.col("t.end").alias("last"))


CONT = "go\n\nAGENT CONTINUATION: x"
STALE = [
    ("go", "https://www.google.com/search?q=a", "", '{"tasks": [{"action": "type"}]}', None), (CONT, "https://www.google.com/search?q=a", "", '{"tasks": [{"action": "type"}]}', "ALREADY_ON_RESULTS"), (CONT, "https://www.google.com/search?q=a", "", '{"tasks": [{"action": "click", "description": "Open result"}]}', None),
    (CONT, "https://mail.google.com/u/0", "New Message", '{"tasks": [{"action": "navigate"}]}', "COMPOSER_OPEN"), (CONT, "https://mail.google.com/u/0", "New Message", '{"tasks": [{"action": "key", "key": "Tab"}]}', "COMPOSER_NEEDS_TYPE"), (CONT, "https://mail.google.com/u/0", "New Message", '{"tasks": [{"action": "type"}]}', None),
]


@query(f"SELECT id, error FROM {values([(k, r[4]) for k, r in enumerate(STALE)])} AS v(id, error)")
def n3_stale_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "id int, intent string, page string, visible string, plan string", [(k, *r[:4]) for k, r in enumerate(STALE)])
    return rows.select("id", J.stale_plan(*[F.col(c) for c in ("intent", "page", "visible", "plan")]).alias("error"))


FRESH = [('{"tasks": [{"action": "click"}], "task_complete": false}', True), ('{"tasks": [{"action": "navigate", "url": "https://www.google.com/search?q=1"}]}', True), ('{"tasks": [{"action": "key", "key": "Enter"}], "task_complete": true}', True), ('{"tasks": [{"action": "click"}], "task_complete": true}', False), ('{"tasks": [{"action": "click"}, {"action": "key", "key": "Enter"}], "task_complete": false}', False), ("{}", False)]


@query(f"SELECT id, fresh FROM {values([(k, f) for k, (_, f) in enumerate(FRESH)])} AS v(id, fresh)")
def n4_needs_fresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rows_of(spark, "id int, plan string", [(k, p) for k, (p, _) in enumerate(FRESH)])
    return rows.select("id", J.needs_fresh_plan(F.col("plan")).alias("fresh"))


PROSE = "word " * 20
TYPED = [("search mail", PROSE, "ed", "ed"), ("search mail", "short", "ed", "planned"), ("subject", PROSE, "ed", "planned"), ("search mail", PROSE, None, "planned")]


@query(f"SELECT id, target FROM {values([(k, r[3]) for k, r in enumerate(TYPED)])} AS v(id, target)")
def n5_type_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long prose planned for a search box goes to the first editor, if there is one."""
    rows = rows_of(spark, "id int, descriptor string, value string, editor string", [(k, *r[:3]) for k, r in enumerate(TYPED)])
    return rows.select("id", type_target().alias("target"))


def type_target():
    prose = (F.length("value") > 80) & F.col("value").rlike(r"\s") & F.lower("descriptor").contains("search")
    return F.when(prose & F.col("editor").isNotNull(), F.col("editor")).otherwise("planned")


STATES = [(1, '{"interactiveElements": [{"a": 1}, {"a": 2}], "forms": [], "privacy": {"sanitized": true, "rawScreenshotIncluded": false, "redactedRegionCount": 3}}'), (2, '{"visualText": [1, 2, 3], "privacy": {"sanitized": false}}'), (3, "not json")]


@query("SELECT * FROM (VALUES (1, 2, 0, 0, 3), (2, 0, 0, 3, 0), (3, 0, 0, 0, 0)) AS v(id, elements, forms, visual_text, redacted)")
def a8_receipt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, "id int, s string", STATES).select("id", *receipt_counts())


def receipt_counts() -> list:
    n = lambda p: F.coalesce(F.size(F.from_json(F.get_json_object("s", f"$.{p}"), "array<string>")), F.lit(0))
    return [n("interactiveElements").alias("elements"), n("forms").alias("forms"), n("visualText").alias("visual_text"), F.coalesce(F.get_json_object("s", "$.privacy.redactedRegionCount").try_cast("int"), F.lit(0)).alias("redacted")]


@query("SELECT * FROM (VALUES (1, 'OK'), (2, 'NOT_SANITIZED'), (3, 'INVALID_JSON')) AS v(id, status)")
def s10_ingest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, "id int, s string", STATES).select("id", state_status().alias("status"))


def state_status():
    return F.when(F.try_parse_json("s").isNull(), "INVALID_JSON").when(~J.privacy_gate(F.col("s")), "NOT_SANITIZED").when(J.contains_raw_pii(F.col("s")), "RAW_PII").otherwise("OK")


@query("SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(text) BETWEEN 1 AND 1000")
def s11_request_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter((F.col("role") == "user") & F.length("text").between(1, 1000)).select("conv_id", "turn")


@query("SELECT user_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END), max(CASE WHEN event_type = 'click' THEN event_id END), max(event_id)) AS chosen FROM events GROUP BY user_id")
def s14_tab_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of three levels in one aggregation."""
    of = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("event_id")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.coalesce(of("purchase"), of("click"), F.max("event_id")).alias("chosen"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS text_id FROM documents WHERE (doc_id % 100) / 100.0 >= 0.30 AND trim(text) <> ''")
def p15_confident_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    kept = table(spark, sf_dir, "documents").filter(((F.col("doc_id") % 100) / 100 >= 0.30) & (F.trim("text") != ""))
    return kept.select("doc_id", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("text_id"))


RECOGNISED = [(1, 1, "Email", 0.98), (1, 2, " ", 0.99), (1, 3, "low", 0.29), (1, 4, "just", 0.30), (1, 5, "none", None), (2, 1, "PIN", 0.51), (2, 2, None, 0.9), (2, 3, "ok", 1.0)]


@query("SELECT * FROM (VALUES (1, 'Email', 1), (1, 'just', 2), (2, 'PIN', 1), (2, 'ok', 2)) AS v(image_id, text, text_id)")
def p15_recognised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised texts by the confidence that came with them; no table has one."""
    from ..operators.vision import confident

    found = confident(rows_of(spark, "image_id int, ord int, text string, confidence double", RECOGNISED), "image_id", "ord")
    return found.select("image_id", "text", "text_id")


OCR = [(1, 1, "Email address", 10, 10, 110, 30), (1, 2, "rohan@mail.org", 130, 10, 300, 30), (1, 3, "Secret PIN", 10, 60, 90, 80), (1, 4, "hello", 10, 200, 60, 220)]
FIELDS = [(1, 1, 125, 5, 200, 30), (1, 2, 100, 55, 220, 30)]


@query("SELECT * FROM (VALUES (1, 1, 'EMAIL', 'LABEL_AND_UI_CONTEXT', 1), (1, 2, 'EMAIL', 'TEXT_PATTERN', NULL), (1, 3, 'PIN', 'LABEL_AND_UI_CONTEXT', 2), (1, 3, 'SECRET_KEY', 'LABEL_AND_UI_CONTEXT', 2)) AS v(image_id, text_id, type, detection_source, region)")
def m13_sensitive_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a picture from its text and region tables: labels with their nearest field, patterns, one of each place."""
    from ..operators.vision import sensitive_information

    texts = rows_of(spark, "image_id int, text_id int, text string, x1 int, y1 int, x2 int, y2 int", OCR)
    regions = rows_of(spark, "image_id int, region_id int, x int, y int, width int, height int", FIELDS)
    return sensitive_information(texts, regions, 640, 480).select("image_id", "text_id", "type", "detection_source", F.col("region_id").alias("region"))


@query("SELECT 1 AS image_id, 4 AS texts, 2 AS regions, 4 AS sensitive")
def a6_vision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = rows_of(spark, "image_id int, text_id int, text string, x1 int, y1 int, x2 int, y2 int", OCR)
    return vision_summary(texts, rows_of(spark, "image_id int, region_id int, x int, y int, width int, height int", FIELDS))


def vision_summary(texts: DataFrame, regions: DataFrame) -> DataFrame:
    """How many texts, regions and sensitive places a picture has."""
    from ..operators.vision import sensitive_information

    parts = [(texts, "texts"), (regions, "regions"), (sensitive_information(texts, regions, 640, 480), "sensitive")]
    ones = [d.select("image_id", *[F.lit(int(n == m)).alias(m) for _, m in parts]) for d, n in parts]
    return ones[0].unionByName(ones[1]).unionByName(ones[2]).groupBy("image_id").agg(*[F.sum(m).cast("int").alias(m) for _, m in parts])


@query("SELECT p_partkey AS id, least(200, 4 + 8 * length(p_name)) AS text_width FROM part")
def g12_text_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of an input's text by 8 pixels a character, inside the input."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.least(F.lit(200), 4 + 8 * F.length("p_name")).cast("long").alias("text_width"))


@query("SELECT * FROM (VALUES (1, 'FACE', 20, 40, 58, 48), (1, 'PERSON', 72, 40, 94, 28), (1, 'GOVERNMENT_ID', 66, 88, 96, 18), (2, 'ADDRESS', 18, 48, 116, 48), (2, 'GOVERNMENT_ID', 66, 96, 96, 14)) AS v(id, category, x, y, width, height)")
def t17_layout_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones of an identity card from its recognised words."""
    from ..operators.vision import card_zones

    rows = rows_of(spark, "id int, text string", [(1, "Government of India DOB 1.1.90 Male"), (2, "aadhaar address 560001"), (3, "shopping list")])
    target = G.rect(F.lit(10), F.lit(20), F.lit(200), F.lit(100))
    return rows.select("id", F.explode(card_zones(F.col("text"), target)).alias("z")).select("id", "z.category", "z.rect.*")
