"""Page operators over form pages derived from customer, one page a row, each beside SQL that works its rows out from the same
arithmetic without parsing a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text, urls
from ..operators import ranking
from ..operators.names import count_name, person_query
from ..operators.vision import card_zones
from ..sources import pages as P
from . import page_queries, query, spread, table

# Elements by ord: 0 html, 1 head, 2 title, 3 body, 4 form, 5 label, 6 input, 7 label, 8 input, 9 input, 10 input, 11 textarea, 12 button,
# 13 p, 14 script, 15 a, 16 div, 17 p.  {k} is the customer's key and {m} its last two digits.
PAGE = (
    '<html><head><title>Account {m}</title></head><body><form name="f{m}"><label for="em{k}">Email</label><input id="em{k}" name="email" type="email" value="user{k}@mail.com">'
    '<label>Colour <input name="colour" placeholder="Your colour" value="{colour}"{off}></label><input type="hidden" name="h" value="9876543210">'
    '<input id="pw{k}" type="password" name="pw" value="{pass}" aria-label="Secret"><textarea name="note"{style}>Note {m}</textarea><button title="Send it">Send {m}</button></form>'
    '<p>Call 9876543{three} now</p><script>var a = "x{k}@y.org";</script><a href="https://host.org/p?q={m}" role="link">Link {m}</a>'
    '<div role="button" contenteditable="true">Edit {m}</div><p>Then Rohan Mehta {end}</p></body></html>'
)
#: The customer's key, its last two digits, and what varies with them.
BASE = """(SELECT c_custkey AS page_id, c_custkey AS k, c_custkey % 100 AS m, CASE WHEN c_custkey % 2 = 0 THEN 'red' ELSE 'blue' END AS colour, CASE WHEN c_custkey % 2 = 0 THEN 'pass1' ELSE '' END AS pass,
c_custkey % 3 = 1 AS hidden, c_custkey % 3 = 0 AS off, CAST(100 + c_custkey % 900 AS VARCHAR) AS three, CASE WHEN c_custkey % 4 = 0 THEN 'met rohan mehta' ELSE 'left' END AS ending FROM customer)"""


def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html of a page for each customer."""
    k = F.col("c_custkey")
    s = lambda c: c.cast("string")
    parts = {
        "{k}": s(k), "{m}": s(k % 100), "{colour}": F.when(k % 2 == 0, "red").otherwise("blue"), "{pass}": F.when(k % 2 == 0, "pass1").otherwise(""), "{off}": F.when(k % 3 == 0, " disabled").otherwise(""),
        "{style}": F.when(k % 3 == 1, ' style="display: none"').otherwise(""), "{three}": s(100 + k % 900), "{end}": F.when(k % 4 == 0, "met rohan mehta").otherwise("left"),
    }
    html = F.lit(PAGE)
    for name, value in parts.items():
        html = F.replace(html, F.lit(name), value)
    return spread(table(spark, sf_dir, "customer")).select(k.alias("page_id"), F.concat(F.lit("https://host.org/"), s(k), F.lit("?a=b")).alias("url"), html.alias("html"))


#: The elements that a scan looks at, numbered among the visible ones of their page.
SCANNED = f"""(SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS n FROM (SELECT b.*, v.* FROM {BASE} b, (VALUES (6, 'input'), (8, 'input'), (9, 'input'), (10, 'input'), (11, 'textarea'), (12, 'button'), (15, 'a'), (16, 'div')) AS v(ord, tag))
WHERE ord <> 9 AND NOT (ord = 11 AND hidden))"""
TEXT = "CASE ord WHEN 6 THEN 'user' || k || '@mail.com' WHEN 8 THEN colour WHEN 10 THEN pass WHEN 11 THEN 'Note ' || m WHEN 12 THEN 'Send ' || m WHEN 15 THEN 'Link ' || m ELSE 'Edit ' || m END"
LABEL = "CASE ord WHEN 6 THEN 'Email' WHEN 8 THEN 'Colour' ELSE '' END"


@query(f"""SELECT page_id, 'element_' || n AS element_id, tag, CASE tag WHEN 'a' THEN 'link' ELSE tag END AS category, CASE ord WHEN 15 THEN 'link' WHEN 16 THEN 'button' END AS role, CASE ord WHEN 6 THEN '<EMAIL_1>' ELSE {TEXT} END AS text,
CASE ord WHEN 8 THEN 'Your colour' ELSE '' END AS placeholder, CASE ord WHEN 10 THEN 'Secret' WHEN 12 THEN 'Send it' ELSE '' END AS label, CASE ord WHEN 15 THEN 'https://host.org/p' END AS href, ord = 8 AND off AS disabled FROM {SCANNED}""")
def s2_form_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.runtime_elements(form_pages(spark, sf_dir))


@query(f"""SELECT page_id, 'form_1' AS form_id, 'f' || any_value(m) AS form_name, '[' || string_agg('{{"j":' || n || ',"control_id":"form_1_control_' || n || '","tag":"' || tag || '",' || CASE ord WHEN 6 THEN '"type":"email",' WHEN 10 THEN '"type":"password",' ELSE '' END
|| CASE ord WHEN 6 THEN '"name":"email",' WHEN 8 THEN '"name":"colour",' WHEN 10 THEN '"name":"pw",' WHEN 11 THEN '"name":"note",' ELSE '' END || '"label":"' || {LABEL} || '"' || CASE ord WHEN 8 THEN ',"placeholder":"Your colour"' ELSE '' END || '}}', ',' ORDER BY n) || ']' AS controls
FROM {SCANNED} WHERE ord <= 12 GROUP BY page_id""")
def s4_form_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.forms(form_pages(spark, sf_dir)).select("page_id", "form_id", "form_name", F.to_json("controls").alias("controls"))


@query(f"""SELECT page_id, 5 AS ord, 'text' AS source, 'p' AS tag, 'PHONE' AS category, 'HIGH' AS severity, '9876543' || three AS value, 5 AS "start", 15 AS "end" FROM {BASE}""")
def s5_form_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sensitive_text(form_pages(spark, sf_dir))


@query(f"""SELECT page_id, 'https://host.org/' || k AS url, length('EmailColour Note ' || m || ' Send ' || m || ' Call 9876543' || three || ' now Link ' || m || ' Edit ' || m || ' Then Rohan Mehta ' || ending) + 1 AS text_chars, CASE WHEN hidden THEN 6 ELSE 7 END AS elements, CASE WHEN hidden THEN 6 ELSE 7 END AS interactive, 1 AS detections, 'PHONE' AS categories FROM {BASE}""")
def s6_form_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_queries.context_of(form_pages(spark, sf_dir))


@query(f"""SELECT page_id, ord, tag, NOT (ord = 9 OR (ord = 11 AND hidden)) AS visible FROM {BASE}, (SELECT unnest(range(18)) AS ord, unnest(['html', 'head', 'title', 'body', 'form', 'label', 'input', 'label', 'input', 'input', 'input', 'textarea', 'button', 'p', 'script', 'a', 'div', 'p']) AS tag)""")
def p1_form_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.elements(form_pages(spark, sf_dir)).select("page_id", "ord", "tag", P.visible().alias("visible"))


@query(f"""SELECT page_id, ord, tag, CASE ord WHEN 9 THEN '9876543210' WHEN 10 THEN 'Secret' WHEN 12 THEN 'Send it' ELSE {TEXT} END AS name FROM {BASE}, (VALUES (6, 'input'), (8, 'input'), (9, 'input'), (10, 'input'), (11, 'textarea'), (12, 'button'), (15, 'a'), (16, 'div')) AS v(ord, tag)""")
def p4_form_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.elements(form_pages(spark, sf_dir)).filter(P.selected()).select("page_id", "ord", "tag", P.accessible_name().alias("name"))


@query(f"""SELECT page_id, ord, tag, 'input' AS source, category, severity FROM {BASE}, (VALUES (6, 'input', 'EMAIL', 'HIGH'), (10, 'input', 'PASSWORD', 'CRITICAL')) AS v(ord, tag, category, severity) WHERE ord = 6 OR pass <> ''""")
def p5_form_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sensitive_inputs(form_pages(spark, sf_dir)).drop("reason")


@query(f"""SELECT page_id, 'element_' || n AS element_id, tag, {LABEL} AS label, {TEXT} AS text FROM {SCANNED}""")
def j1_form_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_elements(form_pages(spark, sf_dir)).select("page_id", "element_id", "tag", "label", "text")


@query(f"""SELECT page_id, 9 AS ord, CASE WHEN k % 4 = 0 THEN 2 ELSE 1 END AS times FROM {BASE}""")
def j4_form_name_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = P.text_runs(form_pages(spark, sf_dir))
    return runs.select("page_id", "ord", count_name(F.col("text"), F.lit("rohan mehta")).alias("times")).filter("times > 0")


@query(f"""SELECT page_id, 'element_' || n AS element_id, CASE WHEN ord IN (6, 10) THEN '[REDACTED]' ELSE {TEXT} END AS text, {LABEL} AS label, CASE ord WHEN 8 THEN 'Your colour' ELSE '' END AS placeholder FROM {SCANNED}""")
def t6_form_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_queries.sanitized_elements(form_pages(spark, sf_dir))


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'max verstappen' WHEN 1 THEN 'max verstappen' END AS person FROM customer""")
def t9_customer_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    q = F.when(k == 0, "max verstappen").when(k < 3, "max verstappen red bull car").otherwise("shoes")
    page = F.when(k == 1, "News: Max Verstappen wins").otherwise("max verstappen loses")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), person_query(q, page).alias("person"))


@query("""SELECT c_custkey AS id, c_custkey % 4 = 0 AS identity FROM customer""")
def p23_customer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, own = F.col("c_custkey"), F.concat(F.lit("https://github.com/u"), F.col("c_custkey").cast("string"))
    link = F.when(k % 4 == 0, F.concat(own, F.lit("/?tab=stars"))).when(k % 4 == 1, F.concat(own, F.lit("/repo"))).when(k % 4 == 2, F.replace(own, F.lit("github.com"), F.lit("x.org"))).otherwise(F.lit("https://github.com/"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), urls.profile_identity(own, link).alias("identity"))


@query("""SELECT c_custkey AS id, category, x, y, width, height FROM customer, (VALUES (0, 'FACE', 20, 40, 58, 48), (0, 'PERSON', 72, 40, 94, 28), (0, 'GOVERNMENT_ID', 66, 88, 96, 18), (1, 'ADDRESS', 18, 48, 116, 48), (1, 'GOVERNMENT_ID', 66, 96, 96, 14)) AS v(side, category, x, y, width, height) WHERE c_custkey % 3 = side""")
def t17_customer_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    words = F.when(k % 3 == 0, F.concat(F.lit("Government of India DOB 1.1."), (k % 90).cast("string"))).when(k % 3 == 1, F.concat(F.lit("aadhaar address "), (k % 1000).cast("string"))).otherwise("shopping list with an address")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.explode(card_zones(words, G.rect(F.lit(10), F.lit(20), F.lit(200), F.lit(100)))).alias("z"))
    return rows.select("id", "z.category", "z.rect.*")


@query("""SELECT c_custkey AS id, c_custkey % 5 IN (0, 2) AS raw_pii FROM customer""")
def t15_customer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.json_plans import contains_raw_pii

    k = F.col("c_custkey")
    s = (k % 1000).cast("string")
    j = (
        F.when(k % 5 == 0, F.concat(F.lit('{"a": {"b": [1, {"c": "mail u'), s, F.lit('@y.org"}]}}')))
        .when(k % 5 == 1, F.concat(F.lit('{"u'), s, F.lit('@y.org": 1, "z": ["plain '), s, F.lit('"]}')))
        .when(k % 5 == 2, F.concat(F.lit('[[["9876543'), (100 + k % 900).cast("string"), F.lit('"]]]')))
        .when(k % 5 == 3, F.concat(F.lit("not json u"), s, F.lit("@y.org")))
        .otherwise(F.concat(F.lit('{"n": "plain '), s, F.lit('"}')))
    )
    return table(spark, sf_dir, "customer").select(k.alias("id"), contains_raw_pii(j).alias("raw_pii"))


@query("""SELECT c_custkey AS page_id, 1 AS new, 22 AS score FROM customer WHERE c_custkey % 3 = 0""")
def j9_page_rebind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lost element of each page bound anew among the page's elements: a winner, a tie, or too few points."""
    k, m = F.col("c_custkey"), (F.col("c_custkey") % 100).cast("string")
    terms = lambda *t: F.array(*[F.concat(F.lit(x), m) if x.endswith(" ") else F.lit(x) for x in t])
    old = table(spark, sf_dir, "customer").select(k.alias("page_id"), F.lit("input").alias("tag"), F.lit("textbox").alias("role"), terms("mail ", "mail").alias("terms"))
    one = lambda n, tag, role, t: F.struct(F.lit(n).alias("new"), F.lit(tag).alias("tag"), F.lit(role).alias("role"), t.alias("terms"))
    first = one(1, "input", "textbox", F.when(k % 3 == 2, terms("new mail")).otherwise(terms("mail ")))
    second = one(2, "input", "textbox", F.when(k % 3 == 1, terms("mail ")).otherwise(terms("other")))
    new = table(spark, sf_dir, "customer").select(k.alias("page_id"), F.explode(F.array(first, second, one(3, "a", None, terms("profile")))).alias("n")).select("page_id", "n.*")
    return page_queries.rebound(old, new)


@query("""SELECT c_custkey AS id, 'click' AS action, CASE WHEN c_custkey % 3 <> 1 THEN 'e' || c_custkey END AS element_id, CASE WHEN c_custkey % 3 <> 0 THEN '#s' || c_custkey END AS selector FROM customer WHERE c_custkey % 5 <> 0""")
def f4_customer_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import json_plans as J

    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    element, selector = F.concat(F.lit('"elementId": "e'), s, F.lit('"')), F.concat(F.lit('"selector": "#s'), s, F.lit('"'))
    target = F.when(k % 5 == 0, F.lit('"e1"')).otherwise(F.concat(F.lit("{"), F.when(k % 3 == 0, element).when(k % 3 == 1, selector).otherwise(F.concat_ws(", ", element, selector)), F.lit("}")))
    raw = F.concat(F.lit('Plan: {"tasks": [{"action": "click", "target": '), target, F.lit("}]} done"))
    p = spread(table(spark, sf_dir, "customer").select("c_custkey")).select(k.alias("id"), J.parse_plan(raw, F.lit("do it")).alias("p")).filter("p.error IS NULL").select("id", F.explode("p.steps").alias("t"))
    return p.select("id", F.get_json_object("t", "$.action").alias("action"), F.get_json_object("t", "$.target.elementId").alias("element_id"), F.get_json_object("t", "$.target.selector").alias("selector"))


@query("""SELECT conv_id, turn, '[{"role":"system","content":"You plan browser steps."},{"role":"user","content":' || CAST(to_json(text) AS VARCHAR) || '}]' AS messages FROM conversations""")
def f15_turn_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.prompts import messages

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(messages(F.lit("You plan browser steps."), F.col("text"))).alias("messages"))
