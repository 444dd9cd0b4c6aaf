"""Page operators over derived pages with hidden parts, searches and several names, one page a customer, each beside SQL that works its rows
out from the customer's key without parsing a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import names
from ..sources import pages as P
from . import query, spread, table

# Elements by ord: 0 html, 1 head, 2 style, 3 body, 4 div, 5 button, 6 p, 7 input, 8 a.  Runs: 0 the sheet, 1 button, 2 p, 3 a.
WRAPPED = (
    "<html><head><style>/* sheet */ .gone, .x { display: none } #side > p { visibility: hidden } @media print { button { display: none } }</style></head><body>"
    '<div{wrap}><button>Go {m}</button><p{inner}>Call 9876543{three} now</p><input name="q" value="red"></div><a href="/x">Out</a></body></html>'
)
WRAPS = [' style="display:none"', " hidden", ' class="a gone"', ' style="visibility: hidden"', ' style="opacity:0"', ' id="side"', ' style="width: 0px"', ' class="gone" style="display: block"']
#: Whether an element (by ord) of a page of each kind is hidden.
HIDDEN = "CASE k % 8 WHEN 3 THEN ord IN (4, 5, 7) WHEN 4 THEN ord = 4 WHEN 5 THEN ord = 6 WHEN 6 THEN ord = 4 WHEN 7 THEN false ELSE ord BETWEEN 4 AND 7 END"
BASE = "(SELECT c_custkey AS page_id, c_custkey AS k, c_custkey % 100 AS m, CAST(100 + c_custkey % 900 AS VARCHAR) AS three FROM customer)"


def derived(spark: SparkSession, sf_dir: str, html: str, parts: dict) -> DataFrame:
    """page_id and html of a page for each customer, ``parts`` put in their places."""
    page = F.lit(html)
    for name, value in parts.items():
        page = F.replace(page, F.lit(f"{{{name}}}"), value)
    return spread(table(spark, sf_dir, "customer")).select(F.col("c_custkey").alias("page_id"), page.alias("html"))


def wrapped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    wrap = F.element_at(F.array(*map(F.lit, WRAPS)), (k % 8 + 1).cast("int"))
    inner = F.when(k % 8 == 3, ' style="visibility: visible"').otherwise("")
    return derived(spark, sf_dir, WRAPPED, {"wrap": wrap, "inner": inner, "m": (k % 100).cast("string"), "three": (100 + k % 900).cast("string")})


@query(f"""SELECT page_id, ord, tag, NOT {HIDDEN} AS visible FROM {BASE}, (SELECT unnest(range(9)) AS ord, unnest(['html', 'head', 'style', 'body', 'div', 'button', 'p', 'input', 'a']) AS tag)""")
def p1_inherited_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.elements(wrapped_pages(spark, sf_dir)).select("page_id", "ord", "tag", P.visible().alias("visible"))


@query(f"""SELECT page_id, 'element_' || row_number() OVER (PARTITION BY page_id ORDER BY ord) AS element_id, tag, CASE ord WHEN 5 THEN 'Go ' || m WHEN 7 THEN 'red' ELSE 'Out' END AS text FROM {BASE}, (VALUES (5, 'button'), (7, 'input'), (8, 'a')) AS v(ord, tag) WHERE NOT {HIDDEN}""")
def s1_unhidden_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_elements(wrapped_pages(spark, sf_dir)).select("page_id", "element_id", "tag", "text")


@query(f"""SELECT page_id, 2 AS ord, 'PHONE' AS category, '9876543' || three AS value, 5 AS "start", 15 AS "end" FROM (SELECT *, 6 AS ord FROM {BASE}) WHERE NOT {HIDDEN}""")
def s5_unhidden_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sensitive_text(wrapped_pages(spark, sf_dir)).select("page_id", "ord", "category", "value", "start", "end")


# Elements: 0 html, 1 body, 2 form, 3 input, 4 p, 5 div, 6 span, 7 script.  Runs: 0 p, 1 span, 2 script.
SEARCHED = (
    '<html><body><form><input type="search" name="q" value="{q}"{off}></form><p>{lead} won. max {last} again</p>'
    '<div style="display:none"><span>Max {Last} too</span></div><script>max {last}</script></body></html>'
)


@query("""WITH c AS (SELECT c_custkey AS page_id, c_custkey % 4 AS side FROM customer)
SELECT page_id, 'input' AS source, 3 AS ord, 1 AS times FROM c WHERE side < 2 UNION ALL SELECT page_id, 'text', 0, 2 FROM c WHERE side < 2""")
def j4_searched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name comes from the page's own search, whole or as its first two words, and differs from page to page."""
    k = F.col("c_custkey")
    last = F.concat(F.lit("verst"), F.translate((k % 100).cast("string"), "0123456789", "abcdefghij"))
    name = F.concat(F.lit("max "), last)
    parts = {
        "q": F.when(k % 4 == 0, name).otherwise(F.concat(name, F.lit(" red bull car"))), "off": F.when(k % 4 == 3, ' style="display: none"').otherwise(""),
        "lead": F.when(k % 4 == 2, "someone").otherwise(F.concat(F.lit("Max "), F.initcap(last))), "last": last, "Last": F.initcap(last),
    }
    return names.query_name_hits(derived(spark, sf_dir, SEARCHED, parts))


# Elements: 0 html, 1 body, 2 label, 3 input, 4 table, 5 tr, 6 td, 7 td, 8 p, 9 p.  Runs: 0 label, 1 td, 2 td, 3 p, 4 hidden p.
NAMED = (
    '<html><body><label>Full Name <input name="full_name" value="Rohan {one}"></label><table><tr><td>Account Holder</td><td>{two}</td></tr></table>'
    "<p>rohan {one} met {two}; ROHAN {one} and {two} Kumar left, xrohan {one} did not.</p><p hidden>Rohan {one}</p></body></html>"
)
#: Two names of a page; the second is in part the first.
ONE = "'Meh' || translate(CAST(k % 100 AS VARCHAR), '0123456789', 'abcdefghij')"
TWO = f"{ONE} || ' Rao'"


@query(f"""WITH p AS (SELECT page_id, 'Rohan ' || {ONE} AS a, {TWO} AS b FROM {BASE}),
t AS (SELECT page_id, a, b, lower(a) || ' met ' || b || '; ' || upper(left(a, 5)) || substr(a, 6) || ' and ' || b || ' Kumar left, xrohan' || substr(a, 6) || ' did not.' AS text FROM p),
w AS (SELECT *, length(a) + 5 AS s1, length(a) + 5 + length(b) + 2 AS s2, length(a) + 5 + length(b) + 2 + length(a) + 5 AS s3 FROM t)
SELECT page_id, 2 AS ord, b AS name, 0 AS "start", length(b) AS "end" FROM w
UNION ALL SELECT page_id, 3, a, 0, length(a) FROM w UNION ALL SELECT page_id, 3, b, s1, s1 + length(b) FROM w UNION ALL SELECT page_id, 3, a, s2, s2 + length(a) FROM w UNION ALL SELECT page_id, 3, b, s3, s3 + length(b) FROM w""")
def j3_page_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several names a page, from a field and from a row of a table, found wherever they stand."""
    k = F.col("c_custkey")
    one = F.concat(F.lit("Meh"), F.translate((k % 100).cast("string"), "0123456789", "abcdefghij"))
    return names.repeated_names(names.known_names(derived(spark, sf_dir, NAMED, {"one": one, "two": F.concat(one, F.lit(" Rao"))})))
