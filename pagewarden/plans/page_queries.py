"""Queries of page scans, projections, URLs and element ranking, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text, urls
from ..operators import ranking
from ..sources import pages as P
from . import query, rows_of, spread, table
from .text_queries import quoted, sql_classify, sql_collapse, sql_replaced

SELECTED = r"<(button|input|textarea|select|a|h[1-6])[ >]"

# A page with forms, labels, inputs and hidden parts, which the tables lack; all values are made up.
FORM_PAGE = """<html><head><title>Sign up</title></head><body><form name="f1"><label for="em">Email</label><input id="em" name="email" type="email" value="a@b.com" autocomplete="email">
<label>Full Name <input name="full_name" value="Rohan Mehta"></label><input type="hidden" name="h" value="9876543210"><input name="color" placeholder="Favourite color" value="red">
<label for="pw">Password</label><input id="pw" type="password" value=""><button title="Send it">Send</button></form><form><select name="s" aria-label="Pick"></select><textarea name="note" style="display: none">x</textarea></form>
<p>Full Name: Rohan Mehta called 9876543210. <a href="https://u:p@host.org/prof?x=1#y">Profile</a></p><table><tr><td>Account Holder</td><td>Max Power</td></tr></table><div role="button" contenteditable="true">Edit</div><p>Then Rohan Mehta left; rohan mehta again.</p></body></html>"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"))


def form_page(spark: SparkSession) -> DataFrame:
    return rows_of(spark, "page_id long, url string, html string", [(1, "https://host.org/a?b=c", FORM_PAGE)])


def every_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of pages and the form page, whose id is -1 here as the table has a page 1."""
    return pages(spark, sf_dir).select("page_id", "url", "html").unionByName(form_page(spark).withColumn("page_id", F.lit(-1).cast("long")))


@query(f"SELECT page_id, 'element_' || i AS element_id, tag, CASE WHEN tag = 'a' THEN 'link' WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' ELSE tag END AS category FROM (SELECT page_id, unnest(regexp_extract_all(html, {quoted(SELECTED)}, 1)) AS tag, generate_subscripts(regexp_extract_all(html, {quoted(SELECTED)}, 1), 1) AS i FROM pages)")
def s1_page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_elements(pages(spark, sf_dir)).select("page_id", "element_id", "tag", "category")


@query()
def s2_runtime_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.runtime_elements(pages(spark, sf_dir).unionByName(form_page(spark).withColumn("page_id", F.lit(-1).cast("long"))))


def sql_visible(value: str) -> str:
    for pattern, to in P.VISIBLE_STEPS:
        value = f"regexp_replace({value}, {quoted(pattern)}, {quoted(to)}, 'g')"
    for entity, to in P.ENTITIES:
        value = f"replace({value}, {quoted(entity)}, {quoted(to)})"
    return f"substr({sql_collapse(value)}, 1, 10000)"


@query(f"SELECT page_id, {sql_visible('html')} AS visible_text FROM pages")
def s3_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", P.visible_text(F.col("html")).alias("visible_text"))


@query()
def s4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.forms(every_page(spark, sf_dir)).select("page_id", "form_id", "form_name", F.to_json("controls").alias("controls"))


@query()
def s5_sensitive_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sensitive_text(pages(spark, sf_dir).unionByName(form_page(spark)))


@query()
def s6_page_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page: clean url, visible text length, elements, interactive elements, detections of every kind."""
    return context_of(pages(spark, sf_dir))


def context_of(p: DataFrame) -> DataFrame:
    rows = p.select("page_id", urls.sanitize_url(F.col("url")).alias("url"), F.length(P.visible_text(F.col("html"))).alias("text_chars")).join(P.page_context(p), "page_id", "left")
    return rows.select("page_id", "url", "text_chars", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("elements", "interactive", "detections")], F.coalesce(F.array_join("categories", ","), F.lit("")).alias("categories"))


@query()
def p1_visible_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.elements(every_page(spark, sf_dir)).select("page_id", "ord", "tag", P.visible().alias("visible"))


@query("SELECT tag, CASE WHEN tag IN ('button', 'input', 'textarea', 'select') THEN tag WHEN tag = 'a' THEN 'link' WHEN editable THEN 'contenteditable' WHEN regexp_matches(tag, '^h[1-6]$') THEN 'heading' ELSE tag END AS category FROM (VALUES ('button', false), ('input', true), ('textarea', false), ('select', false), ('a', true), ('h1', true), ('h3', false), ('div', true), ('h7', false), ('p', false)) AS v(tag, editable)")
def p2_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("button", {}), ("input", {"contenteditable": "true"}), ("textarea", {}), ("select", {}), ("a", {"contenteditable": "true"}), ("h1", {"contenteditable": "true"}), ("h3", {}), ("div", {"contenteditable": "true"}), ("h7", {}), ("p", {})]
    return rows_of(spark, "tag string, attrs map<string,string>", rows).select("tag", P.category().alias("category"))


@query(f"SELECT page_id, count(*) FILTER (WHERE tag NOT LIKE 'h%') AS interactive, count(*) AS elements FROM (SELECT page_id, unnest(regexp_extract_all(html, {quoted(SELECTED)}, 1)) AS tag FROM pages) GROUP BY page_id")
def p3_interactive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_elements(pages(spark, sf_dir)).groupBy("page_id").agg(F.count_if(P.interactive()).alias("interactive"), F.count("*").alias("elements"))


@query()
def p4_accessible_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.elements(every_page(spark, sf_dir)).filter(P.selected()).select("page_id", "ord", "tag", P.accessible_name().alias("name"))


@query()
def p5_sensitive_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sensitive_inputs(every_page(spark, sf_dir))


@query()
def j1_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_elements(every_page(spark, sf_dir)).select("page_id", "element_id", "tag", "label", "text")


@query("SELECT page_id, CASE WHEN visible <> '' AND NOT regexp_matches(html, '(?i)<(canvas|svg|video|iframe|object|embed|img)[ />]') THEN 'DOM_ONLY' ELSE 'DOM + SCREENSHOT' END AS route FROM (SELECT page_id, html, " + sql_visible("html") + " AS visible FROM pages UNION ALL SELECT -1, '<body><p>x</p><img src=a></body>', 'x' UNION ALL SELECT -2, '<body></body>', '')")
def p19_context_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = rows_of(spark, "page_id long, html string", [(-1, "<body><p>x</p><img src=a></body>"), (-2, "<body></body>")])
    rows = pages(spark, sf_dir).select("page_id", "html").unionByName(more)
    return rows.select("page_id", P.context_route(P.visible_text(F.col("html")), F.col("html")).alias("route"))


URLS = ["https://u:p@host.org/a/b?x=1#y", "http://host.org", "not a url", "chrome://settings/x", "file:///tmp/x", "https://www.youtube.com/results?search_query=a", "https://www.google.co.in/search?q=1", "https://github.com/search?q=1", "https://en.wikipedia.org/w/index.php?search=x", "https://www.amazon.in/s?k=1", "https://en.wikipedia.org/wiki/Special:search", ""]
URL_ROWS = f"(SELECT page_id AS id, url FROM pages UNION ALL SELECT -1 - v.id, v.url FROM (VALUES {', '.join(f'({k}, {quoted(u)})' for k, u in enumerate(URLS))}) AS v(id, url))"


def url_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = rows_of(spark, "id long, url string", [(-1 - k, u) for k, u in enumerate(URLS)])
    return pages(spark, sf_dir).select(F.col("page_id").alias("id"), "url").unionByName(more)


@query(rf"""SELECT id, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+') THEN CASE WHEN regexp_matches(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/]+$') THEN bare || '/' ELSE bare END ELSE '<URL_REDACTED>' END AS url FROM (SELECT id, url, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://)[^/@]*@', '\1') AS bare FROM {URL_ROWS})""")
def t7_sanitize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rows(spark, sf_dir).select("id", urls.sanitize_url(F.col("url")).alias("url"))


@query(f"SELECT id, regexp_matches(url, '^(https?|file):') AS injectable FROM {URL_ROWS}")
def p21_injectable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rows(spark, sf_dir).select("id", urls.injectable(F.col("url")).alias("injectable"))


@query(f"""SELECT id, host, path, CASE WHEN contains(host, 'youtube.com') AND starts_with(path, '/results') THEN 'youtube' WHEN contains(host, 'google.') AND starts_with(path, '/search') THEN 'google' WHEN contains(host, 'github.com') AND starts_with(path, '/search') THEN 'github' WHEN contains(host, 'wikipedia.org') AND contains(path, 'search') THEN 'wikipedia' WHEN contains(host, 'amazon.') AND starts_with(path, '/s') THEN 'amazon' END AS site
FROM (SELECT id, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', '') AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM {URL_ROWS})""")
def f8_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return url_rows(spark, sf_dir).select("id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.results_site(u).alias("site"))


@query("""SELECT conv_id, site, CASE site WHEN 'youtube' THEN 'https://www.youtube.com/results?search_query=' || q WHEN 'google' THEN 'https://www.google.com/search?q=' || q WHEN 'github' THEN 'https://github.com/search?q=' || q || '&type=repositories' WHEN 'wikipedia' THEN 'https://en.wikipedia.org/w/index.php?search=' || q WHEN 'amazon' THEN 'https://www.amazon.in/s?k=' || q END AS url
FROM (SELECT conv_id, replace(url_encode(split_part(text, ' ', 1) || ' ' || role), '%20', '+') AS q FROM conversations WHERE turn = 0) c, (VALUES ('youtube'), ('google'), ('github'), ('wikipedia'), ('amazon'), ('other')) AS s(site)""")
def f9_search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "conversations").filter("turn = 0").select("conv_id", F.concat(F.split_part("text", F.lit(" "), F.lit(1)), F.lit(" "), "role").alias("q"))
    sites = F.explode(F.array(*[F.lit(s) for s in ("youtube", "google", "github", "wikipedia", "amazon", "other")])).alias("site")
    return own.select("conv_id", "q", sites).select("conv_id", "site", urls.search_url(F.col("site"), F.col("q")).alias("url"))


LINKS = [(1, "https://github.com/me", "https://github.com/me"), (2, "https://github.com/me", "https://github.com/me/repo"), (3, "https://github.com/me", "https://x.org/me"), (4, "https://github.com/", "https://github.com/")]


@query("SELECT * FROM (VALUES (1, true), (2, false), (3, false), (4, false)) AS v(id, identity)")
def p23_profile_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(spark, "id int, page string, link string", LINKS).select("id", urls.profile_identity(F.col("page"), F.col("link")).alias("identity"))


ITEMS = "(SELECT p_partkey AS ord, p_partkey % 50 AS page_id, p_name AS text, p_type AS label, p_brand AS name, CASE WHEN p_size % 4 = 0 THEN 'button' WHEN p_size % 4 = 1 THEN 'input' ELSE 'link' END AS category, p_size % 10 = 3 AS disabled FROM part)"
TOKENS = ["steel", "brass", "small", "part", "4"]
SCORE = "4 * (" + " + ".join(f"CAST(contains(lower(text || ' ' || label || ' ' || name || ' ' || category), {quoted(t)}) AS INT)" for t in TOKENS) + ") - CASE WHEN disabled THEN 100 ELSE 0 END + CASE WHEN category IN ('button', 'input', 'textarea', 'contenteditable') THEN 1 ELSE 0 END"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size") % 4
    category = F.when(s == 0, "button").when(s == 1, "input").otherwise("link")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), (F.col("p_partkey") % 50).alias("page_id"), F.col("p_name").alias("text"), F.col("p_type").alias("label"), F.col("p_brand").alias("name"), category.alias("category"), (F.col("p_size") % 10 == 3).alias("disabled"))


def relevance(tokens: list[str]):
    hay = F.lower(F.concat_ws(" ", "text", "label", "name", "category"))
    hits = F.lit(0)
    for t in tokens:
        hits = hits + F.contains(hay, F.lit(t)).cast("int")
    return 4 * hits - F.when(F.col("disabled"), 100).otherwise(0) + F.when(F.col("category").isin("button", "input", "textarea", "contenteditable"), 1).otherwise(0)


@query(f"SELECT ord, CAST({SCORE} AS INT) AS score FROM {ITEMS}")
def a5_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("ord", relevance(TOKENS).cast("int").alias("score"))


@query(f"SELECT page_id, ord, score, rank FROM (SELECT page_id, ord, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, ord) AS rank FROM (SELECT page_id, ord, CAST({SCORE} AS INT) AS score FROM {ITEMS})) WHERE rank <= 16")
def o2_top_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = items(spark, sf_dir).select("page_id", "ord", relevance(TOKENS).cast("int").alias("score"))
    return ranking.top(scored, ["page_id"], [F.col("score").desc(), F.col("ord")], 16)


@query(f"SELECT page_id, least(16, count(*)) AS elements_sent, count(*) AS elements_available, least(800, CAST(sum(length(text)) AS BIGINT)) AS text_chars_sent, CAST(sum(length(text)) AS BIGINT) AS text_chars_available FROM {ITEMS} GROUP BY page_id")
def a7_budget_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, chars = F.count("*"), F.sum(F.length("text"))
    return items(spark, sf_dir).groupBy("page_id").agg(F.least(F.lit(16), n).alias("elements_sent"), n.alias("elements_available"), F.least(F.lit(800), chars).alias("text_chars_sent"), chars.alias("text_chars_available"))


@query(f"SELECT ord, CASE WHEN length(text) <= 12 THEN text ELSE substr(text, 1, 12) || '... [truncated]' END AS text, nullif(CASE WHEN length(label) <= 8 THEN label ELSE substr(label, 1, 8) || '... [truncated]' END, '') AS label, disabled, category = 'input' AS editable FROM {ITEMS}")
def p10_prompt_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("ord", text.truncate(F.col("text"), 12).alias("text"), text.truthy(text.truncate(F.col("label"), 8)).alias("label"), "disabled", (F.col("category") == "input").alias("editable"))


@query(f"SELECT page_id, count(*) FILTER (WHERE rn <= 60) AS elements, bool_or(disabled) AS any_disabled, bool_and(category <> 'x') AS none_x FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS rn FROM {ITEMS}) GROUP BY page_id")
def a3_exists_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).groupBy("page_id").agg(F.least(F.count("*"), F.lit(60)).alias("elements"), F.bool_or("disabled").alias("any_disabled"), F.bool_and(F.col("category") != "x").alias("none_x"))


@query(f"SELECT page_id, string_agg(category, ',' ORDER BY o) AS categories FROM (SELECT page_id, category, min(ord) AS o FROM {ITEMS} GROUP BY page_id, category) GROUP BY page_id")
def a4_distinct_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = items(spark, sf_dir).groupBy("page_id", "category").agg(F.min("ord").alias("o"))
    return first.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "category"))), lambda x: x["category"]), ",").alias("categories"))


@query(f"SELECT page_id, ord, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS n FROM {ITEMS}")
def w1_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("page_id", "ord", F.row_number().over(Window.partitionBy("page_id").orderBy("ord")).alias("n"))


@query(f"SELECT page_id, score, ord FROM (SELECT page_id, ord, score, rank() OVER (PARTITION BY page_id ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY page_id, score) AS n FROM (SELECT page_id, ord, CAST({SCORE} AS INT) AS score FROM {ITEMS})) WHERE r = 1 AND n = 1 AND score >= 5")
def w8_unique_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = items(spark, sf_dir).select("page_id", "ord", relevance(TOKENS).cast("int").alias("score"))
    return ranking.unique_winner(scored, ["page_id"], "score", 5)


@query(f"SELECT page_id, string_agg(ord, ',' ORDER BY ord) AS first_ids FROM (SELECT page_id, ord, row_number() OVER (PARTITION BY page_id ORDER BY ord) AS rn FROM {ITEMS}) WHERE rn <= 10 GROUP BY page_id")
def o4_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = ranking.top(items(spark, sf_dir).select("page_id", "ord"), ["page_id"], [F.col("ord")], 10)
    return first.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list("ord")).cast("array<string>"), ",").alias("first_ids"))


TARGETS = "(SELECT o_orderkey AS task, o_orderkey % 3000 AS element, (o_orderkey * 7) % 2500 AS cached FROM orders)"


@query(f"SELECT task, coalesce(a.p_partkey, b.p_partkey) AS resolved FROM {TARGETS} t LEFT JOIN part a ON a.p_partkey = t.element LEFT JOIN part b ON b.p_partkey = t.cached")
def j8_element_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named element if it is there, else the one remembered, else null; both lookups are equi joins."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), (F.col("o_orderkey") % 3000).alias("element"), (F.col("o_orderkey") * 7 % 2500).alias("cached"))
    ids = table(spark, sf_dir, "part").select("p_partkey")
    a, b = ids.withColumnRenamed("p_partkey", "element"), ids.withColumnRenamed("p_partkey", "cached")
    return t.join(a.withColumn("x", F.col("element")), "element", "left").join(b.withColumn("y", F.col("cached")), "cached", "left").select("task", F.coalesce("x", "y").alias("resolved"))


OLD = [("e1", "input", "textbox", ["to recipients", "to"]), ("e2", "button", None, ["send"]), ("e3", "a", None, ["profile"])]
NEW = [("n1", "input", "textbox", ["to recipients"]), ("n2", "button", None, ["send"]), ("n3", "button", None, ["send"]), ("n4", "a", None, ["my profile page"])]


def rebound(old: DataFrame, new: DataFrame) -> DataFrame:
    """page_id, new, score: the element (tag, role, terms) of a page that a lost one is bound to, by points for tag, role and terms; at
    least 12 and a unique winner.  Candidates are those of the lost element's page."""
    pairs = old.withColumnsRenamed({"tag": "otag", "role": "orole", "terms": "oterms"}).join(new, "page_id")
    exact = lambda t: F.array_contains("terms", t)
    partial = lambda t: F.exists("terms", lambda v: F.contains(v, t) | F.contains(t, v))
    points = F.aggregate("oterms", F.lit(0), lambda a, t: a + F.when(exact(t), 12).when(partial(t), 4).otherwise(0))
    scored = pairs.select("page_id", "new", (points + F.when(F.col("tag") == F.col("otag"), 3).otherwise(0) + F.when(F.col("role") == F.col("orole"), 3).otherwise(0)).alias("score"))
    return ranking.unique_winner(scored, ["page_id"], "score", 12)


@query("SELECT 'e1' AS id, 'n1' AS new, 22 AS score")
def j9_rebind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lost elements bound anew: points for tag, role and terms; at least 12 and a unique winner."""
    schema = "tag string, role string, terms array<string>"
    old, new = rows_of(spark, f"page_id string, {schema}", OLD), rows_of(spark, f"new string, {schema}", NEW)
    every = old.select("page_id").join(F.broadcast(new), F.lit(True))  # four literal rows
    return rebound(old, every).withColumnRenamed("page_id", "id")


def _points(term: str):
    return lambda w: F.when(w == term, 8).when(w.startswith(term[:3]) | F.startswith(F.lit(term), F.substring(w, 1, 3)), 4).otherwise(0)


WORDS = "regexp_extract_all(lower(p_name), '[a-z0-9]+')"


@query(f"""WITH t AS (SELECT unnest(['goldenrod', 'chartreuse', 'stee', 'part']) AS term), w AS (SELECT p_partkey, unnest({WORDS}) AS word FROM part),
s AS (SELECT p_partkey, term, max(CASE WHEN word = term THEN 8 WHEN starts_with(word, substr(term, 1, 3)) OR starts_with(term, substr(word, 1, 3)) THEN 4 ELSE 0 END) AS points FROM w, t GROUP BY p_partkey, term)
SELECT p_partkey, CAST(sum(points) AS BIGINT) AS score FROM s GROUP BY p_partkey HAVING sum(points) > 0""")
def j10_result_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles scored by query terms without a join: the few terms are literals, the best word of each counts."""
    words = F.regexp_extract_all(F.lower("p_name"), F.lit("[a-z0-9]+"), F.lit(0))
    total = F.lit(0)
    for t in ("goldenrod", "chartreuse", "stee", "part"):
        total = total + F.coalesce(F.array_max(F.transform(words, _points(t))), F.lit(0))
    return table(spark, sf_dir, "part").select("p_partkey", total.cast("long").alias("score")).filter("score > 0")


@query(f"SELECT page_id, score, ord FROM (SELECT *, rank() OVER (PARTITION BY page_id ORDER BY score DESC) AS r, count(*) OVER (PARTITION BY page_id, score) AS n FROM (SELECT page_id, ord, {' + '.join(f'CAST(contains(lower(text), {quoted(t)}) AS INT)' for t in ('part', '12', '7'))} AS score FROM {ITEMS})) WHERE r = 1 AND n = 1 AND score >= 2")
def j11_card_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.lit(0)
    for t in ("part", "12", "7"):
        score = score + F.contains(F.lower("text"), F.lit(t)).cast("int")
    return ranking.unique_winner(items(spark, sf_dir).select("page_id", "ord", score.alias("score")), ["page_id"], "score", 2)


NODES = [(1, 1, "Account Holder"), (1, 2, "Max Power"), (2, 1, "Passport: Z123"), (3, 1, "Bank Account Number"), (4, 1, "Email"), (4, 2, "x"), (4, 3, "me at home"), (5, 1, "hello"), (5, 2, "world")]


@query("SELECT * FROM (VALUES (1, 'PERSON', 'Max Power'), (2, 'GOVERNMENT_ID', 'Z123'), (4, 'EMAIL', 'me at home')) AS v(box, category, value)")
def j2_label_value_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.names import label_values

    return label_values(rows_of(spark, "box int, ord int, text string", NODES))


@query(f"""SELECT doc_id, name, len(regexp_extract_all(text, '(?i)\\b' || name || '\\b')) AS times FROM (SELECT doc_id, text, {sql_collapse("split_part(text, '.', 1)")} AS name FROM documents) WHERE regexp_matches(name, {quoted(rules.re2("^[A-Za-z][A-Za-z-]{1,}(?:" + chr(92) + "s+[A-Za-z][A-Za-z-]{1,}){1,3}$"))}) AND regexp_matches(name, '^[A-Za-z -]+$')""")
def j3_repeated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names harvested from each document's head, then found again in its text: scoped to the document, so no join."""
    from ..operators.names import count_name

    head = table(spark, sf_dir, "documents").select("doc_id", "text", text.person_name(F.split_part("text", F.lit("."), F.lit(1))).alias("name"))
    return head.filter(F.col("name").rlike("^[A-Za-z -]+$")).select("doc_id", "name", count_name(F.col("text"), F.col("name")).alias("times"))


@query()
def j4_query_name_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.names import count_name

    runs = P.text_runs(every_page(spark, sf_dir))
    return runs.select("page_id", "ord", count_name(F.col("text"), F.lit("rohan mehta")).alias("times")).filter("times > 0")


@query(f"""SELECT * FROM (VALUES (1, 'max verstappen'), (2, 'max verstappen'), (3, NULL), (4, NULL)) AS v(id, person) UNION ALL SELECT -1 - conv_id * 1000 - turn, CASE WHEN regexp_matches(q, '^[A-Za-z][A-Za-z''-]+( [A-Za-z][A-Za-z''-]+){{1,2}}$') THEN q END FROM (SELECT conv_id, turn, {sql_collapse('text')} AS q FROM conversations WHERE role = 'user')""")
def t9_person_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.names import person_query

    rows = [(1, "max verstappen", ""), (2, "max verstappen red bull car", "News: Max Verstappen wins"), (3, "max verstappen red bull car", "nothing"), (4, "shoes", "")]
    own = table(spark, sf_dir, "conversations").filter("role = 'user'").select((-1 - F.col("conv_id") * 1000 - F.col("turn")).cast("long").alias("id"), F.col("text").alias("q"), F.lit("").alias("page"))
    return rows_of(spark, "id long, q string, page string", rows).unionByName(own).select("id", person_query(F.col("q"), F.col("page")).alias("person"))


def sanitized_elements(p: DataFrame) -> DataFrame:
    """Fields of elements cleaned; the text of an element that classifies as sensitive is masked as a whole."""
    e = P.page_elements(p)
    metadata = F.concat_ws(" ", P.attribute("type"), P.attribute("name"), P.attribute("id"), P.attribute("autocomplete"), text.truthy(F.col("label")))
    hit = text.classify(metadata, P.attribute("value")).isNotNull() & F.col("tag").isin("input", "textarea")
    return e.select("page_id", "element_id", F.when(hit, "[REDACTED]").otherwise(text.sanitize(F.col("text"))).alias("text"), text.sanitize(F.col("label")).alias("label"), text.sanitize(P.attribute("placeholder")).alias("placeholder"))


@query()
def t6_sanitize_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitized_elements(form_page(spark).unionByName(pages(spark, sf_dir)))


@query(f"SELECT category, n FROM (SELECT {sql_classify(chr(39) * 2, 'text', 'category')} AS category, count(*) AS n FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations) GROUP BY 1) WHERE category IS NOT NULL")
def u1_union_of_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = spread(table(spark, sf_dir, "documents").select("text")).unionByName(spread(table(spark, sf_dir, "conversations").select("text")))
    return both.select(text.classify(F.lit(""), F.col("text"))["category"].alias("category")).filter("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT split_part(p_type, ' ', 1) AS word FROM part")
def u2_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("word")).distinct()


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS word FROM documents) WHERE word NOT IN (" + ", ".join(quoted(w) for w in rules.INTENT_STOP_WORDS) + ") GROUP BY word")
def u3_stop_word_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spread(table(spark, sf_dir, "documents").select("text")).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0))).alias("word"))
    return words.filter(~F.col("word").isin(rules.INTENT_STOP_WORDS)).groupBy("word").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, url, {sql_replaced('visible', rules.REDACT_PATTERNS)} AS visible_text, length(visible) AS chars FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, {sql_visible('html')} AS visible FROM pages)")
def p7_sanitized_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages(spark, sf_dir).select("page_id", urls.sanitize_url(F.col("url")).alias("url"), P.visible_text(F.col("html")).alias("visible"))
    return rows.select("page_id", "url", text.sanitize(F.col("visible")).alias("visible_text"), F.length("visible").alias("chars"))
