"""Scans of HTML pages: elements, text runs, forms and visible text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.ids import exact, ids_of, listed
from . import hiding

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
KEPT = ("type", "id", "name", "autocomplete", "placeholder", "value", "href", "role", "title", "for", "style", "aria-label", "aria-labelledby", "aria-describedby", "aria-expanded", "aria-haspopup", "aria-checked", "aria-selected", "tabindex", "contenteditable", "disabled")


#: ``ord`` to ``last`` are an element and all below it; a run has its element's tag and ``shown``.
SCAN_SCHEMA = "page_id long, is_run boolean, ord int, last int, parent int, tag string, shown boolean, text string, form int, form_no int, form_name string, label_ord int, label string, attrs map<string,string>"
#: Elements that a scan names or looks labels up in; others carry no text of their own, which would repeat that of all below them.
TEXTED = {"button", "input", "textarea", "select", "a", "label", "option", *(f"h{k}" for k in range(1, 7))}


class _Tree(HTMLParser):
    """Elements and text runs of one page in document order; each tag and run costs the same at any depth."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []  # parent, tag, form, label, attributes, first run, run after the last
        self.names: list[set[str]] = []  # ids, classes and attributes as selectors write them
        self.runs: list[tuple] = []
        self.open: list[tuple] = []  # element, tag, nearest form, nearest label
        self.depth: dict[str, int] = {}

    def handle_starttag(self, tag, attrs):
        k = len(self.elements)
        parent, _, form, label = self.open[-1] if self.open else (None, None, None, None)
        kept = {a: v or "" for a, v in attrs if a in KEPT}
        self.elements.append([parent, tag, form, label, kept, len(self.runs), len(self.runs)])
        self.names.append({f"#{v}" if a == "id" else f"[{a}]" for a, v in attrs} | {f"[{a}]" for a, _ in attrs} | {f".{c}" for a, v in attrs if a == "class" for c in (v or "").split()})
        if tag not in VOID:
            self.open.append((k, tag, k if tag == "form" else form, k if tag == "label" else label))
            self.depth[tag] = self.depth.get(tag, 0) + 1

    def handle_endtag(self, tag):
        while self.depth.get(tag):
            k, name, *_ = self.open.pop()
            self.elements[k][6] = len(self.runs)
            self.depth[name] -= 1
            if name == tag:
                break

    def handle_data(self, data):
        if data.strip() and self.open:
            self.runs.append((self.open[-1][0], self.open[-1][1], data))

    def close(self):
        super().close()
        for k, *_ in self.open:
            self.elements[k][6] = len(self.runs)
        page = [(e[0], e[1], names) for e, names in zip(self.elements, self.names, strict=True)]
        attrs = [e[4] for e in self.elements]
        self.shown = hiding.shown(page, [a.get("style") for a in attrs], [a.get("type") for a in attrs], "\n".join(data for _, t, data in self.runs if t == "style"))
        self.last = list(range(len(page)))
        for k in range(len(page) - 1, 0, -1):
            if (parent := page[k][0]) is not None:
                self.last[parent] = max(self.last[parent], self.last[k])

    def text(self, k: int) -> str:
        """The text of an element, white space collapsed, scripts left out; hidden parts too unless all of it is hidden."""
        _, tag, _, _, attrs, first, end = self.elements[k]
        if tag not in TEXTED and "role" not in attrs and "contenteditable" not in attrs:
            return ""
        runs = [(parent, data) for parent, t, data in self.runs[first:end] if t not in ("script", "style")]
        return _joined([data for parent, data in runs if self.shown[parent]]) or _joined([data for _, data in runs])

    def rows(self) -> list[tuple]:
        """The page's elements and runs as rows of SCAN_SCHEMA without the page."""
        texts = [self.text(k) for k in range(len(self.elements))]
        labels: dict[str, str] = {}
        forms: dict[int, tuple] = {}
        for k, (_, tag, _, _, attrs, *_) in enumerate(self.elements):
            if tag == "label" and attrs.get("for"):
                labels.setdefault(attrs["for"], texts[k])
            if tag == "form":
                forms[k] = (len(forms) + 1, attrs.get("name") or None)
        out = []
        for k, (parent, tag, form, label, attrs, *_) in enumerate(self.elements):
            named = (labels.get(attrs["id"]) if attrs.get("id") else None) or (texts[label] if label is not None else "")
            out.append((False, k, self.last[k], parent, tag, self.shown[k], texts[k], form, *forms.get(form, (None, None)), label, named, attrs))
        return out + [(True, k, None, parent, tag, self.shown[parent], data, None, None, None, None, None, None) for k, (parent, tag, data) in enumerate(self.runs)]


def _joined(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


#: Bytes of an Arrow batch of pages on its way to a Python worker, and rows of a scan (or those of one page, if more) on their way back.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


def lean(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Python workers small Arrow batches from now on: ten thousand pages at a time would be gigabytes of Python objects."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df


def scan(pages: DataFrame) -> DataFrame:
    """All elements and text runs of all pages, from one parse a page: texts, labels, forms and what is hidden come with them.

    Null html has neither; rows without page_id keep it null.
    """
    return lean(pages).select("html", *exact("page_id")).mapInPandas(scanned, SCAN_SCHEMA)


def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of SCAN_SCHEMA for batches of pages; what a worker holds is bounded by a batch of pages and BATCH_ROWS rows, however many pages there are."""
    columns = [c.split()[0] for c in SCAN_SCHEMA.replace("map<string,string>", "map").split(", ")][1:]

    def framed(ids: list, out: list[tuple]) -> pd.DataFrame:
        rows = pd.DataFrame(out, columns=columns)
        rows.insert(0, "page_id", listed([None if i is pd.NA else int(i) for i in ids]))
        return rows.astype(dict.fromkeys(("last", "parent", "form", "form_no", "label_ord"), "Int32"))

    for pdf in batches:
        ids, out = [], []
        for page_id, html in zip(ids_of(pdf, "page_id"), pdf["html"], strict=True):
            tree = _Tree()
            tree.feed(html or "")
            tree.close()
            found = tree.rows()
            if out and len(out) + len(found) > BATCH_ROWS:
                yield framed(ids, out)
                ids, out = [], []
            ids += [page_id] * len(found)
            out += found
        if out:
            yield framed(ids, out)


def elements(pages: DataFrame) -> DataFrame:
    """All elements of all pages in document order, with attributes, form and enclosing label, and the text of those that a scan names."""
    return scan(pages).filter("NOT is_run").drop("is_run")


def text_runs(pages: DataFrame) -> DataFrame:
    """All text runs with their element."""
    return scan(pages).filter("is_run").select("page_id", "ord", "parent", F.col("tag").alias("parent_tag"), "shown", "text")


def page_context(pages: DataFrame) -> DataFrame:
    """page_id, elements, interactive, detections, categories of every page, from one parse and one aggregation."""
    seen = ~F.col("is_run") & selected() & visible()
    body = F.col("is_run") & F.col("shown") & ~F.col("tag").isin(*SKIPPED, "title")
    hits = F.when(body, F.transform(text.matches(F.col("text")), lambda m: m["category"]))
    rows = scan(pages).select("page_id", seen.alias("seen"), (seen & category().isin(*rules.INTERACTIVE)).alias("interactive"), hits.alias("hits"))
    return rows.groupBy("page_id").agg(F.count_if("seen").alias("elements"), F.count_if("interactive").alias("interactive"), F.sum(F.coalesce(F.size("hits"), F.lit(0))).alias("detections"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_distinct("hits"))))).alias("categories"))


def attribute(name: str) -> Column:
    return text.truthy(F.try_element_at("attrs", F.lit(name)))


def visible() -> Column:
    """Visibility as far as static HTML tells: no style of the element, of a style sheet of the page or of what it inherits hides it."""
    return F.col("shown")


def category() -> Column:
    tag = F.col("tag")
    return (
        F.when(tag.isin("button", "input", "textarea", "select"), tag)
        .when(tag == "a", "link")
        .when(F.try_element_at("attrs", F.lit("contenteditable")).isin("true", ""), "contenteditable")
        .when(tag.rlike("^h[1-6]$"), "heading")
        .otherwise(tag)
    )


def accessible_name() -> Column:
    return F.coalesce(attribute("aria-label"), attribute("title"), text.truthy(F.col("text")), attribute("value"))


def selected() -> Column:
    """The nineteen kinds of element that a page scan looks at."""
    role = F.coalesce(attribute("role"), F.lit(""))
    tags = F.col("tag").isin("button", "input", "textarea", "select", "h1", "h2", "h3", "h4", "h5", "h6")
    return tags | ((F.col("tag") == "a") & F.try_element_at("attrs", F.lit("href")).isNotNull()) | (F.coalesce(attribute("contenteditable"), F.lit("")) == "true") | role.isin("button", "link", "textbox", "checkbox", "radio", "tab", "menuitem")


def numbered(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Elements of each page numbered in document order as ``element_N``."""
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("ord"))
    out = df.withColumn("n", n)
    out = out if limit is None else out.filter(F.col("n") <= limit)
    return out.withColumn("element_id", F.concat(F.lit("element_"), F.col("n").cast("string"))).drop("n")


def page_elements(pages: DataFrame) -> DataFrame:
    """The scan of a page: selected, visible, numbered elements; text to 500 characters, label looked up."""
    return described(numbered(elements(pages).filter(selected() & visible())))


def described(found: DataFrame) -> DataFrame:
    """Elements with their category and their text to 500 characters.  ``label`` is the text of the label for the element's id, else of the enclosing label, else empty."""
    return found.withColumn("category", category()).withColumn("text", F.coalesce(F.substring(text.first_truthy(F.col("text"), attribute("value")), 1, 500), F.lit("")))


def runtime_elements(pages: DataFrame, limit: int = 60) -> DataFrame:
    """The sanitised scan for a request: interactive kinds, the first 60, texts to 120 characters, no query in links."""
    role = F.coalesce(attribute("role"), F.lit(""))
    kind = F.col("tag").isin("button", "input", "textarea", "select") | ((F.col("tag") == "a") & F.try_element_at("attrs", F.lit("href")).isNotNull()) | F.try_element_at("attrs", F.lit("contenteditable")).isNotNull() | role.isin("button", "link", "textbox", "checkbox", "tab")
    found = numbered(elements(pages).filter(kind & visible()), limit)
    clean = lambda c: text.sanitize_visible(c)
    return found.select(
        "page_id", "element_id", "tag", F.when(F.col("tag") == "a", "link").otherwise(F.col("tag")).alias("category"), attribute("role").alias("role"),
        clean(F.substring(F.trim(text.first_truthy(F.col("text"), attribute("value"), F.lit(""))), 1, 120)).alias("text"),
        clean(F.coalesce(attribute("placeholder"), F.lit(""))).alias("placeholder"), clean(F.coalesce(attribute("aria-label"), attribute("title"), F.lit(""))).alias("label"),
        F.regexp_replace(attribute("href"), r"[?#].*$", "").alias("href"), F.try_element_at("attrs", F.lit("disabled")).isNotNull().alias("disabled"),
    )


#: The tags of a form's controls.
CONTROLS = ("input", "textarea", "select", "button")


def forms(pages: DataFrame) -> DataFrame:
    """page_id, form_id, name and the visible controls as an array of structs numbered ``form_i_control_j``."""
    controls = elements(pages).filter(F.col("tag").isin(*CONTROLS) & visible() & F.col("form").isNotNull())
    held = controls.groupBy("page_id", "form_no", "form_name").agg(F.array_sort(F.collect_list(control())).alias("controls"))
    return held.select("page_id", form_id(F.col("form_no")).alias("form_id"), "form_name", F.transform("controls", lambda c, i: numbered_control(form_id(F.col("form_no")), c, i)).alias("controls"))


def form_id(number: Column) -> Column:
    return F.concat(F.lit("form_"), number.cast("string"))


def control() -> Column:
    """Struct of a control, before it has its number."""
    return F.struct("ord", "tag", attribute("type").alias("type"), attribute("name").alias("name"), "label", attribute("placeholder").alias("placeholder"))


def numbered_control(form: Column, c: Column, i: Column) -> Column:
    return F.struct((i + 1).alias("j"), F.concat(form, F.lit("_control_"), (i + 1).cast("string")).alias("control_id"), *[c[f].alias(f) for f in ("tag", "type", "name", "label", "placeholder")])


def sensitive_inputs(pages: DataFrame) -> DataFrame:
    """Inputs with a value that classifies as sensitive."""
    fields = elements(pages).filter(F.col("tag").isin("input", "textarea") & visible())
    metadata = F.concat_ws(" ", *[attribute(a) for a in ("type", "name", "id", "autocomplete", "placeholder", "aria-label")], text.truthy(F.col("label")))
    found = fields.filter(F.trim(F.coalesce(attribute("value"), F.lit(""))) != "").withColumn("d", text.classify(metadata, attribute("value")))
    return found.filter("d IS NOT NULL").select("page_id", "ord", "tag", F.lit("input").alias("source"), "d.category", "d.severity", "d.reason")


SKIPPED = ("script", "style", "noscript", "input", "textarea", "select", "option")


def sensitive_text(pages: DataFrame) -> DataFrame:
    """Matches of the rules in text runs that can be seen, outside the skipped tags."""
    runs = text_runs(pages).filter(F.col("shown") & ~F.col("parent_tag").isin(*SKIPPED) & (F.col("parent_tag") != "title"))
    return runs.select("page_id", "ord", F.lit("text").alias("source"), F.col("parent_tag").alias("tag"), F.explode(text.matches(F.col("text"))).alias("m")).select("page_id", "ord", "source", "tag", "m.category", "m.severity", "m.value", "m.start", "m.end")


#: Steps that leave the visible text of a page's body: pattern and replacement.
VISIBLE_STEPS = [(r"(?is)^.*<body[^>]*>", ""), (r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " "), (r"(?s)<!--.*?-->", ""), (r"(?i)</?(a|b|i|em|strong|span|u|small)( [^>]*)?>", ""), (r"<[^>]*>", " ")]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def visible_text(html: Column, limit: int = 10000) -> Column:
    """Text of the body without scripts and tags, white space collapsed, the first 10000 characters.  Built-in functions alone."""
    for pattern, to in VISIBLE_STEPS:
        html = F.regexp_replace(html, pattern, to)
    for entity, to in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(to))
    return F.substring(text.collapse(html), 1, limit)


def context_route(page_text: Column, html: Column) -> Column:
    visual = html.rlike(r"(?i)<(canvas|svg|video|iframe|object|embed|img)[\s/>]|style=[\"'][^\"']*background-image")
    return F.when((page_text != "") & ~visual, "DOM_ONLY").otherwise("DOM + SCREENSHOT")


def interactive() -> Column:
    return F.col("category").isin(*rules.INTERACTIVE)
