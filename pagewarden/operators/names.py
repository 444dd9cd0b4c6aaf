"""Person names and labelled values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.ids import exact, ids_of
from ..sources import pages as P


def count_name(body: Column, name: Column) -> Column:
    """How often a name stands in a text as whole words, whatever its case."""
    pattern = F.concat(F.lit(f"(?i){rules.BOUNDARY}"), text.regex_escape(name), F.lit(rules.BOUNDARY))
    return F.regexp_count(body, pattern).cast("long")


def person_query(query: Column, page: Column) -> Column:
    """The person that a search asks for: the whole query of two or three words, or its first two words if the page
    shows them in title or upper case."""
    q = text.collapse(F.coalesce(query, F.lit("")))
    words = F.split(q, " ")
    first, second = words[0], F.get(words, F.lit(1))
    shown = lambda w: F.concat(F.lit("(?:"), text.regex_escape(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))), F.lit("|"), text.regex_escape(F.upper(w)), F.lit(")"))
    pattern = F.concat(F.lit(rules.BOUNDARY), shown(first), F.lit(f"[{rules.SPACES}]+"), shown(second), F.lit(rules.BOUNDARY))
    return F.when(q.rlike(r"^[A-Za-z][A-Za-z'-]+(?: [A-Za-z][A-Za-z'-]+){1,2}$"), q).when((F.size(words) >= 3) & F.regexp_like(page, pattern), F.concat_ws(" ", first, second))


#: Tags whose text is no text of the page's body.
NO_BODY = ("script", "style", "noscript", "title")


def _is_search() -> Column:
    is_input, is_area = F.col("tag") == "input", F.col("tag") == "textarea"
    named = (F.coalesce(P.attribute("name"), F.lit("")) == "q") | F.lower(F.coalesce(P.attribute("aria-label"), F.lit(""))).contains("search")
    return ((is_input | is_area) & named) | (is_input & (F.lower(F.coalesce(P.attribute("type"), F.lit(""))) == "search"))


def query_name_hits(pages: DataFrame) -> DataFrame:
    """page_id, source (input or text), ord, times: where the person that a page's search asks for stands in its search fields and its visible text.

    The search is the first visible search field that isn't blank; pages without one, or whose search names nobody, have no rows.  Fields and
    text that are hidden, themselves or by an ancestor, count nowhere.  One parse and one aggregation a page.
    """
    rows = P.scan(pages).filter("shown")
    body = F.col("is_run") & ~F.col("tag").isin(*NO_BODY)
    field = ~F.col("is_run") & _is_search()
    value = F.coalesce(P.attribute("value"), F.when(F.col("tag") == "textarea", F.col("text")), F.lit(""))
    by_ord = lambda a, b: a["ord"] - b["ord"]
    held = rows.filter(body | field).groupBy("page_id").agg(F.array_sort(F.collect_list(F.when(body, F.struct("ord", "text"))), by_ord).alias("runs"), F.array_sort(F.collect_list(F.when(field, F.struct("ord", value.alias("value")))), by_ord).alias("fields"))
    asked = F.get(F.filter("fields", lambda f: F.trim(f["value"]) != ""), F.lit(0))["value"]
    named = held.withColumn("person", person_query(asked, F.array_join("runs.text", "\n"))).filter("person IS NOT NULL")
    in_field = F.transform(F.filter("fields", lambda f: F.lower(f["value"]).contains(F.lower("person"))), lambda f: F.struct(F.lit("input").alias("source"), f["ord"].alias("ord"), F.lit(1).cast("long").alias("times")))
    in_text = F.filter(F.transform("runs", lambda r: F.struct(F.lit("text").alias("source"), r["ord"].alias("ord"), count_name(r["text"], F.col("person")).alias("times"))), lambda h: h["times"] > 0)
    return named.select("page_id", F.explode(F.concat(in_field, in_text)).alias("h")).select("page_id", "h.*")


#: Elements that can hold a name's label and value side by side.
BOXES = ("tr", "li", "dl", "p", "div")
HIT_SCHEMA = "page_id long, ord int, name string, start int, end int"


def known_names(pages: DataFrame) -> DataFrame:
    """page_id, names, runs: the person names that a page tells, in the order found, and its visible text runs (ord, text).

    Names are visible fields that classify as a person, and runs of a box (``BOXES`` or role row) whose text has a name's label, except the label
    itself; both must look like a name.  A run belongs to the nearest box around it and to those around that one.
    """
    label = rules.java(next(p for c, p in rules.VALUE_LABELS if c == "PERSON"), True)
    rows = P.scan(pages).filter("shown")
    body = F.col("is_run") & ~F.col("tag").isin(*NO_BODY)
    metadata = F.concat_ws(" ", *[P.attribute(a) for a in ("type", "name", "id", "autocomplete", "placeholder", "aria-label")], text.truthy(F.col("label")))
    value = F.coalesce(P.attribute("value"), F.when(F.col("tag") != "input", F.col("text")))
    editable = F.coalesce(P.attribute("contenteditable"), F.lit("")) == "true"
    field = ~F.col("is_run") & (F.col("tag").isin("input", "textarea") | editable)
    told = F.when(field & (text.classify(metadata, value)["category"] == "PERSON"), text.person_name(value))
    box = ~F.col("is_run") & (F.col("tag").isin(*BOXES) | (F.coalesce(P.attribute("role"), F.lit("")) == "row"))
    by_ord = lambda a, b: a["ord"] - b["ord"]
    held = rows.filter(body | field | box).groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.when(told.isNotNull(), F.struct("ord", told.alias("name")))), by_ord)["name"].alias("told"),
        F.array_sort(F.collect_list(F.when(box, F.struct("ord", "last"))), by_ord).alias("boxes"),
        F.array_sort(F.collect_list(F.when(body, F.struct("ord", "parent", "text"))), by_ord).alias("runs"),
    )
    inside = lambda b: F.filter("runs", lambda r: r["parent"].between(b["ord"], b["last"]))
    whole = lambda b: text.collapse(F.array_join(inside(b)["text"], " "))
    labelled_boxes = F.filter("boxes", lambda b: whole(b).rlike(label))
    values = F.transform(labelled_boxes, lambda b: F.transform(F.filter(inside(b), lambda r: ~r["text"].rlike(label)), lambda r: text.person_name(text.collapse(r["text"]))))
    names = F.array_distinct(F.filter(F.concat("told", F.flatten(values)), lambda n: n.isNotNull()))
    return held.select("page_id", names.alias("names"), F.transform("runs", lambda r: F.struct(r["ord"], r["text"])).alias("runs"))


def repeated_names(told: DataFrame) -> DataFrame:
    """page_id, ord, name, start, end of every place where one of a page's ``names`` stands in one of its ``runs`` (ord, text), as whole words and whatever the case.

    Matches don't overlap: the leftmost goes first, and of those that start together the name found first.  Pages without names, and null texts, have none.
    The names of all pages of a batch are one Aho-Corasick automaton, so a text is read once however many names there are.
    """

    def find(batches):
        import ahocorasick

        for pdf in batches:
            machine = ahocorasick.Automaton()
            for names in pdf["names"]:
                for name in names:
                    machine.add_word(name.lower(), name.lower())
            machine.make_automaton()
            out, ids = [], ids_of(pdf, "page_id")
            for k, (names, runs) in enumerate(zip(pdf["names"], pdf["runs"], strict=True)):
                rank = {n.lower(): (i, n) for i, n in reversed(list(enumerate(names)))}
                for run in runs if len(rank) else ():
                    out += [(k, run["ord"], name, a, b) for name, a, b in _hits(machine, run["text"] or "", rank)]
            rows = pd.DataFrame([r[1:] for r in out], columns=["ord", "name", "start", "end"]).astype({"ord": "int32", "start": "int32", "end": "int32"})
            rows.insert(0, "page_id", ids[[r[0] for r in out]])
            yield rows

    return P.lean(told).select("names", "runs", *exact("page_id")).mapInPandas(find, HIT_SCHEMA)


def _hits(machine, body: str, rank: dict) -> list[tuple]:
    """Name, start and end of the matches of one text, by the ranks of its page's names."""
    low = body.lower() if len(body.lower()) == len(body) else "".join(c.lower() if len(c.lower()) == 1 else c for c in body)
    word = lambda i: 0 <= i < len(low) and (low[i].isascii() and (low[i].isalnum() or low[i] == "_"))
    found = [(end - len(n) + 1, rank[n][0], end + 1, rank[n][1]) for end, n in (machine.iter(low) if len(machine) else ()) if n in rank]
    found = [(a, r, b, n) for a, r, b, n in sorted(found) if word(a) != word(a - 1) and word(b - 1) != word(b)]
    out, free = [], 0
    for a, _, b, name in found:
        if a >= free:
            out.append((name, a, b))
            free = b
    return out


def _is_label(pattern: str):
    return lambda x: x["text"].rlike(pattern)


def _is_value(pattern: str, label_at: Column):
    return lambda x: (label_at.isNull() | (x["ord"] != label_at)) & (F.length(F.trim(x["text"])) >= 2) & ~x["text"].rlike(pattern)


def label_values(nodes: DataFrame) -> DataFrame:
    """box, category, value from text nodes (box, ord, text): the first label of the box's text, then the first other
    node that isn't a label; or, in the label's own node, what follows a separator."""
    whole = nodes.groupBy("box").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("n"))
    rows = whole.withColumn("label", text.value_label(text.collapse(F.array_join("n.text", " ")))).filter("label IS NOT NULL")
    values = []
    for category, pattern in rules.VALUE_LABELS:
        p = rules.java(pattern, True)
        label_node = F.get(F.filter("n", _is_label(p)), F.lit(0))
        other = F.filter("n", _is_value(p, label_node["ord"]))
        inline = F.regexp_extract(label_node["text"], f"{p}[{rules.SPACES}]*[:\\-–—][{rules.SPACES}]*(.+)$", 1)
        values.append(F.when(F.col("label.category") == category, F.coalesce(F.get(other, F.lit(0))["text"], text.truthy(inline))))
    # A box has one label, so one of the branches counts and the rows are read once.
    return rows.select("box", F.col("label.category").alias("category"), F.coalesce(*values).alias("value")).filter("value IS NOT NULL")
