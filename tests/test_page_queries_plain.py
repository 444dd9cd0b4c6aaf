"""The page queries that have no SQL, over the table and the form page, against a plain walk of each page."""

from __future__ import annotations

import json
import os
import re
from html.parser import HTMLParser

import pytest

from pagewarden import registry
from pagewarden.plans.page_queries import FORM_PAGE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
VOID = "area base br col embed hr img input link meta source track wbr".split()


class Node:
    def __init__(self, tag, attrs, up):
        self.tag, self.attrs, self.up, self.kids = tag, dict(attrs), up, []

    def walk(self):
        yield self
        for k in self.kids:
            if isinstance(k, Node):
                yield from k.walk()

    def text(self) -> str:
        parts = [k.text() if isinstance(k, Node) else k for k in self.kids]
        return "" if self.tag in ("script", "style") else "".join(parts)

    def above(self, tag: str):
        up = self.up
        while up is not None and up.tag != tag:
            up = up.up
        return up


class Walk(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", [], None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, [(a, v or "") for a, v in attrs], self.at)
        self.at.kids.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        up = self.at
        while up is not None and up.tag != tag:
            up = up.up
        if up is not None:
            self.at = up.up

    def handle_data(self, data):
        if data.strip() and self.at is not self.root:
            self.at.kids.append(data)


def tree(html: str) -> list[Node]:
    w = Walk()
    w.feed(html)
    w.close()
    return list(w.root.walk())[1:]


@pytest.fixture(scope="module")
def walked(spark) -> dict:
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] + [(-1, FORM_PAGE)]
    return {i: tree(html) for i, html in rows}


def answer(spark, name: str) -> list:
    return registry.queries()[name](spark, SF).collect()


def hidden(e: Node) -> bool:
    """The pages have inline styles alone."""
    up, gone = e, False
    while up is not None:
        gone |= "display:none" in up.attrs.get("style", "").replace(" ", "")
        up = up.up
    return gone or e.attrs.get("type") == "hidden"


def collapsed(s: str) -> str:
    return " ".join(s.split())


def selected(e: Node) -> bool:
    role = e.attrs.get("role", "")
    return e.tag in ("button", "input", "textarea", "select", *(f"h{k}" for k in range(1, 7))) or (e.tag == "a" and "href" in e.attrs) or e.attrs.get("contenteditable") == "true" or role in ("button", "link", "textbox", "checkbox", "radio", "tab", "menuitem")


def label(e: Node, nodes: list[Node]) -> str:
    by_id = next((collapsed(n.text()) for n in nodes if n.tag == "label" and e.attrs.get("id") and n.attrs.get("for") == e.attrs["id"]), "")
    around = e.above("label")
    return by_id or (collapsed(around.text()) if around else "")


def test_visible_elements(spark, walked):
    got = {(r.page_id, r.ord): (r.tag, r.visible) for r in answer(spark, "p1_visible_elements")}
    assert got == {(i, k): (e.tag, not hidden(e)) for i, nodes in walked.items() for k, e in enumerate(nodes)}


def test_accessible_names(spark, walked):
    got = {(r.page_id, r.ord): (r.tag, r.name) for r in answer(spark, "p4_accessible_names")}
    name = lambda e: e.attrs.get("aria-label") or e.attrs.get("title") or collapsed(e.text()) or e.attrs.get("value") or None
    assert got == {(i, k): (e.tag, name(e)) for i, nodes in walked.items() for k, e in enumerate(nodes) if selected(e)}


def test_labels_and_texts(spark, walked):
    want = {}
    for i, nodes in walked.items():
        for n, e in enumerate(e for e in nodes if selected(e) and not hidden(e)):
            want[i, f"element_{n + 1}"] = (e.tag, label(e, nodes), (collapsed(e.text()) or e.attrs.get("value", ""))[:500])
    assert {(r.page_id, r.element_id): (r.tag, r.label, r.text) for r in answer(spark, "j1_label_lookup")} == want


def test_forms(spark, walked):
    want = {}
    for i, nodes in walked.items():
        for n, form in enumerate(e for e in nodes if e.tag == "form"):
            controls = [e for e in nodes if e.tag in ("input", "textarea", "select", "button") and e.above("form") is form and not hidden(e)]
            if controls:
                want[i, f"form_{n + 1}"] = [(f"form_{n + 1}_control_{k + 1}", e.tag, e.attrs.get("type") or None, e.attrs.get("name") or None, label(e, nodes)) for k, e in enumerate(controls)]
    got = {(r.page_id, r.form_id): [(c["control_id"], c["tag"], c.get("type"), c.get("name"), c["label"]) for c in json.loads(r.controls)] for r in answer(spark, "s4_forms")}
    assert got == want and want


def test_runtime_elements(spark, walked):
    want = {}
    for i, nodes in walked.items():
        kind = lambda e: e.tag in ("button", "input", "textarea", "select") or (e.tag == "a" and "href" in e.attrs) or "contenteditable" in e.attrs or e.attrs.get("role") in ("button", "link", "textbox", "checkbox", "tab")
        for n, e in enumerate([e for e in nodes if kind(e) and not hidden(e)][:60]):
            href = re.sub(r"[?#].*$", "", e.attrs["href"]) if e.attrs.get("href") else None
            want[i, f"element_{n + 1}"] = (e.tag, "link" if e.tag == "a" else e.tag, e.attrs.get("role") or None, href, "disabled" in e.attrs)
    assert {(r.page_id, r.element_id): (r.tag, r.category, r.role, r.href, r.disabled) for r in answer(spark, "s2_runtime_elements")} == want


def test_page_context_counts(spark, walked):
    seen = {i: [e for e in nodes if selected(e) and not hidden(e)] for i, nodes in walked.items() if i >= 0}
    interactive = lambda e: e.tag in ("button", "input", "textarea", "select", "a") or e.attrs.get("contenteditable") in ("true", "")
    got = {r.page_id: (r.elements, r.interactive) for r in answer(spark, "s6_page_context")}
    assert got == {i: (len(es), sum(map(interactive, es))) for i, es in seen.items()}


def test_hits_stand_where_they_say(spark, walked):
    """Every hit of the text walk is in a visible run of its tag, at its place; so is every offset of the documents' matches."""
    runs = {}
    for i, nodes in walked.items():
        at = 0
        order = {id(e): k for k, e in enumerate(nodes)}
        texts = []

        def visit(e):
            for k in e.kids:
                if isinstance(k, Node):
                    visit(k)
                else:
                    texts.append((e, k))

        roots = [e for e in nodes if e.up is not None and e.up.tag == "#"]
        for e in roots:
            visit(e)
        for at, (e, t) in enumerate(texts):
            runs[1 if i == -1 else i, at, i == -1] = (e, t, order[id(e)])
    for r in answer(spark, "s5_sensitive_text"):
        held = [runs.get((r.page_id, r.ord, own)) for own in (False, True)]
        assert any(h and h[0].tag == r.tag and not hidden(h[0]) and h[1][r.start : r.end] == r.value for h in held)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    offsets = answer(spark, "t4_match_offsets")
    own = [r for r in offsets if r.origin == "d"]
    assert own and all(texts[r.id][r.start : r.end] == r.value for r in own)


def test_inputs_and_masks(spark, walked):
    """The form page's filled e-mail field is the one sensitive input, and its text is masked; nothing of the tables' pages is an input."""
    found = answer(spark, "p5_sensitive_inputs")
    assert {(r.page_id, walked[r.page_id][r.ord].attrs.get("name"), r.category) for r in found} == {(-1, "email", "EMAIL"), (-1, "full_name", "PERSON")}
    masked = [r for r in answer(spark, "t6_sanitize_elements") if r.text == "[REDACTED]"]
    assert sorted(r.label for r in masked) == ["Email", "Full Name", "Password"]
    assert [(r.page_id, r.times) for r in answer(spark, "j4_query_name_hits") if r.page_id == -1] == [(-1, 1), (-1, 2)]
