"""What style sheets and ancestors hide, and several names of a page found in one pass."""

from __future__ import annotations

import re

import pytest

from pagewarden.operators import names, state
from pagewarden.sources import pages as P


def tags_hidden(spark, html: str) -> str:
    rows = P.elements(spark.createDataFrame([(1, html)], "page_id long, html string")).filter("NOT shown AND attrs['id'] IS NOT NULL").collect()
    return " ".join(sorted(r.attrs["id"] for r in rows))


@pytest.mark.parametrize("style, body, hidden", [
    ("", "<div id=a style='display: none'><p id=b><b id=c>x</b></p></div><i id=d></i>", "a b c"),
    ("", "<div id=a hidden><p id=b style='display:block'></p></div>", "a b"),
    ("", "<div id=a hidden style='display:block'></div>", ""),
    ("", "<div id=a style='visibility:hidden'><p id=b></p><p id=c style='visibility: visible'><u id=d></u></p></div>", "a b"),
    ("", "<div id=a style='opacity: 0'><p id=b></p></div><p id=c style='opacity:0.5'></p><p id=d style='opacity:0.0'></p>", "a d"),
    ("", "<div id=a style='width:0'><p id=b style='height: 0px'></p><p id=c style='max-height:0'></p><p id=d style='width:0.5px'></p></div>", "a b"),
    ("", "<input id=a type=hidden><input id=b>", "a"),
    (".x{display:none}", "<p id=a class='w x'></p><p id=b class=xx></p>", "a"),
    ("p, #b {display:none} #a{display:block}", "<p id=a></p><i id=b></i>", "b"),
    ("p{display:none!important} #a{display:block}", "<p id=a style='display:inline'></p>", "a"),
    (".a{display:none} .a{display:block}", "<p id=a class=a></p>", ""),
    ("div p{visibility:hidden}", "<div><i><p id=a></p></i></div><p id=b></p>", "a"),
    ("div > p{display:none}", "<div><p id=a></p><i><p id=b></p></i></div>", "a"),
    ("section div > p{display:none}", "<section><i><div><p id=a></p></div></i></section><div><p id=b></p></div>", "a"),
    ("p:hover, p + p, [data-x] {display:none}", "<p id=a></p><p id=b></p><p id=c data-x=1></p>", "c"),
    ("/* .a{display:none} */ @media print { .a { display:none } } @import 'x'; .b{color:red;display : NONE}", "<p id=a class=a></p><p id=b class=b></p>", "b"),
    ("p { display:none", "<p id=a></p>", ""),
])
def test_hiding(spark, style, body, hidden):
    assert tags_hidden(spark, f"<html><head><style>{style}</style></head><body>{body}</body></html>") == hidden


def test_intervals_labels_and_forms(spark):
    html = "<form name=f><label for=x>One</label><div><input id=x><p>t</p></div></form><label>Two <input></label><form><label for=x>Late</label></form>"
    rows = P.elements(spark.createDataFrame([(1, html)], "page_id long, html string")).sort("ord").collect()
    assert [(r.tag, r.ord, r.last) for r in rows][:5] == [("form", 0, 4), ("label", 1, 1), ("div", 2, 4), ("input", 3, 3), ("p", 4, 4)]
    assert [r.label for r in rows if r.tag == "input"] == ["One", "Two"]
    assert [(r.form_no, r.form_name) for r in rows if r.tag == "label"] == [(1, "f"), (None, None), (2, None)]


def test_hidden_parts_are_no_text_unless_all_is(spark):
    html = "<button>Go <i hidden>secret</i>on</button><a href=x><b hidden>only</b></a>"
    rows = {r.tag: r.text for r in P.elements(spark.createDataFrame([(1, html)], "page_id long, html string")).collect()}
    assert rows["button"] == "Go on" and rows["a"] == "only"


def test_state_of_a_page_takes_one_parse(spark):
    from pagewarden.plans import form_queries, request_queries

    plan = request_queries.p8_compact_state(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInPandas") == 1
    assert form_queries.s4_form_controls(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert state.compact_state.__doc__


def test_repeated_names_against_an_alternation(spark):
    told = [
        (1, ["Ann Lee", "Lee Roy", "ann lee roy"], ["Ann Lee Roy and LEE ROY, xann lee; ann lee-roy", None, "", "annlee"]),
        (2, ["Bob O'Neil"], ["Bob O'Neil's bob o'neil Ann Lee"]),
        (None, ["Zoë Ann"], ["zoë ann"]), (2**53 + 1, ["Cy Dee"], ["Cy Dee cy dee"]), (5, [], ["Ann Lee"]), (6, ["No Body"], []),
    ]
    frame = spark.createDataFrame([(i, n, [(k, t) for k, t in enumerate(ts)]) for i, n, ts in told], "page_id long, names array<string>, runs array<struct<ord:int,text:string>>").coalesce(1)
    want = []
    for i, n, ts in told:
        for k, t in enumerate(ts):
            pattern = re.compile(r"\b(?:" + "|".join(map(re.escape, n)) + r")\b", re.I | re.A)
            want += [(i, k, m.start(), m.end()) for m in pattern.finditer(t or "")] if n else []
    got = names.repeated_names(frame).collect()
    assert sorted(((r.page_id, r.ord, r.start, r.end) for r in got), key=str) == sorted(want, key=str)
    assert {r.name for r in got if r.page_id == 1} == {"Ann Lee", "Lee Roy"}
    assert names.repeated_names(frame.limit(0)).collect() == []
