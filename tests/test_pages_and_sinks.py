"""Page scans of odd pages, and sinks that are written more than once."""

from __future__ import annotations

import tempfile
import time

import pandas as pd
from pyspark.sql import functions as F

from pagewarden.functions import text
from pagewarden.sources import pages as P
from pagewarden.sources import requests as R
from pagewarden.sources import sinks

SCHEMA = "page_id long, html string"


def test_pages_without_id_or_html(spark):
    rows = [(1, "<body><a href='x'>one</a></body>"), (None, "<body><a href='x'>two</a></body>"), (2, None), (3, "")]
    got = {(r.page_id, r.text) for r in P.elements(spark.createDataFrame(rows, SCHEMA)).filter("tag = 'a'").collect()}
    assert got == {(1, "one"), (None, "two")}
    alone = spark.createDataFrame([(None, "<p>x</p>")], SCHEMA)
    assert [r.page_id for r in P.text_runs(alone).collect()] == [None]
    assert P.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_scan_holds_few_rows_at_a_time():
    """A batch of many pages comes back in parts, whole pages each; a page of more rows than a part is one of its own."""
    html = ["<p>a</p>" * 3] * 5000 + ["<p>b</p>" * 3000] + [None, "<p>c</p>"]
    pdf = pd.DataFrame({"html": html, "page_id": range(len(html)), "page_id_known": True})
    parts = list(P.scanned(iter([pdf])))
    assert sum(map(len, parts)) == 5000 * 6 + 6000 + 2
    assert all(len(p) <= P.BATCH_ROWS or p["page_id"].nunique() == 1 for p in parts)
    assert pd.concat(parts)["page_id"].is_monotonic_increasing


def test_deep_and_broken_nesting_takes_time_in_proportion(spark):
    def seconds(n: int) -> float:
        html = "<body>" + "<div>x" * n + "</span>" * n + "</div>" * n + "</body>"
        tree, began = P._Tree(), time.perf_counter()
        tree.feed(html)
        tree.close()
        assert len(tree.elements) == n + 1 and len(tree.runs) == n
        return time.perf_counter() - began

    seconds(500)
    assert seconds(16_000) < 16 * max(seconds(2_000), 0.01)


def test_text_form_and_label_of_nested_elements(spark):
    html = "<form><label>Name <b>here</b><script>no</script><input id='i'></label><button>Go <i>on</i></button></form><a href='#'>out</a>"
    got = {r.tag: r for r in P.elements(spark.createDataFrame([(1, html)], SCHEMA)).collect()}
    assert got["label"].text == "Name here" and got["button"].text == "Go on" and got["a"].text == "out"
    assert got["input"].label_ord == got["label"].ord and got["input"].form == got["form"].ord and got["a"].form is None


def test_a_repeated_upsert_changes_nothing(spark):
    path = f"file://{tempfile.mkdtemp(prefix='spark-')}/table"
    one = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 5, "c")], "k long, at long, v string")
    two = spark.createDataFrame([(1, 1, "old"), (2, 6, "d"), (3, 0, "e")], "k long, at long, v string")
    assert sinks.read_latest(spark, path, one.schema.simpleString()[7:-1].replace(":", " ")).count() == 0
    for batch in (one, two, two, one):
        sinks.upsert(batch, path, "k", ["at"])
    got = {(r.k, r.v) for r in sinks.read_latest(spark, path, "k long, at long, v string").collect()}
    assert got == {(1, "b"), (2, "d"), (3, "e")}
    assert len(sinks._generations(spark, path)) == 2


def test_requests_with_odd_values(spark):
    rows = [(1, "image/png", None, None, '{"sanitized": true, "rawScreenshotIncluded": false, "redactionMap": [1]}'), (2, None, None, None, None), (3, "image/png", ".hidden", "[]", None)]
    got = {r.request_id: (r.status, r.suffix, r.regions) for r in R.uploads(spark.createDataFrame(rows, "request_id long, content_type string, file_name string, redaction_regions string, privacy_proof string")).collect()}
    assert got == {1: ("OK", ".png", 0), 2: ("NO_CONTENT_TYPE", ".png", None), 3: ("PROOF_REQUIRED", ".png", None)}


def test_sums_before_each_place(spark):
    sizes = [0, 1, 2, 255, 256, 257, 1000]
    rows = spark.createDataFrame([([(k * 7) % 5 for k in range(n)],) for n in sizes], "n array<int>")
    for r in rows.select("n", text.sums_before(F.col("n")).alias("s")).collect():
        assert r.s == [sum(r.n[:k]) for k in range(len(r.n))]
