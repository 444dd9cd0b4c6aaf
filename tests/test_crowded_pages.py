"""Pages of very many boxes: suppression by rounds equals the ordered fold, and the ring search equals comparing all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from pagewarden import registry
from pagewarden.functions import geometry as G
from pagewarden.operators import spatial, suppression
from pagewarden.operators.suppression import suppress

BOX = "page_id long, rank int, id long, rect struct<x:int,y:int,width:int,height:int>, type int"


def boxes(n: int) -> list[tuple]:
    rng = random.Random(n)
    out = []
    for page in (1, 2, None):
        for k in range(n):
            near = rng.choice([(0, 0), (300, 40), (610, 120)])
            r = (near[0] + rng.randint(0, 90), near[1] + rng.randint(0, 60), rng.choice([0, 20, 40, 41, 60]), rng.choice([0, 15, 30, 31]))
            out.append((page, k, k * 7, r, k % 2))
        out += [(page, n + k, k, out[-1][3], k % 2) for k in range(20)]  # copies
    return out


CLASHES = {
    "overlap": lambda k, b: G.iou(k["rect"], b["rect"]) >= 0.42,
    "alike": lambda k, b: (G.iou(k["rect"], b["rect"]) >= 0.6) & (k["type"] == b["type"]),
    "within": lambda k, b: (G.containment(b["rect"], k["rect"]) >= 0.9) | (G.containment(k["rect"], b["rect"]) >= 0.9),
}


@pytest.mark.parametrize("name", CLASHES)
def test_rounds_equal_the_fold(spark, name):
    frame = spark.createDataFrame(boxes(120), BOX).filter("page_id IS NOT NULL")
    answers = [{tuple(r) for r in suppress(frame, CLASHES[name], crowd=crowd).select("page_id", "rank", "id").collect()} for crowd in (10**9, 0, 130)]
    assert answers[0] == answers[1] == answers[2] and 0 < len(answers[0]) < frame.count()
    assert suppress(frame.limit(0), CLASHES[name], crowd=0).collect() == []


def test_a_long_chain_and_many_copies(spark):
    chain = [(1, k, k, (8 * k, 0, 20, 20), 0) for k in range(30)]
    copies = [(2, k, k, (5, 5, 9, 9), 0) for k in range(3000)]
    got = suppress(spark.createDataFrame(chain + copies, BOX), CLASHES["overlap"], crowd=10).select("page_id", "id").collect()
    assert sorted(r.id for r in got if r.page_id == 1) == list(range(0, 30, 2)) and [r.id for r in got if r.page_id == 2] == [0]


def test_crowded_pages_are_dealt_by_their_cells_and_never_broadcast(spark, monkeypatch):
    plans, write = {}, DataFrameWriter.parquet

    def watched(self, path, *args, **kwargs):
        plans[path.rsplit("/", 1)[-1]] = self._df._jdf.queryExecution().executedPlan().toString()
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    monkeypatch.setattr(suppression, "PLACES", 100, raising=False)
    frame = spark.createDataFrame(boxes(120), BOX).filter("page_id IS NOT NULL")
    got = suppress(frame, CLASHES["overlap"], crowd=100)
    last = got._jdf.queryExecution().executedPlan().toString()
    places = frame.select(F.sum(F.size(spatial.cells(F.col("rect"), 128, "x")) * F.size(spatial.cells(F.col("rect"), 128, "y")))).first()[0]
    assert places > 300 and f"hashpartitioning(page_id#, _cx#, _cy#, {-(-places // 100)}), REPARTITION_BY_NUM" in re.sub(r"#\d+L?", "#", plans["edges-0"])
    grown = [plan for name, plan in plans.items() if re.match("double|edges|lost", name)]
    assert len(grown) > 3 and not any("BroadcastHashJoin" in plan for plan in grown)
    assert re.findall(r"(\w+Join) \[page_id#\d+L, rank#\d+\], .*LeftAnti", last) == ["SortMergeJoin"]
    want = suppress(frame, CLASHES["overlap"], crowd=10**9)
    assert {tuple(r) for r in got.select("page_id", "id", "rank").collect()} == {tuple(r) for r in want.select("page_id", "id", "rank").collect()}


@pytest.mark.parametrize("name", ["m13_customer_pictures", "a6_customer_summary", "j7_nearest_field"])
def test_labels_and_fields_are_merged_and_never_broadcast(spark, name):
    found = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_rings_are_merged_and_never_broadcast(spark, monkeypatch):
    plans, write = {}, DataFrameWriter.parquet

    def watched(self, path, *args, **kwargs):
        write(self, path, *args, **kwargs)
        plans[path.rsplit("/", 1)[-1]] = self._df._jdf.queryExecution().executedPlan().toString()

    monkeypatch.setattr(DataFrameWriter, "parquet", watched)
    k, page = F.col("id"), F.lit(1).alias("page_id")
    fields = spark.range(40).select(page, k.alias("field_id"), k.alias("ord"), G.rect(k * 37 % 600, k * 53 % 400, F.lit(30), F.lit(12)).alias("frect"))
    labels = spark.range(20).select(page, k.alias("label_id"), G.rect(k * 31 % 600, k * 71 % 400, F.lit(40), F.lit(12)).alias("rect"))
    got = {tuple(r) for r in spatial.by_rings(labels, fields, 448).collect()}
    assert "ring-0" in plans and all("SortMergeJoin" in plan and "Broadcast" not in plan for plan in plans.values())
    assert got == {tuple(r) for r in spatial.nearest_field(labels, fields, 1280, 720).collect()} and len(got) > 10


def test_nearest_field_of_a_page_with_a_hundred_thousand_boxes(spark):
    n, labels = 100_000, 300
    k = F.col("id")
    fields = spark.range(n).select(F.lit(1).alias("page_id"), k.alias("field_id"), k.alias("ord"), G.rect(k * 7919 % 1200, k * 104729 % 30000, 10 + k % 90, 8 + k % 30).alias("frect"))
    asked = spark.range(labels).select(F.lit(1).alias("page_id"), k.alias("label_id"), G.rect(k * 331 % 1100, k * 523 % 31500, 30 + k % 60, 12 + k % 9).alias("rect"))
    got = {r.label_id: (r.field_id, r.score) for r in spatial.nearest_field(asked, fields, 1280, 720).collect()}
    i = np.arange(n)
    x, y, w, h = i * 7919 % 1200, i * 104729 % 30000, 10 + i % 90, 8 + i % 30
    want = {}
    for j in range(labels):
        a, b, c, d = j * 331 % 1100, j * 523 % 31500, 30 + j % 60, 12 + j % 9
        dx, dy = abs(x + w / 2 - a - c / 2), abs(y + h / 2 - b - d / 2)
        gx, gy = np.maximum(0, np.maximum(x - (a + c), a - (x + w))), np.maximum(0, np.maximum(y - (b + d), b - (y + h)))
        beside, below, far = x >= a + c - 5, y >= b + d - 5, dx + dy + gx + gy
        score = far - np.where(beside, np.maximum(0, 50 - dy), 0) - np.where(below, np.maximum(0, 50 - dx), 0)
        score = np.where((beside | below) & (far <= 448), score, np.inf)
        if np.isfinite(score.min()):
            want[j] = (int(score.argmin()), float(score.min()))
    assert got == want and 0 < len(want) < labels


def test_nearest_field_of_nothing(spark):
    labels = spark.createDataFrame([(1, 1, (0, 0, 5, 5))], "page_id int, label_id int, rect struct<x:int,y:int,width:int,height:int>")
    fields = labels.select("page_id", F.col("label_id").alias("field_id"), F.col("label_id").alias("ord"), F.col("rect").alias("frect"))
    assert spatial.nearest_field(labels.limit(0), fields, 1280, 720).collect() == []
    assert spatial.nearest_field(labels, fields.limit(0), 1280, 720).collect() == []
    assert spatial.by_rings(labels.limit(0), fields, 448).collect() == spatial.by_rings(labels, fields.limit(0), 448).collect() == []


def test_rings_equal_all_pairs(spark):
    rng = random.Random(6)
    box = lambda: (rng.randint(-50, 1300), rng.randint(-50, 900), rng.randint(1, 200), rng.randint(1, 60))
    labels = spark.createDataFrame([(k % 3, k, box()) for k in range(90)], "page_id int, label_id int, rect struct<x:int,y:int,width:int,height:int>")
    fields = spark.createDataFrame([(k % 4, k, k // 2, box()) for k in range(80)], "page_id int, field_id int, ord int, frect struct<x:int,y:int,width:int,height:int>")
    answers = [{tuple(r) for r in spatial.nearest_field(labels, fields, 1280, 720, few).collect()} for few in (1000, 0)]
    assert answers[0] == answers[1] and len(answers[0]) > 40
