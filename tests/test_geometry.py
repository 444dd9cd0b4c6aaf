"""Suppression keeps a clash-free subset; the spatial join equals a nested loop."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pagewarden.functions import geometry as G
from pagewarden.operators import spatial


def boxes(n, seed):
    rng = random.Random(seed)
    return [(k % 2, k, rng.randint(0, 300), rng.randint(0, 300), rng.randint(1, 200), rng.randint(1, 200)) for k in range(n)]


def overlap(a, b):
    w, h = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
    return max(0, w) * max(0, h)


def iou(a, b):
    common = overlap(a, b)
    return common / (a[4] * a[5] + b[4] * b[5] - common)


def test_overlap_join_equals_nested_loop(spark):
    schema = "page_id int, id int, x int, y int, width int, height int"
    a, b = boxes(60, 1), boxes(50, 2)
    left = spark.createDataFrame(a, schema).select("page_id", "id", G.rect("x", "y", "width", "height").alias("rect"))
    right = spark.createDataFrame(b, schema).select("page_id", F.col("id").alias("vid"), G.rect("x", "y", "width", "height").alias("vrect"))
    got = sorted((r.id, r.vid) for r in spatial.overlap_join(left, right, 0.3, cell=64).collect())
    assert got == sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and overlap(p, q) / (q[4] * q[5]) >= 0.3)


def test_suppression_equals_greedy_loop(spark):
    rows = boxes(80, 3)
    one = F.struct("id", "x", "y", "width", "height")
    whole = spark.createDataFrame(rows, "page_id int, id int, x int, y int, width int, height int").groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("b"))
    got = whole.select("page_id", F.explode(G.suppressed(F.col("b"), lambda k, b: G.iou(k, b) >= 0.3)).alias("k")).select("page_id", "k.id").collect()
    kept = []
    for r in rows:
        if not any(k[0] == r[0] and iou(k, r) >= 0.3 for k in kept):
            kept.append(r)
    assert sorted((r.page_id, r.id) for r in got) == sorted((k[0], k[1]) for k in kept)
