"""Spatial joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.sinks import scratch


def cells(r: Column, size: int, axis: str) -> Column:
    lo = F.floor(r[axis] / size).cast("int")
    hi = F.floor((r[axis] + r["width" if axis == "x" else "height"] - 1) / size).cast("int")
    return F.sequence(lo, F.greatest(lo, hi))


def overlap_join(elements: DataFrame, visuals: DataFrame, least: float = 0.3, cell: int = 256) -> DataFrame:
    """Pairs of ``elements`` (page_id, rect, ...) and ``visuals`` (page_id, vrect, ...) on one page whose overlap score is at least ``least``.

    Both sides are spread over the grid cells that they touch and joined on (page, cell), so the work of a large page is
    split; a pair that shares several cells is kept in the first, without a distinct.
    """
    grid = lambda df, r, p: df.withColumn(f"_{p}x", F.explode(cells(F.col(r), cell, "x"))).withColumn(f"_{p}y", F.explode(cells(F.col(r), cell, "y")))
    a, b = grid(elements, "rect", "e"), grid(visuals, "vrect", "v").withColumnRenamed("page_id", "_vpage")
    pairs = a.join(b, (F.col("page_id") == F.col("_vpage")) & (F.col("_ex") == F.col("_vx")) & (F.col("_ey") == F.col("_vy")))
    first = (F.col("_ex") == F.floor(F.greatest(F.col("rect.x"), F.col("vrect.x")) / cell)) & (F.col("_ey") == F.floor(F.greatest(F.col("rect.y"), F.col("vrect.y")) / cell))
    scored = pairs.filter(first).withColumn("score", G.overlap(F.col("rect"), F.col("vrect"))).filter(F.col("score") >= least)
    return scored.drop("_ex", "_ey", "_vx", "_vy", "_vpage")


#: Pixels of a cell of the ring search, and the radii (in cells) of its rounds up to the one that the reach asks for.
RING_CELL, RADII = 32, (1, 3, 7)


def _least_score(far: int) -> int:
    """The least score of a field whose centre is more than ``far`` pixels away on one axis: its distance less the largest bonuses."""
    return far - 50 if far >= 50 else 2 * far - 100


#: Fields of a page that each of its labels still meets one and all.
FEW_FIELDS = 256


def nearest_field(labels: DataFrame, fields: DataFrame, width: int, height: int, few: int = FEW_FIELDS) -> DataFrame:
    """For each label (page_id, label_id, rect) the best field (page_id, field_id, ord, frect): right of it or below,
    near, with a bonus for alignment; the first wins ties.  Labels of pages with up to ``few`` fields meet all of them, those of crowded pages search by rings.
    Labels and fields are merged: by the size of the files they were made from, which tells neither their number nor their size in memory, Spark would broadcast them.
    """
    spark, path = labels.sparkSession, f"{scratch(labels.sparkSession)}/crowded"
    fields.groupBy("page_id").count().filter(F.col("count") > few).select("page_id").write.parquet(path)
    crowded = spark.read.schema(fields.select("page_id").schema).parquet(path)
    some = not crowded.isEmpty()
    reach = max(width, height) * 0.35
    pairs = labels.join((fields.join(crowded, "page_id", "left_anti") if some else fields).hint("merge"), "page_id")
    found = _best(pairs, reach).select("page_id", "label_id", "m.field_id", "m.score")
    if not some:
        return found
    return found.unionByName(by_rings(labels.join(crowded, "page_id", "left_semi"), fields.join(crowded, "page_id", "left_semi"), reach))


def by_rings(labels: DataFrame, fields: DataFrame, reach: float) -> DataFrame:
    """``nearest_field`` for crowded pages.

    A search by rings of grid cells: labels and fields join by equality on the cell of a field's centre, first those near the label's own.  A
    label is done once its best score is less than any that a field beyond the ring could have, so on a crowded page none meets
    all fields; the reach of a label bounds the last ring.  Rounds are cut by tables in the shared folder.
    """
    spark, directory = labels.sparkSession, scratch(labels.sparkSession)
    cell = lambda c: F.floor(c / RING_CELL).cast("int")
    r, f = F.col("rect"), F.col("frect")
    placed = fields.select("page_id", "field_id", "ord", "frect", cell(G.centre_x(f)).alias("cx"), cell(G.centre_y(f)).alias("cy"))
    kinds = [fields.schema[c].dataType.simpleString() for c in ("ord", "field_id")]
    none = F.lit(None).cast(f"struct<score:double,ord:{kinds[0]},field_id:{kinds[1]}>")
    waiting = labels.select("page_id", "label_id", "rect", cell(G.centre_x(r)).alias("lx"), cell(G.centre_y(r)).alias("ly"), none.alias("best"))
    done, inner = None, -1
    last = int(reach // RING_CELL) + 1
    for k, radius in enumerate([*(x for x in RADII if x < last), last]):
        step = lambda c: F.explode(F.sequence(c - radius, c + radius))  # noqa: B023, E731
        ring = waiting.select("*", step(F.col("lx")).alias("cx")).select("*", step(F.col("ly")).alias("cy")).filter(F.greatest(F.abs(F.col("cx") - F.col("lx")), F.abs(F.col("cy") - F.col("ly"))) > inner)
        found = _best(ring.drop("best").join(placed.hint("merge"), ["page_id", "cx", "cy"]), reach)
        here = waiting.join(found.hint("merge"), ["page_id", "label_id"], "left").withColumn("best", F.least("best", F.when(F.col("m.score").isNotNull(), F.col("m")))).drop("m")
        here.write.parquet(f"{directory}/ring-{k}")
        here = spark.read.schema(here.schema).parquet(f"{directory}/ring-{k}")
        closed = F.col("best").isNotNull() & (F.col("best.score") < _least_score(radius * RING_CELL)) if radius < last else F.lit(True)
        ready = here.filter(F.coalesce(closed, F.lit(False)))
        done = ready if done is None else done.unionByName(ready)
        waiting, inner = here.filter(~F.coalesce(closed, F.lit(False))), radius
        if waiting.isEmpty():
            break
    return done.filter("best IS NOT NULL").select("page_id", "label_id", "best.field_id", "best.score")


def _best(pairs: DataFrame, reach: float) -> DataFrame:
    """The best field (m) of each label that has one.  Pairs without a score go, and boxes are dropped, before a task sorts them."""
    scored = pairs.select("page_id", "label_id", _field_score(reach).alias("m")).filter("m IS NOT NULL")
    return scored.groupBy("page_id", "label_id").agg(F.min("m").alias("m"))


def _field_score(reach: float) -> Column:
    """Struct (score, ord, field_id) of a label and a field; null if the field is neither beside nor below, or beyond reach."""
    a, b = F.col("rect"), F.col("frect")
    dx, dy = F.abs(G.centre_x(b) - G.centre_x(a)), F.abs(G.centre_y(b) - G.centre_y(a))
    beside, below = b["x"] >= G.right(a) - 5, b["y"] >= G.bottom(a) - 5
    distance = dx + dy + G.gap_x(a, b) + G.gap_y(a, b)
    bonus = F.when(beside, F.greatest(F.lit(0.0), 50 - dy)).otherwise(0.0) + F.when(below, F.greatest(F.lit(0.0), 50 - dx)).otherwise(0.0)
    return F.when((beside | below) & (distance <= reach), F.struct((distance - bonus).alias("score"), "ord", "field_id"))
