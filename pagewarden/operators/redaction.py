"""Redaction maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def strategy(category: Column) -> Column:
    return F.when(category == "FACE", "BLUR").otherwise("BLACKOUT")


def box_ok(box: Column) -> Column:
    """All four numbers finite, both sides positive."""
    finite = F.lit(True)
    for k in ("x", "y", "width", "height"):
        v = box[k].cast("double")
        finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return F.coalesce(finite & (box["width"] > 0) & (box["height"] > 0), F.lit(False))


def redaction_map(detections: DataFrame) -> DataFrame:
    """``detections`` (category, rect, ...) with a drawable box, and the strategy of each."""
    r = F.col("rect")
    return detections.filter((r["width"] > 0) & (r["height"] > 0)).withColumn("strategy", strategy(F.col("category")))
