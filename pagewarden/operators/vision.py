"""What a picture's recognised texts and regions tell, given as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text
from .spatial import nearest_field


def input_like(region: Column, width: int, height: int) -> Column:
    aspect = region["width"] / F.greatest(region["height"], F.lit(1))
    return (region["width"] / F.lit(width) >= 0.08) & (region["height"] / F.lit(height)).between(0.02, 0.20) & (aspect >= 1.5)


def sensitive_information(texts: DataFrame, regions: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, text_id, type, severity, detection_source, region_id, box.

    ``texts`` has image_id, text_id, text and corners, ``regions`` image_id, region_id and a rectangle.  Labels take their
    nearest input-like field's box; texts that match a pattern count by themselves; of the same type, boxes that all but coincide
    count once, in order of text.  What a picture has is merged, never broadcast, as in ``nearest_field``.
    """
    own = texts.withColumn("rect", G.from_corners(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    fields = regions.withColumn("frect", G.rect("x", "y", "width", "height")).filter(input_like(F.col("frect"), width, height)).select(F.col("image_id").alias("page_id"), F.col("region_id").alias("field_id"), F.col("region_id").alias("ord"), "frect")
    near = nearest_field(own.select(F.col("image_id").alias("page_id"), F.col("text_id").alias("label_id"), "rect"), fields, width, height)
    near = near.join(fields.select("page_id", "field_id", "frect").hint("merge"), ["page_id", "field_id"]).select(F.col("page_id").alias("image_id"), F.col("label_id").alias("text_id"), F.col("field_id").alias("region_id"), "frect")
    labels = own.select("image_id", "text_id", "rect", F.explode(text.label_categories(F.col("text"))).alias("c")).join(near.hint("merge"), ["image_id", "text_id"], "left")
    labels = labels.select("image_id", "text_id", F.col("c.type").alias("type"), F.col("c.severity").alias("severity"), F.when(F.col("region_id").isNotNull(), "LABEL_AND_UI_CONTEXT").otherwise("SENSITIVE_LABEL").alias("detection_source"), "region_id", F.coalesce("frect", "rect").alias("box"))
    hits = own.select("image_id", "text_id", "rect", F.explode(text.pattern_categories(F.col("text"))).alias("c"))
    hits = hits.select("image_id", "text_id", F.col("c.type").alias("type"), F.col("c.severity").alias("severity"), F.lit("TEXT_PATTERN").alias("detection_source"), F.lit(None).cast("int").alias("region_id"), F.col("rect").alias("box"))
    one = F.struct("text_id", "detection_source", "type", "severity", "region_id", F.col("box.x").alias("x"), F.col("box.y").alias("y"), F.col("box.width").alias("width"), F.col("box.height").alias("height"))
    whole = labels.unionByName(hits).groupBy("image_id", "type").agg(F.array_sort(F.collect_list(one)).alias("all"))
    kept = whole.select("image_id", F.explode(G.suppressed(F.col("all"), lambda k, b: G.iou(k, b) >= 0.85)).alias("k"))
    return kept.select("image_id", "k.text_id", "k.type", "k.severity", "k.detection_source", "k.region_id", G.rect("k.x", "k.y", "k.width", "k.height").alias("box"))


# Words of an identity card and of its sides, and zones of its picture as shares of it.
CARD_WORDS = "aadhaar|aadhar|unique identification|government of india"
FRONT_WORDS = r"\bdob\b|date of birth|female|male|vid"
BACK_WORDS = r"\baddress\b|\bs/?o\b|\bd/?o\b|\bc/?o\b|\b\d{6}\b"
FRONT = [("FACE", 0.05, 0.20, 0.29, 0.48), ("PERSON", 0.31, 0.20, 0.47, 0.28), ("GOVERNMENT_ID", 0.28, 0.68, 0.48, 0.18)]
BACK = [("ADDRESS", 0.04, 0.28, 0.58, 0.48), ("GOVERNMENT_ID", 0.28, 0.76, 0.48, 0.14)]


def card_zones(words: Column, target: Column) -> Column:
    """Zones to protect if the words are those of an identity card: array of structs (category, rect)."""
    low = F.lower(F.coalesce(words, F.lit("")))
    zones = lambda table: F.array(*[F.struct(F.lit(c).alias("category"), G.zone(target, *z).alias("rect")) for c, *z in table])
    none = F.slice(zones(FRONT), 1, 0)
    card = low.rlike(CARD_WORDS)
    front = card & low.rlike(FRONT_WORDS)
    back = card & low.rlike(BACK_WORDS)
    return F.concat(F.when(front, zones(FRONT)).otherwise(none), F.when(back, zones(BACK)).otherwise(none))


def confident(texts: DataFrame, image: str, order: str, least: float = 0.30) -> DataFrame:
    """Texts that are not blank and whose ``confidence`` is ``least`` or more, numbered for each image as ``text_id``."""
    kept = texts.filter((F.col("confidence") >= least) & (F.trim("text") != ""))
    return kept.withColumn("text_id", F.row_number().over(Window.partitionBy(image).orderBy(order)))
