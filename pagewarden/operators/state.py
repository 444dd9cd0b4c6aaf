"""Compact projections of a page for a request, and the state that they make up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..sources import pages as P


def _clean(c: Column) -> Column:
    """Sanitised text, null where nothing is left."""
    return text.truthy(text.sanitize(c))


def compact_element() -> Column:
    """Struct of an element of ``pages.page_elements``: identity, sanitised texts, accessibility."""
    access = F.struct(P.attribute("role").alias("role"), _clean(P.attribute("aria-label")).alias("ariaLabel"), _clean(P.accessible_name()).alias("accessibleName"), F.try_element_at("attrs", F.lit("disabled")).isNotNull().alias("disabled"))
    return F.struct(F.col("element_id").alias("elementId"), "tag", "category", P.attribute("type").alias("type"), text.sanitize("text").alias("text"), _clean(P.attribute("placeholder")).alias("placeholder"), _clean(F.col("label")).alias("label"), access.alias("accessibility"))


def compact_control(c: Column) -> Column:
    """Struct of a control of ``pages.forms``."""
    return F.struct(c["control_id"].alias("controlId"), c["tag"].alias("tag"), c["type"].alias("type"), c["name"].alias("name"), _clean(c["placeholder"]).alias("placeholder"), _clean(c["label"]).alias("label"))


def compact_text(item: Column) -> Column:
    """Struct of a recognised text (visual_item_id, text, rect, element_ids)."""
    return F.struct(item["visual_item_id"].alias("visualItemId"), text.sanitize(F.coalesce(item["text"], F.lit(""))).alias("text"), item["rect"].alias("rect"), item["element_ids"].alias("mappedElementIds"))


def compact_region(item: Column) -> Column:
    """Struct of a region; its kind is the first of type, class, category and label that is there."""
    kind = text.first_truthy(item["type"], item["class"], item["category"], item["label"], F.lit("visual_region"))
    return F.struct(item["visual_item_id"].alias("visualItemId"), kind.alias("type"), item["rect"].alias("rect"), item["element_ids"].alias("mappedElementIds"))


def compact_object(item: Column) -> Column:
    """Struct of an object; its class is the first of class, label and category, its confidence the score where it has none."""
    kind = text.first_truthy(item["class"], item["label"], item["category"], F.lit("object"))
    return F.struct(item["visual_item_id"].alias("visualItemId"), kind.alias("class"), F.coalesce(item["confidence"], item["score"]).alias("confidence"), item["rect"].alias("rect"), item["element_ids"].alias("mappedElementIds"))


def detection_summary(found: DataFrame, page: str) -> DataFrame:
    """One row a page of ``found`` (page, kind, failed, pii): faces and objects counted, whether face detection failed, texts with personal data."""
    return found.groupBy(page).agg(F.count_if(F.col("kind") == "face").alias("facesDetected"), F.bool_or((F.col("kind") == "face") & F.col("failed")).alias("faceDetectionFailed"), F.count_if(F.col("kind") == "object").alias("objectsDetected"), F.count_if((F.col("kind") == "text") & F.col("pii")).alias("ocrPiiDetected"))


def compact_state(pages: DataFrame, visuals: DataFrame) -> DataFrame:
    """page_id and ``state``: the struct that a request sends, without any raw text or picture.

    ``visuals`` has one row a page: page_id and the arrays texts, regions and objects of compact structs.
    """
    # One parse a page and one aggregation: an element is a member of the list of elements, a control of the list of controls, or both.
    seen = P.selected() & P.visible()
    every = P.elements(pages).select("*", seen.alias("seen"), (P.visible() & F.col("tag").isin(*P.CONTROLS) & F.col("form").isNotNull()).alias("held"))
    every = P.described(every.filter("seen OR held")).withColumn("element_id", F.lit(""))
    element, control = F.struct("ord", P.interactive().alias("interactive"), compact_element().alias("e")), F.struct("form_no", P.control().alias("c"))
    lists = every.groupBy("page_id").agg(F.array_sort(F.collect_list(F.when(F.col("seen"), element)), lambda a, b: a["ord"] - b["ord"]).alias("seen"), F.array_sort(F.collect_list(F.when(F.col("held"), control)), lambda a, b: a["c"]["ord"] - b["c"]["ord"]).alias("held"))
    named = F.transform("seen", lambda x, i: F.struct(x["interactive"], x["e"].withField("elementId", F.concat(F.lit("element_"), (i + 1).cast("string"))).alias("e")))
    lists = lists.select("page_id", "held", F.filter(named, lambda x: x["interactive"])["e"].alias("elements"))
    masked = F.when(F.size("elements") > 0, F.size(F.filter("elements", lambda e: e["text"].contains("_1>"))).cast("long"))
    of_form = lambda n: F.transform(F.filter("held", lambda c: c["form_no"] == n)["c"], lambda c, i: compact_control(P.numbered_control(P.form_id(n), c, i)))
    by_name = lambda a, b: F.when(a["formId"] < b["formId"], -1).otherwise(1)
    held = F.array_sort(F.transform(F.array_distinct("held.form_no"), lambda n: F.struct(P.form_id(n).alias("formId"), of_form(n).alias("controls"))), by_name)
    lists = lists.select("page_id", F.when(F.size("elements") > 0, F.col("elements")).alias("elements"), masked.alias("masked"), F.when(F.size("held") > 0, held).alias("forms"))
    title = text.sanitize(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)))
    rows = pages.select("page_id", urls.sanitize_url(F.col("url")).alias("url"), title.alias("title")).join(lists, "page_id", "left").join(visuals, "page_id", "left")
    n = lambda c: F.greatest(F.size(c), F.lit(0))
    mapped = lambda c: F.greatest(F.size(F.filter(c, lambda v: F.size(v["mappedElementIds"]) > 0)), F.lit(0))
    privacy = F.struct(F.lit(True).alias("sanitized"), (F.coalesce("masked", F.lit(0)) > 0).alias("piiDetected"), F.coalesce("masked", F.lit(0)).alias("redactedRegionCount"), F.lit(False).alias("rawScreenshotIncluded"))
    summary = F.struct(n("elements").alias("interactiveElements"), n("forms").alias("forms"), n("texts").alias("visualTextRegions"), mapped("texts").alias("mappedTextRegions"), n("regions").alias("visualRegions"), mapped("regions").alias("mappedVisualRegions"), n("objects").alias("objects"), mapped("objects").alias("mappedObjects"))
    return rows.select("page_id", F.struct(F.struct("url", "title").alias("page"), F.col("elements").alias("interactiveElements"), "forms", F.col("texts").alias("visualText"), F.col("regions").alias("visualRegions"), "objects", privacy.alias("privacy"), summary.alias("summary")).alias("state"))
