"""Queries of requests, stored values, sinks and compact states over rows derived from orders, customer, supplier and events, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import state as S
from ..sources import pages as P
from ..sources import requests as R
from ..sources import sinks
from . import query, table
from .form_queries import BASE, LABEL, SCANNED, TEXT, form_pages


def _pick(k, *values):
    """The value at ``k`` modulo their number; a null stays null."""
    out = None
    for i, v in enumerate(values):
        v = v if v is not None else F.lit(None).cast("string")
        out = F.when(k % len(values) == i, v) if out is None else out.when(k % len(values) == i, v)
    return out


@query("""SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 7 = 0 THEN 'NO_CONTENT_TYPE' WHEN o_orderkey % 7 = 1 THEN 'NO_CONTENT_TYPE' WHEN o_orderkey % 7 = 2 THEN 'NOT_AN_IMAGE' WHEN o_orderkey % 5 = 0 THEN 'PROOF_REQUIRED' WHEN o_orderkey % 5 < 4 THEN 'GATE_REJECTED'
WHEN o_orderkey % 3 = 0 THEN 'INVALID_REGIONS' WHEN o_orderkey % 3 = 1 THEN 'REGIONS_NOT_A_LIST' ELSE 'OK' END AS status, CASE o_orderkey % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.png' ELSE '.gz' END AS suffix,
CASE WHEN o_orderkey % 7 > 2 AND o_orderkey % 5 = 4 AND o_orderkey % 3 = 2 THEN 2 END AS regions FROM orders""")
def s9_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    proof = _pick(k, F.lit("not json"), F.lit('{"sanitized": "true", "rawScreenshotIncluded": false, "redactionMap": []}'), F.lit('{"sanitized": true, "rawScreenshotIncluded": false, "redactionMap": {}}'), F.lit("[1]"), F.lit('{"sanitized": true, "rawScreenshotIncluded": false, "redactionMap": [1]}'))
    rows = table(spark, sf_dir, "orders").select(
        k.alias("request_id"), _pick(k, None, F.lit(""), F.lit("text/html"), *[F.lit("image/png")] * 4).alias("content_type"),
        _pick(k, F.concat(F.lit("a/shot."), k.cast("string"), F.lit(".jpg")), None, F.lit("shot"), F.lit("x.tar.gz")).alias("file_name"),
        _pick(k, F.lit("["), F.lit('{"a": 1}'), F.lit('[{"x": 1}, {"x": 2}]')).alias("redaction_regions"), proof.alias("privacy_proof"),
    )
    return R.uploads(rows)


AGENT_SCHEMA = "task_intent string, perception_state struct<page:struct<url:string,title:string>>, privacy_proof string"


@query("""SELECT o_orderkey AS request_id, CASE o_orderkey % 6 WHEN 0 THEN 'INVALID_JSON' WHEN 1 THEN 'BAD_INTENT' WHEN 2 THEN 'BAD_INTENT' WHEN 3 THEN 'NO_STATE' WHEN 4 THEN 'GATE_REJECTED' ELSE 'OK' END AS status,
CASE WHEN o_orderkey % 6 > 2 THEN 'do ' || o_orderkey END AS task_intent, CASE WHEN o_orderkey % 6 > 3 THEN 'https://h.org/' || o_orderkey END AS url FROM orders""")
def s12_agent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    state = F.concat(F.lit(', "perception_state": {"page": {"url": "https://h.org/'), s, F.lit('", "title": "t"}}'))
    intent = F.concat(F.lit('{"task_intent": "do '), s, F.lit('"'))
    good, bad = F.lit(', "privacy_proof": {"sanitized": true, "rawScreenshotIncluded": false}}'), F.lit(', "privacy_proof": {"sanitized": true}}')
    body = _pick(k, F.lit("{"), F.concat(F.lit('{"x": 1'), good), F.concat(F.lit('{"task_intent": ""'), good), F.concat(intent, good), F.concat(intent, state, bad), F.concat(intent, state, good))
    read = R.agent_requests(table(spark, sf_dir, "orders").select(k.alias("request_id"), body.alias("body")), AGENT_SCHEMA)
    return read.select("request_id", "status", F.nullif(F.col("task_intent"), F.lit("")).alias("task_intent"), F.col("perception_state.page.url").alias("url"))


@query("""SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN 'https://api.org/' || c_custkey WHEN c_custkey % 6 = 1 THEN 'http://api' || c_custkey || '.org/' ELSE 'http://127.0.0.1:9000/v1/agent' END AS endpoint, CASE WHEN c_custkey % 3 = 0 THEN 2 END AS messages, CASE WHEN c_custkey % 3 = 0 THEN 'm' || c_custkey END AS last_text FROM customer""")
def s13_stored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    url = _pick(k, F.concat(F.lit("  https://api.org/"), s, F.lit(" ")), F.concat(F.lit("http://api"), s, F.lit(".org")), F.concat(F.lit("ftp://api.org/"), s), F.lit("not a url"), None, F.lit(""))
    kept = _pick(k, F.concat(F.lit('[{"role": "user", "text": "a"}, {"role": "agent", "text": "m'), s, F.lit('"}]')), F.lit("[]"), None)
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), R.endpoint(url).alias("endpoint"), R.history(kept).alias("h"))
    return rows.select("id", "endpoint", F.when(F.col("h").isNotNull(), F.size("h")).alias("messages"), F.try_element_at("h", F.lit(-1))["text"].alias("last_text"))


@query("SELECT event_type, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY event_type")
def k1_latest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report written over an older one and read back."""
    path, e = sinks.scratch(spark), table(spark, sf_dir, "events")
    sinks.write_report(e.groupBy("event_type").agg(F.lit(0).alias("n"), F.min("event_id").alias("last_event")), path)
    sinks.write_report(e.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event")), path)
    return spark.read.schema("event_type string, n long, last_event long").json(path)


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def k3_keyed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values put by key in three batches, the last of them a stream that finds one batch a second time; the latest of each key is read back."""
    path, e = sinks.scratch(spark), table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    for k in (1, 0):
        sinks.upsert(e.filter(F.col("event_id") % 3 == k), f"{path}/table", "user_id", ["ts", "event_id"])
    e.filter(F.col("event_id") % 3 > 0).write.parquet(f"{path}/in")
    sinks.upsert_stream(spark.readStream.schema(e.schema).parquet(f"{path}/in"), f"{path}/table", "user_id", ["ts", "event_id"], f"{path}/checkpoint").awaitTermination()
    return sinks.read_latest(spark, f"{path}/table", e.schema).select("user_id", "event_id", "event_type")


@query("""SELECT s_suppkey // 2 AS page_id, count(*) FILTER (s_suppkey % 3 = 0) AS "facesDetected", bool_or(s_suppkey % 3 = 0 AND s_suppkey % 5 = 0) AS "faceDetectionFailed", count(*) FILTER (s_suppkey % 3 = 1) AS "objectsDetected", count(*) FILTER (s_suppkey % 3 = 2 AND s_suppkey % 2 = 0) AS "ocrPiiDetected" FROM supplier GROUP BY 1""")
def a9_detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    found = table(spark, sf_dir, "supplier").select(F.floor(k / 2).alias("page_id"), _pick(k, F.lit("face"), F.lit("object"), F.lit("text")).alias("kind"), (k % 5 == 0).alias("failed"), (k % 2 == 0).alias("pii"))
    return S.detection_summary(found, "page_id")


@query(f"""SELECT page_id, 'element_' || n AS element_id, CASE ord WHEN 6 THEN '<EMAIL_1>' ELSE {TEXT} END AS text, CASE ord WHEN 8 THEN 'Your colour' END AS placeholder, nullif({LABEL}, '') AS label, CASE ord WHEN 15 THEN 'link' WHEN 16 THEN 'button' END AS role, CASE ord WHEN 10 THEN 'Secret' END AS aria_label,
CASE ord WHEN 6 THEN '<EMAIL_1>' WHEN 10 THEN 'Secret' WHEN 12 THEN 'Send it' ELSE {TEXT} END AS name, ord = 8 AND off AS disabled FROM {SCANNED}""")
def p9_compact_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = P.page_elements(form_pages(spark, sf_dir)).select("page_id", S.compact_element().alias("e"))
    return e.select("page_id", F.col("e.elementId").alias("element_id"), "e.text", "e.placeholder", "e.label", "e.accessibility.role", F.col("e.accessibility.ariaLabel").alias("aria_label"), F.col("e.accessibility.accessibleName").alias("name"), "e.accessibility.disabled")


VISUAL = "visual_item_id string, text string, type string, class string, category string, label string, confidence double, score double, rect struct<x:int,y:int,width:int,height:int>, element_ids array<string>"


def visual_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, kind and item: three items for each customer's page."""
    k, s = F.col("c_custkey"), (F.col("c_custkey") % 100).cast("string")
    r = F.struct((k % 100).cast("int").alias("x"), F.lit(2).alias("y"), F.lit(30).alias("width"), F.lit(4).alias("height"))
    none, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    ids = F.when(k % 2 == 0, F.array(F.lit("element_1"))).otherwise(F.array().cast("array<string>"))

    def item(name, body, kind, klass, group, label, sure, score):
        return F.struct(F.concat(F.lit(name), s).alias("visual_item_id"), body.alias("text"), kind.alias("type"), klass.alias("class"), group.alias("category"), label.alias("label"), sure.alias("confidence"), score.alias("score"), r.alias("rect"), ids.alias("element_ids"))

    text_item = item("t", F.concat(F.lit("mail a"), s, F.lit("@b.org")), none, none, none, none, number, number)
    region = item("r", none, F.when(k % 3 == 0, "card").otherwise(""), none, F.when(k % 3 == 1, "face"), none, number, number)
    thing = item("o", none, none, none, F.when(k % 2 == 1, "animal"), F.when(k % 4 == 0, "cat"), F.when(k % 5 == 0, 0.5), F.lit(0.25))
    return table(spark, sf_dir, "customer").select(k.alias("page_id"), text_item.alias("t"), region.alias("r"), thing.alias("o"))


VISUALS_SQL = """SELECT c_custkey AS page_id, 'mail <EMAIL_1>' AS text, CASE c_custkey % 3 WHEN 0 THEN 'card' WHEN 1 THEN 'face' ELSE 'visual_region' END AS region, CASE WHEN c_custkey % 4 = 0 THEN 'cat' WHEN c_custkey % 2 = 1 THEN 'animal' ELSE 'object' END AS object,
CASE WHEN c_custkey % 5 = 0 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS confidence, c_custkey % 100 AS x, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS mapped FROM customer"""


@query(VISUALS_SQL)
def p9_compact_visuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visual_items(spark, sf_dir).select("page_id", S.compact_text(F.col("t")).alias("t"), S.compact_region(F.col("r")).alias("r"), S.compact_object(F.col("o")).alias("o"))
    return v.select("page_id", "t.text", F.col("r.type").alias("region"), F.col("o.class").alias("object"), "o.confidence", F.col("t.rect.x").alias("x"), F.size("o.mappedElementIds").alias("mapped"))


@query(f"""SELECT page_id, 'https://host.org/' || k AS url, 'Account ' || m AS title, CASE WHEN hidden THEN 6 ELSE 7 END AS elements, 'f' AS first_form, CASE WHEN hidden THEN 4 ELSE 5 END AS controls, true AS sanitized, true AS pii, 1 AS redacted, false AS raw, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS mapped, '<EMAIL_1>' AS first_text, 'Edit ' || m AS last_text FROM {BASE}""")
def p8_compact_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each page, with what its parts hold taken out again."""
    items = visual_items(spark, sf_dir).select("page_id", F.array(S.compact_text(F.col("t"))).alias("texts"), F.array(S.compact_region(F.col("r"))).alias("regions"), F.array(S.compact_object(F.col("o"))).alias("objects"))
    s = S.compact_state(form_pages(spark, sf_dir), items).select("page_id", "state.*")
    return s.select(
        "page_id", "page.url", "page.title", F.col("summary.interactiveElements").alias("elements"), F.substring(F.col("forms")[0]["formId"], 1, 1).alias("first_form"), F.size(F.col("forms")[0]["controls"]).alias("controls"), "privacy.sanitized",
        F.col("privacy.piiDetected").alias("pii"), F.col("privacy.redactedRegionCount").alias("redacted"), F.col("privacy.rawScreenshotIncluded").alias("raw"), F.col("summary.mappedObjects").alias("mapped"),
        F.col("interactiveElements")[0]["text"].alias("first_text"), F.element_at("interactiveElements", -1)["text"].alias("last_text"),
    )
