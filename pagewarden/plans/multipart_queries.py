"""Uploads as multipart bodies derived from orders, beside SQL that has the status of each shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import multipart
from . import query, table

PROOF = '{"sanitized": true, "rawScreenshotIncluded": false, "redactionMap": []}'
#: Bytes of an image that looks like the end of a part but isn't one, with the order's key in it.
HEAD, TAIL = "89504E470D0A1A0A000D0A2D2D", "FFD8000D0A0D0A"


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, content_type, body: eight shapes by the order's key."""
    k = F.col("o_orderkey")
    s = k.cast("string")
    image = F.concat(F.unhex(F.lit(HEAD)), s.cast("binary"), F.unhex(F.lit(TAIL)))
    text = lambda v: (v if not isinstance(v, str) else F.lit(v)).cast("binary")
    proof, regions = ("privacy_proof", text(PROOF), None, None), ("redaction_regions", text(F.concat(F.lit("["), s, F.lit(", 2]"))), None, None)
    shot = ("image", image, "shot.jpeg", "image/jpeg")
    whole = multipart.form_body([shot, regions, proof], "b-1")
    shapes = [
        whole,
        multipart.form_body([("image", text("x"), "old.gif", "image/gif"), shot, regions, ("redaction_regions", text("[]"), None, None), proof], "b-1"),
        multipart.form_body([shot, regions], "b-1"),
        multipart.form_body([("image", image, "note", "text/plain"), proof], "b-1"),
        multipart.form_body([("image", image, None, None), proof], "b-1"),
        F.substring(whole, F.lit(1), F.length(whole) - 9),
        whole,
        F.concat(F.lit("preamble\r\n").cast("binary"), multipart.form_body([("image", image, "no_suffix", "image/png"), proof], "b-1")),
    ]
    body = F.element_at(F.array(*shapes), (k % 8 + 1).cast("int"))
    kind = F.when(k % 8 == 6, "application/json").otherwise(F.when(k % 16 == 0, 'multipart/form-data; boundary="b-1"; charset=x').otherwise("multipart/form-data; boundary=b-1"))
    return table(spark, sf_dir, "orders").select(k.alias("request_id"), kind.alias("content_type"), body.alias("body"))


_SIZE = f"{len(HEAD) // 2 + len(TAIL) // 2} + length(CAST(k AS VARCHAR))"


@query(f"""SELECT k AS request_id, ['OK', 'OK', 'PROOF_REQUIRED', 'NOT_AN_IMAGE', 'NO_IMAGE', 'UNTERMINATED', 'NOT_MULTIPART', 'OK'][k % 8 + 1] AS status, CASE WHEN k % 8 < 3 THEN '.jpeg' WHEN k % 8 IN (3, 7) THEN '.png' END AS suffix,
CASE k % 8 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 7 THEN 0 END AS regions, CASE WHEN k % 8 IN (0, 1, 2, 3, 7) THEN {_SIZE} END AS bytes FROM (SELECT o_orderkey AS k FROM orders)""")
def s9_multipart_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed rows of uploads, read from the bodies themselves."""
    return multipart.form_uploads(multipart.parts(bodies(spark, sf_dir)))


@query(f"""WITH b AS (SELECT o_orderkey AS k FROM orders), p AS (SELECT k, unnest(CASE k % 8 WHEN 0 THEN ['image', 'redaction_regions', 'privacy_proof'] WHEN 1 THEN ['image', 'image', 'redaction_regions', 'redaction_regions', 'privacy_proof'] WHEN 2 THEN ['image', 'redaction_regions']
WHEN 5 THEN ['image', 'redaction_regions'] WHEN 6 THEN [] ELSE ['image', 'privacy_proof'] END) AS name FROM b)
SELECT name, count(*) AS parts, CAST(sum(CASE WHEN name = 'image' AND NOT (k % 8 = 1 AND nth = 1) THEN {_SIZE} WHEN name = 'image' THEN 1 END) AS BIGINT) AS image_bytes FROM (SELECT *, row_number() OVER (PARTITION BY k, name) AS nth FROM p) GROUP BY name""")
def s9_form_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by name over all bodies, and the bytes of the images as they came."""
    found = multipart.parts(bodies(spark, sf_dir)).filter("name IS NOT NULL")
    return found.groupBy("name").agg(F.count("*").alias("parts"), F.sum(F.when(F.col("name") == "image", F.octet_length("payload"))).cast("long").alias("image_bytes"))
