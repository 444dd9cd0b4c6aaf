"""Typed reads of requests and of stored values: each row gets a status, and rejected rows keep their reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The address that is used where none, or no valid one, is stored.
DEFAULT_ENDPOINT = "http://127.0.0.1:9000/v1/agent"
HISTORY_SCHEMA = "array<struct<role:string,text:string>>"


def _kind(json: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), path, "variant"))


def proof_passes(proof: Column, with_map: bool = True) -> Column:
    """Whether a proof is an object with sanitized true and rawScreenshotIncluded false (booleans) and, if asked for, a list redactionMap."""
    get = lambda k: F.get_json_object(proof, f"$.{k}")
    ok = (_kind(proof, "$.sanitized") == "BOOLEAN") & (get("sanitized") == "true") & (_kind(proof, "$.rawScreenshotIncluded") == "BOOLEAN") & (get("rawScreenshotIncluded") == "false")
    return F.coalesce(ok & (_kind(proof, "$.redactionMap").startswith("ARRAY") if with_map else F.lit(True)), F.lit(False))


def uploads(rows: DataFrame) -> DataFrame:
    """``rows`` (request_id, content_type, file_name, redaction_regions, privacy_proof) with status, suffix and number of regions; the
    first fault in the order of the checks counts."""
    regions = F.coalesce("redaction_regions", F.lit("[]"))
    status = (
        F.when(F.coalesce("content_type", F.lit("")) == "", "NO_CONTENT_TYPE")
        .when(~F.col("content_type").startswith("image/"), "NOT_AN_IMAGE")
        .when(F.try_parse_json(F.coalesce("privacy_proof", F.lit(""))).isNull(), "PROOF_REQUIRED")
        .when(~proof_passes(F.col("privacy_proof")), "GATE_REJECTED")
        .when(F.try_parse_json(regions).isNull(), "INVALID_REGIONS")
        .when(~_kind(regions, "$").startswith("ARRAY"), "REGIONS_NOT_A_LIST")
        .otherwise("OK")
    )
    suffix = F.coalesce(F.nullif(F.regexp_extract(F.coalesce("file_name", F.lit("")), r"[^./](\.[^./]+)$", 1), F.lit("")), F.lit(".png"))
    found = rows.select("request_id", status.alias("status"), suffix.alias("suffix"), regions.alias("r"))
    return found.select("request_id", "status", "suffix", F.when(F.col("status") == "OK", F.size(F.from_json("r", "array<string>"))).alias("regions"))


def agent_requests(rows: DataFrame, schema: str) -> DataFrame:
    """``rows`` (request_id, body) read by ``schema``: intent, state and proof as columns, with status OK or the first fault."""
    body = F.from_json("body", schema)
    read = rows.select("request_id", "body", body.alias("b"))
    size = F.length("b.task_intent")
    status = (
        F.when(F.try_parse_json("body").isNull(), "INVALID_JSON")
        .when(F.col("b.task_intent").isNull() | ~size.between(1, 1000), "BAD_INTENT")
        .when(F.col("b.perception_state").isNull(), "NO_STATE")
        .when(~proof_passes(F.get_json_object("body", "$.privacy_proof"), with_map=False), "GATE_REJECTED")
        .otherwise("OK")
    )
    return read.select("request_id", status.alias("status"), F.col("b.task_intent").alias("task_intent"), F.col("b.perception_state").alias("perception_state"))


def endpoint(stored: Column) -> Column:
    """The stored address, trimmed, if it is an absolute http or https URL, else the default; a bare host gets its slash."""
    url = F.trim(F.coalesce(F.nullif(stored, F.lit("")), F.lit(DEFAULT_ENDPOINT)))
    whole = F.when(url.rlike(r"^(?i)https?://[^/?#\s]+$"), F.concat(url, F.lit("/"))).otherwise(url)
    return F.when(url.rlike(r"^(?i)https?://[^/?#\s]+([/?#]\S*)?$"), whole).otherwise(F.lit(DEFAULT_ENDPOINT))


def history(stored: Column) -> Column:
    """The messages of a stored history: array of structs (role, text); null where there are none."""
    read = F.from_json(stored, HISTORY_SCHEMA)
    return F.when(F.size(read) > 0, read)
