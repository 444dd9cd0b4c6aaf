"""Vectors of the text rules, worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagewarden.functions import rules, text

LIVE = [
    ("a@b.com", "<EMAIL_1>"), ("rohan@okbank", "<UPI_ID_1>"), ("password: hunter2, ok", "<PASSWORD_1>, ok"), ("password reset page", "<PASSWORD_1> page"), ("1234567890123456", "123456<PHONE_1>"),
    ("1234 5678 9012 3456", "<CARD_NUMBER_1>"), ("234567890123", "<GOVERNMENT_ID_1>"), ("+919876543210", "<PHONE_1>"), ("+91 9876543210", "<PHONE_1>"), ("", ""), (None, ""), ("é9876543210", "é<PHONE_1>"),
]
LEGACY = [("a@b.com", "<EMAIL_1>"), ("1234 5678 9012 3456", "<AADHAAR_1> 3456"), ("1234567890123456", "<CREDIT_CARD_1>"), ("+919876543210", "+<AADHAAR_1>"), ("+91 9876543210", "+91 <PHONE_NUMBER_1>"), ("rohan@okbank", "rohan@okbank")]


@pytest.mark.parametrize("function, vectors", [(text.sanitize, LIVE), (text.sanitize_legacy, LEGACY)])
def test_redaction(spark, function, vectors):
    rows = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(vectors)], "k int, t string").select("k", function(F.col("t")).alias("o")).collect()
    assert {r.k: r.o for r in rows} == {k: e for k, (_, e) in enumerate(vectors)}


def test_second_pass_is_not_idempotent(spark):
    row = spark.createDataFrame([("password: hunter2, ok",)], "t string").select(text.sanitize(text.sanitize(F.col("t"))).alias("o")).first()
    assert row.o == "<<PASSWORD_1>, ok"


def test_match_offsets_point_at_the_values(spark):
    body = "x ab@b.com y 9876543210 and c@d.org, 1234 5678 9012 3456"
    found = spark.createDataFrame([(body,)], "t string").select(F.explode(text.matches(F.col("t"))).alias("m")).select("m.*").collect()
    assert found and all(body[m.start : m.end] == m.value for m in found)
    assert [m.category for m in found if m.value == "ab@b.com"] == ["EMAIL", "EMAIL"]


def test_metadata_patterns_only_without_value(spark):
    rows = spark.createDataFrame([("a@b.com", "red"), ("a@b.com", ""), ("hotel", "x")], "m string, v string").select(text.classify(F.col("m"), F.col("v"))["category"].alias("c")).collect()
    assert [r.c for r in rows] == [None, "EMAIL", "PHONE"]


def test_relevant_text_fills_its_budget(spark):
    body = " ".join(f"sentence {k} {'goal ' if k % 9 == 0 else ''}with some words." for k in range(80))
    row = spark.createDataFrame([(body,)], "t string").select(text.relevant_text(F.col("t"), F.array(F.lit("goal"))).alias("o")).first()
    assert len(row.o) == 800 and row.o.startswith("sentence 0 goal")


@pytest.mark.parametrize("name", ["t4_match_places", "t4_match_values"])
def test_identity_numbers_are_left_to_the_offsets(spark, tmp_path, name):
    """The SQL of these two has no pattern for identity numbers; t4_match_offsets tells them."""
    from pagewarden import registry

    from .compare import assert_same

    rows = [(1, "number 2266 6802 0056 here"), (2, "226668020056 and a@b.com"), (3, "ABCDE1234F"), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).toPandas().to_parquet(f"{tmp_path}/documents.parquet")
    assert_same(spark, registry.queries()[name], registry.oracle_sql()[name], str(tmp_path))
    offsets = registry.queries()["t4_match_offsets"](spark, str(tmp_path)).filter("origin = 'd'")
    assert {(r.id, r.value) for r in offsets.collect()} >= {(1, "2266 6802 0056"), (2, "226668020056"), (3, "ABCDE1234F")}


def test_rules_read_a_line_once_and_words_share_their_beginnings(spark):
    rows = spark.createDataFrame([("a road", "x")], "l string, f string").select(text.line_class(F.col("l"), F.col("f")).alias("c"))
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1 and rows.first().c == "ADDRESS"
    words = ["pin", "pin code", "pan", "e-mail", "e.g", "otp"]
    found = spark.createDataFrame([(t,) for t in ["a pin", "pi n", "xpanx", "e-mail", "exg", "ot", "otp", ""]], "t string").select(F.col("t").rlike(rules.one_of(words)).alias("h")).collect()
    assert [r.h for r in found] == [True, False, True, True, False, False, True, False]
    labels = ["my Full  name", "account holder x", "TELEPHONE", "home address", "date of birth", "e-mail", "account no", "IFSC code", "upi", "debit card", "Aadhar", "access token", "birth"]
    got = [r.c for r in spark.createDataFrame([(t,) for t in labels], "t string").select(text.value_label(F.col("t"))["category"].alias("c")).collect()]
    assert got == ["PERSON", "PERSON", "PHONE", "ADDRESS", "DATE_OF_BIRTH", "EMAIL", "BANK_ACCOUNT", "IFSC", "UPI_ID", "CARD_NUMBER", "GOVERNMENT_ID", "API_KEY", None]


@pytest.mark.parametrize("name", ["f4_customer_targets", "m13_customer_pictures"])
def test_a_table_of_one_file_is_dealt_over_the_cores(spark, name):
    from pagewarden import registry

    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
    assert "Repartition" in plan
