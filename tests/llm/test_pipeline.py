"""The pipeline's stages chain, keep their columns, and their decisions take effect."""

from __future__ import annotations

import hashlib
import os

import pytest

import corpus_pipeline
from pagewarden.llm import queries

from ..compare import assert_same

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def test_stages_take_effect(spark):
    body = " ".join(f"word{k} other{k % 7}" for k in range(60))
    near = body.replace("word7 ", "changed ")
    secret = hashlib.sha1(b"s").hexdigest()
    rows = [(1, body, "en", "a", 1), (2, near, "en", "a", 1), (3, "short", "en", "b", 1), (4, " ".join(f"x{k}" for k in range(90)) + f' token = "{secret}"', "en", "b", 1), (5, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, "")
    assert {r.doc_id for r in kept.collect()} == {1, 2, 4} and kept.columns == docs.columns
    first = stages["near_duplicates"](spark, kept, "")
    assert {r.doc_id for r in first.collect()} == {1, 4} and first.columns == docs.columns
    masked = stages["secrets"](spark, first, "")
    assert not any(secret in r.text for r in masked.collect()) and masked.columns == docs.columns
    mixed = stages["mixing"](spark, masked, "")
    assert mixed.columns == docs.columns
    out = stages["encoding"](spark, masked, "").collect()
    assert {r.doc_id for r in out} == {1, 4} and all(r.n_tokens == len(r.ids) for r in out)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_each_stage_on_empty_and_odd_tables(spark, name):
    """No rows; rows without doc_id, text or source; repeated rows; a column with a name that the stages use themselves."""
    stage, schema = dict(corpus_pipeline.STAGES)[name], "doc_id long, text string, lang string, source string, n_chars long, row string"
    assert stage(spark, spark.createDataFrame([], schema), "").count() == 0
    body = " ".join(f"word{k} other{k % 7}" for k in range(60))
    rows = [(None, body, None, None, None, "r"), (1, body, "en", "a", 5, "r"), (1, body, "en", "a", 5, "r"), (2, None, "en", None, None, "r"), (2, "", None, "b", 0, "r"), (None, None, None, None, None, None)]
    got = stage(spark, spark.createDataFrame(rows, schema), "")
    seen = [r.doc_id for r in got.collect()]
    if name == "quality":  # three texts have words enough
        assert sorted(map(str, seen)) == ["1", "1", "None"]
    elif name == "mixing":  # sources without tokens are taken by no pass
        assert seen.count(1) % 2 == 0 and set(seen) <= {None, 1, 2}
    else:
        assert sorted(map(str, seen)) == ["1", "1", "2", "2", "None", "None"]
    if name != "encoding":
        assert got.columns == [c.split()[0] for c in schema.split(", ")] and {r.row for r in got.collect()} <= {"r", None}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)
