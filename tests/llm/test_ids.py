"""Identifiers above 2^53 stay what they are beside a null in one Arrow batch."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagewarden.llm import language_codes, ngram_join, pieces, suffix_dedup, token_files, warc_bundles

tokenizers_ = pytest.importorskip("public_tokenizers")
LARGE, OTHER = 2**53 + 1, 2**53 + 3
TEXT = "some words that are shared by all of these rows and repeat in each of them, again and again " * 2


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(LARGE, TEXT, "en"), (None, TEXT, "en"), (OTHER, TEXT + "end", "en"), (7, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)


def ids(df, column="doc_id") -> set:
    return {r[0] for r in df.select(column).collect()}


WANT = {LARGE, None, OTHER, 7}


def test_suffix_dedup(docs):
    got = suffix_dedup.dedup_digest(docs)
    assert ids(got) == WANT
    removed = {r.doc_id: r.n_removed for r in got.collect()}
    assert removed[LARGE] == 0 and removed[OTHER] > 0
    assert ids(suffix_dedup.marks(suffix_dedup.packs.staged_packs(docs, suffix_dedup.shared_dir(docs.sparkSession)), suffix_dedup.DedupRule(), suffix_dedup._spans, "doc_id long, kept binary, spans array<array<long>>")) == WANT


def test_warc(docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.test/").alias("url"), F.repeat("text", 12).alias("html"))
    pages = pages.unionByName(pages.filter("page_id > 7").withColumn("page_id", F.col("page_id") + 1)).coalesce(1)
    got = {r.page_id: r.refers_to for r in warc_bundles.archive_digest(pages).collect()}
    assert got == {LARGE: LARGE + 1, LARGE + 1: None, OTHER: OTHER + 1, OTHER + 1: None, None: None, 7: None}


def test_token_files(docs):
    got = token_files.token_digest(docs, tokenizers_.path("byte_bpe_50k.json"))
    assert [r.doc_id for r in sorted(got.collect(), key=lambda r: r.start)] == [None, 7, LARGE, OTHER]


def test_languages(docs):
    got = language_codes.language_digest(docs)
    assert ids(got) == WANT


def test_pieces(docs):
    model = tokenizers_.path("piece_bpe_32k.model")
    assert ids(pieces.piece_digest(docs, model)) == WANT
    assert ids(pieces.encode_pieces(docs, model)) == WANT
    assert ids(pieces.decode_pieces(pieces.encode_pieces(docs, model), model)) == WANT


def test_ngram_join(docs):
    got = {r.doc_id: r.component_id for r in ngram_join.join_digest(docs, ngram_join.JoinRule(words=3, percent=90)).collect()}
    assert got.keys() == WANT and got[OTHER] == LARGE and got[LARGE] == LARGE
