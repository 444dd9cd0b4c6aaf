"""A training-data pipeline of five stages over ``documents``: quality, near duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as Parquet and
read again as the next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewarden.llm import line_quality, ngram_join, pieces, secret_scan, source_mix
from pagewarden.llm._shared import lean, shared_dir, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted by the removal of their host's common lines.

    Null and empty texts fail the base rules; rows without doc_id and repeated rows are judged each by itself.
    """
    lean(spark)
    return line_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that five-word shingles link at a similarity of 0.8 or more.

    Rows without doc_id and texts without words stay; so does every row of a kept doc_id that repeats; an empty table stays empty.
    """
    lean(spark)
    return ngram_join.keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets that the forest confirms masked in their texts.

    Null texts stay null; rows without doc_id and repeated rows are masked each by itself; an empty table stays empty.
    """
    return secret_scan.redacted(docs, secret_scan.train(secret_scan.labelled_findings(spark)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the sources' target weights; those of small sources may come twice.

    A null source is one source; null texts have no tokens, cost no budget and follow their source's passes; an empty table stays empty.
    """
    return source_mix.mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of what they decode to; null text is empty, every row gives one."""
    lean(spark)
    import public_tokenizers

    return pieces.piece_digest(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]

#: SQL can't express the random forest or the encoder; a test holds run()'s rows against a plain version of the whole chain.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; what passes between them is a table in the shared folder."""
    docs, directory = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), directory, name)
    return STAGES[-1][1](spark, docs, sf_dir)
