"""Importance resampling towards a target distribution over hashed word n-grams.

A streaming ring finds the features: one scan over a document keeps the running zlib states of the last n starts, and each
word extends every state by a space and itself and starts one of its own, so no n-gram is ever put together as a string.
Counts of buckets are summed in each task before they are shuffled.  The table of gains has a row a bucket, whatever
the input, so tasks get it whole.  Weights with Gumbel noise, drawn from the top, sample without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import shared_dir, staged

#: Bytes that are words' after A-Z are lower-cased: digits, a-z and all of UTF-8 beyond ASCII; all others separate.
WORDS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
SLICE = 1 << 16


@dataclass(frozen=True)
class ResampleRule:
    """ngram: longest run of words; buckets: of the hash; least_words: of a document that can be drawn; percent: drawn of those; seed: of the noise."""

    ngram: int = 2
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 25
    seed: int = 7


def words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, by slices that end between words."""
    data, at = data.translate(WORDS), 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def feature_buckets(data: bytes, rule: ResampleRule) -> Iterator[tuple[int, np.ndarray]]:
    """For each slice of a text, how many words it has and the buckets of the features that end in it."""
    ring, older = [], rule.ngram - 1
    for part in words(data):
        states = []
        for word in part:
            longer = b" " + word
            ring = [crc32(word), *[crc32(longer, state) for state in ring[:older]]]
            states += ring
        yield len(part), np.asarray(states, np.int64) % rule.buckets


def bucket_counts(docs: DataFrame, rule: ResampleRule) -> DataFrame:
    """bucket, n: features of all texts of ``docs`` (text) by bucket; null texts have none.  A task sends a row a bucket at most."""

    def count(batches):
        total = np.zeros(rule.buckets, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                for _, found in feature_buckets(data, rule):
                    total += np.bincount(found, minlength=rule.buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = docs.filter("text IS NOT NULL").select(F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, rule: ResampleRule) -> np.ndarray:
    """The gain of every bucket, in thousandths of a nat: how much likelier it is in ``target`` (text) than in ``docs`` (text), each
    smoothed by one count a bucket.  Rows collected: ``rule.buckets`` at most for each table."""

    def dense(df: DataFrame) -> list[int]:
        found = dict(map(tuple, bucket_counts(df, rule).collect()))
        return [found.get(b, 0) for b in range(rule.buckets)]

    raw, aim = dense(docs), dense(target)
    all_raw, all_aim = float(sum(raw) + rule.buckets), float(sum(aim) + rule.buckets)
    return np.asarray([math.floor(1000 * math.log(((t + 1.0) * all_raw) / ((s + 1.0) * all_aim))) for s, t in zip(raw, aim, strict=True)], np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, rule: ResampleRule) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean of the gains of a document's features, 0 without any) for every row of ``docs``."""

    def weigh(batches):
        for batch in batches:
            n_words, n_features, weights = [], [], []
            for data in batch.column(1).to_pylist():
                w = n = total = 0
                for k, found in feature_buckets(data, rule):
                    w, n, total = w + k, n + len(found), total + int(gains[found].sum())
                n_words.append(w)
                n_features.append(n)
                weights.append(total // n if n else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n_words, n_features, weights)]], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def scored(docs: DataFrame, gains: np.ndarray, rule: ResampleRule) -> DataFrame:
    """``weighted`` with score: the weight plus Gumbel noise that the seed and doc_id decide (a null doc_id counts as the empty string)."""
    name = F.concat(F.lit(f"{rule.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return weighted(docs, gains, rule).withColumn("score", F.col("weight") + noise)


def resample_digest(docs: DataFrame, target: DataFrame, rule: ResampleRule = ResampleRule()) -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs`` (doc_id, text); rank is null where a row isn't drawn.

    Null and empty texts have no features, weigh 0 and are never drawn; nulls among doc_ids come last of equal scores; rows that repeat are
    scored and drawn each by itself; an empty table gives no rows, an empty target only the smoothed gains.  Ranks come from ranges: rows are dealt by
    ranges of (score, doc_id), numbered within their range and moved on by the sizes of the ranges before, so no task sees all.
    """
    spark, directory = docs.sparkSession, shared_dir(docs.sparkSession)
    gains = bucket_gains(docs, target, rule)
    rows = staged(scored(docs, gains, rule).withColumn("row", F.monotonically_increasing_id()), directory, "scored")
    able = rows.filter(F.col("n_words") >= rule.least_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    place = F.monotonically_increasing_id()
    sorted_rows = able.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", place)
    sorted_rows = staged(sorted_rows.select("doc_id", "n_features", "weight", "score", F.shiftright("place", 33).alias("span"), F.col("place").bitwiseAND((1 << 33) - 1).alias("at")), directory, "sorted")
    sizes = sorted_rows.groupBy("span").agg(F.count("*").alias("n"))
    # A row a range: their number is that of shuffle partitions.
    before = sizes.select("span", (F.sum("n").over(Window.orderBy("span")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    rank = F.col("before") + F.col("at") + 1
    drawn = sorted_rows.join(F.broadcast(before), "span").select("doc_id", "n_features", "weight", "score", F.when(100 * rank <= rule.percent * F.col("all"), rank).alias("rank"))
    rest = rows.filter(F.col("n_words") < rule.least_words)
    return drawn.unionByName(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def resampled(docs: DataFrame, target: DataFrame, rule: ResampleRule = ResampleRule()) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all of their columns, and ``draw_rank`` (the best of their doc_id's); rows that repeat a drawn doc_id all come."""
    drawn = resample_digest(docs, target, rule).filter("rank IS NOT NULL").groupBy(F.col("doc_id").alias("drawn_id")).agg(F.min("rank").alias("draw_rank"))
    return docs.join(drawn, F.col("doc_id").eqNullSafe(F.col("drawn_id"))).drop("drawn_id")
