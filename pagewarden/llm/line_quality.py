"""Quality rules: document statistics and cross-document line frequency.

Lines are normalised and hashed; for each host (``source``) the documents that hold a line are counted,
lines held by more documents than the host's limit are removed, and documents with too little left are
rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WORD_SPLIT, shared_dir, staged

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
STATS_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class LineLimits:
    """A line is boilerplate in a host if more than ``max(min_docs, share * documents of the host)`` hold it.

    A document is depleted if less than ``keep_percent`` of its words stand in other lines.
    """

    min_docs: int = 20
    share_percent: int = 10
    keep_percent: int = 50


def text_stats(text: str | None, codes: dict[bytes, int]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes.split() cuts at exactly \x20 and \x09-\x0D
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and x.strip()]
    repeated = 0
    if n >= 4:
        if len(codes) > 100_000:
            codes.clear()
        ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.uint64, n)
        if len(codes) <= 1 << 21:
            keys = ids[:-2] << np.uint64(42) | ids[1:-1] << np.uint64(21) | ids[2:]
        else:  # numbers of word pairs and words are below 2^32
            _, pairs = np.unique(ids[:-2] << np.uint64(32) | ids[1:-1], return_inverse=True)
            keys = pairs.astype(np.uint64).ravel() << np.uint64(32) | ids[2:]
        _, back, counts = np.unique(keys, return_inverse=True, return_counts=True)
        twice = counts[back] > 1
        if twice.any():
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def base_stats(texts: pd.Series) -> pd.DataFrame:
    """The base statistics of whole texts as one struct column; other columns stay in the JVM."""
    codes: dict[bytes, int] = {}
    return pd.DataFrame([text_stats(t, codes) for t in texts], columns=[x.split()[0] for x in STATS_SCHEMA.split(", ")], dtype="int64")


def normal_line(line: Column) -> Column:
    """Lower-case A-Z, runs of white space as one space, none at the ends."""
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, WORD_SPLIT, " "))


def normal_lines(text: Column) -> Column:
    """The normalised lines of a text that hold a word, in order."""
    return F.filter(F.transform(F.split(text, "\n", -1), normal_line), lambda x: x != "")


def host_of(docs: DataFrame) -> Column:
    """The host of a document is its source; null counts as one host."""
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def common_lines(docs: DataFrame, limits: LineLimits) -> DataFrame:
    """host, line_hash of the lines above their host's limit.

    A document counts a line once (array_distinct before the explode), so the count combines on the map side
    and a very common line or host costs a row for each task.
    """
    hashes = F.array_distinct(F.transform(normal_lines(F.col("text")), lambda x: F.xxhash64(x)))
    rows = docs.select(host_of(docs).alias("host"), hashes.alias("hashes"))
    held = rows.select("host", F.explode("hashes").alias("line_hash")).groupBy("host", "line_hash").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > limits.min_docs)
    sizes = docs.select(host_of(docs).alias("host")).groupBy("host").agg(F.count("*").alias("host_docs"))
    return held.join(sizes, "host").filter(100 * F.col("n_docs") > limits.share_percent * F.col("host_docs")).select("host", "line_hash")


def verdicts(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """row (all columns of ``docs``) and the struct v: base statistics, n_removed_words, base_failed, kept.

    Each line above a limit is held by over ``share_percent`` of its host's documents, so a host has at most
    ``100 / share_percent`` times its mean number of lines a document of them: they travel as one short array
    for each host.  The join has no hint: Spark broadcasts them where they are small, and splits a hot host's
    documents where it shuffles.  The lines are a finished table first, so their size is known before a text moves.
    Null text has no word and fails the base rules; null doc_ids and repeated rows are judged each by itself;
    an empty table gives no rows; other columns are kept.
    """
    common = common_lines(docs, limits).groupBy("host").agg(F.collect_list("line_hash").alias("common"))
    common = staged(common, shared_dir(docs.sparkSession), "common")
    # The caller's row is one struct, so no name of its columns can clash with one here.
    rows = docs.select(F.struct("*").alias("row"), host_of(docs).alias("host")).join(common, "host", "left")
    text = F.col("row").getField("text")
    # Not to be moved or repeated: a filter on the verdict would else compute it once below the join and once above.
    stats = F.pandas_udf(base_stats, STATS_SCHEMA).asNondeterministic()
    removed = F.filter(normal_lines(text), lambda x: F.array_contains(F.col("common"), F.xxhash64(x)))
    n_removed = F.aggregate(removed, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1)
    rows = rows.withColumn("removed", F.when(F.col("common").isNull() | text.isNull(), F.lit(0).cast("long")).otherwise(n_removed))
    rows = rows.withColumn("s", stats(F.coalesce(text, F.lit(""))))
    n = F.col("s.n_words")
    failed = (n < 50) | (100 * F.col("s.n_repeat_words") > 50 * n)
    depleted = 100 * (n - F.col("removed")) < limits.keep_percent * n
    verdict = F.struct("s.*", F.col("removed").alias("n_removed_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))
    return rows.select("row", verdict.alias("v"))


def quality_digest(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """doc_id, the base statistics, n_removed_words, base_failed and kept of every document.

    Null text has no words and fails; a null source counts as the empty host; rows without doc_id and repeated rows count as documents each; an
    empty table gives no rows.
    """
    return verdicts(docs.select("doc_id", "source", "text"), limits).select("row.doc_id", "v.*")


def keep_good(docs: DataFrame, limits: LineLimits = LineLimits()) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``."""
    return verdicts(docs, limits).filter("v.kept").select("row.*")
