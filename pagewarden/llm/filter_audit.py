"""How filters interact: what each of five filters removes in every order of application, by a cube over their failure flags.

Documents become rows of flags, equal rows are counted, and a SQL CUBE over the flags and the part sums the counts of every
subset of the flags.  The rows of a grouping set whose selected flags are all false count the documents that survive that
subset of filters.  A filter applied after a subset takes one subset to a larger one, so every step of every order is a join
of two subsets' survivors.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WORD_SPLIT, shared_dir, staged

LETTERS = "ABCDE"
ALL = tuple("".join(s) for k in range(len(LETTERS) + 1) for s in itertools.combinations(LETTERS, k))
COUNTS = ("n", "good", "toxic")


@dataclass(frozen=True)
class AuditRule:
    """A: under ``least_words`` words; B: under ``distinct_percent`` % distinct words; C: over ``capital_percent`` % of A-Z among the
    characters; D: holds one of ``symbols``; E: the text of a document with a smaller doc_id."""

    least_words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 2
    symbols: str = "[#$%&*|]"


def text_flags(text: Column, rule: AuditRule) -> dict[str, Column]:
    """The failure flags that the text alone decides."""
    words = F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")
    n_words, distinct, chars = F.size(words), F.size(F.array_distinct(words)), F.length(text)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n_words < rule.least_words,
        "B": 100 * distinct.cast("long") < rule.distinct_percent * n_words.cast("long"),
        "C": 100 * capitals.cast("long") > rule.capital_percent * chars.cast("long"),
        "D": text.rlike(rule.symbols),
    }


def flag_counts(docs: DataFrame, labels: DataFrame, rule: AuditRule = AuditRule()) -> DataFrame:
    """part, A to E, n, good, toxic: how many documents of each part have each combination of failures, and how many of them are labelled.

    Null text is empty, a null source is the part ''.  Rows without doc_id have no labels, are no text's first document and never fail E; rows
    that repeat a doc_id count each, and fail E only if a smaller doc_id has their text.  A doc_id with several labels is good (toxic) if
    one of them says so.  Texts go no further than the scan: what is shuffled is a digest and flags, and equal rows are counted before.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), *[c.alias(k) for k, c in text_flags(F.col("text"), rule).items()])
    rows = rows.groupBy("doc_id", "part", "key", *"ABCD").agg(F.count("*").alias("n"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    # Rows without doc_id have no labels and would gather in one task of the join.
    known = rows.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTS[1:]})
    rows = known.unionByName(rows.filter("doc_id IS NULL").withColumns({c: F.lit(0).cast("long") for c in COUNTS[1:]}))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS])
    each = {"n": F.col("n"), "good": F.col("n") * F.col("good"), "toxic": F.col("n") * F.col("toxic")}
    # Of a text's rows in a part, those of its smallest doc_id there and those without doc_id are summed apart from the rest.
    nameless = F.struct(*[F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), c)), F.lit(0)).alias(k) for k, c in each.items()])
    texts = rows.groupBy("key", "part", *"ABCD").agg(
        F.struct(*[F.sum(c).alias(k) for k, c in each.items()]).alias("whole"), nameless.alias("nameless"), F.min("doc_id").alias("first"),
        F.coalesce(F.min_by(F.struct(*[c.alias(k) for k, c in each.items()]), "doc_id"), zero).alias("leading"),
    )
    texts = staged(texts, shared_dir(spark), "texts")
    leads = texts.groupBy("key").agg(F.min("first").alias("lead"))
    texts = texts.join(leads, "key").withColumn("leads", F.coalesce(F.col("first") == F.col("lead"), F.lit(False)))
    passing = F.struct(*[(F.col("nameless")[c] + F.when(F.col("leads"), F.col("leading")[c]).otherwise(0)).alias(c) for c in COUNTS])
    texts = texts.withColumn("passing", passing)
    failing = F.struct(*[(F.col("whole")[c] - F.col("passing")[c]).alias(c) for c in COUNTS])
    both = F.array(F.struct(F.lit(False).alias("E"), F.col("passing").alias("c")), F.struct(F.lit(True).alias("E"), failing.alias("c")))
    return texts.select("part", *"ABCD", F.explode(both).alias("x")).select("part", *"ABCD", "x.E", "x.c.*").groupBy("part", *LETTERS).agg(*[F.sum(c).alias(c) for c in COUNTS])


def survivors(counts: DataFrame) -> DataFrame:
    """part, subset, n, good, toxic: what each of the 32 subsets of filters leaves of each part, zeros included, from ``flag_counts``."""
    cube = counts.cube("part", *LETTERS).agg(*[F.sum(c).alias(c) for c in COUNTS], *[F.grouping(c).alias(f"without_{c}") for c in ("part", *LETTERS)])
    cube = cube.filter(F.col("without_part") == 0)
    for c in LETTERS:
        cube = cube.filter((F.col(f"without_{c}") == 1) | ~F.col(c))
    subset = F.concat(*[F.when(F.col(f"without_{c}") == 0, F.lit(c)).otherwise(F.lit("")) for c in LETTERS])
    left = cube.select("part", subset.alias("subset"), *COUNTS)
    grid = counts.select("part").distinct().select("part", F.explode(F.array(*map(F.lit, ALL))).alias("subset"))
    return grid.join(left, ["part", "subset"], "left").select("part", "subset", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def audit(counts: DataFrame) -> DataFrame:
    """A row for each part, order of the five filters and step, from ``flag_counts``; see ``audit_digest`` for the columns."""
    spark = counts.sparkSession
    left = staged(survivors(counts), shared_dir(spark), "survivors")
    letters = F.array(*map(F.lit, LETTERS))
    after = F.concat(*[F.when((F.col("letter") == c) | F.col("before").contains(c), F.lit(c)).otherwise(F.lit("")) for c in LETTERS])
    steps = left.select("part", F.col("subset").alias("before"), *[F.col(c).alias(f"{c}_before") for c in COUNTS], F.explode(letters).alias("letter"))
    steps = steps.filter(~F.col("before").contains(F.col("letter"))).withColumn("subset", after)
    pairs = steps.join(left, ["part", "subset"]).select("part", "before", "letter", F.col("n").alias("kept"), *[(F.col(f"{c}_before") - F.col(c)).alias(to) for c, to in (("n", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))])
    # A filter fails as often as it removes when it comes first, and fails alone as often as it removes when it comes last.
    edges = pairs.groupBy("part", "letter").agg(F.sum(F.when(F.col("before") == "", F.col("removed"))).alias("fails"), F.sum(F.when(F.length("before") == len(LETTERS) - 1, F.col("removed"))).alias("unique_fails"))
    # A subset of k filters precedes a filter in k! (4 - k)! of the orders.
    ways = F.element_at(F.array(*[F.lit(n) for n in (24, 6, 4, 6, 24)]), F.length("before") + 1).cast("long")
    shares = pairs.groupBy("part", "letter").agg(F.sum(F.col("removed") * ways).alias("shapley"))
    orders = [("".join(p), k + 1, "".join(sorted(p[:k])), p[k]) for p in itertools.permutations(LETTERS) for k in range(len(LETTERS))]
    plan = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, before string, letter string"))
    done = pairs.join(edges, ["part", "letter"]).join(shares, ["part", "letter"]).join(plan, ["before", "letter"])
    return done.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_digest(docs: DataFrame, labels: DataFrame, rule: AuditRule = AuditRule()) -> DataFrame:
    """part, filter_order, step, and counts within the part: kept after the step, removed by it, redundant (fails its filter, removed
    earlier), unique_fails (fails its filter alone), good_lost and toxic_lost (labelled documents that it removed), and shapley (what
    its filter removes, summed over all orders).

    An empty table has no parts and gives no rows; see ``flag_counts`` for nulls and repeated rows.
    """
    return audit(flag_counts(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic"), rule))
