"""Mixing sources to target weights by temperature, with DataFrame functions alone.

Token shares are raised to an exponent found by bisection, so that the mix meets a target entropy within a
limit on repetition; the normalised weights then become token budgets, realised as whole passes over a
source and a prefix of one more pass in the order of a block permutation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import shared_dir, staged

TOKEN = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixTarget:
    """entropy_ratio: entropy of the weights over that of equal weights; max_repeats: passes over a source at most.

    budget_ratio: tokens of the mix over tokens of the input.  block_tokens: tokens of a permuted block, about.
    """

    entropy_ratio: float = 0.95
    max_repeats: float = 2.0
    budget_ratio: float = 1.0
    block_tokens: int = 1 << 16
    seed: str = "mix"
    steps: int = 60


def source_of(docs: DataFrame) -> Column:
    """Null sources are one source with an empty name."""
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def n_tokens() -> Column:
    """White-space words of the whole text; null text has none."""
    return F.coalesce(F.regexp_count("text", F.lit(TOKEN)), F.lit(0)).cast("long")


def _key(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]).cast("binary"))


def doc_key(target: MixTarget, epoch: Column) -> Column:
    return _key(target.seed, "doc", epoch, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))


def block_of(target: MixTarget) -> Column:
    first = F.substring(_key(target.seed, "block", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8)
    return F.conv(first, 16, 10).cast("long") % F.col("n_blocks")


def block_key(target: MixTarget, epoch: Column) -> Column:
    return _key(target.seed, "order", epoch, F.col("_source"), F.col("_block"))


def weights(totals: DataFrame, target: MixTarget = MixTarget()) -> DataFrame:
    """_source, tokens, weight, exponent: one row for each source of ``totals`` (_source, tokens).

    The bisection runs inside one row that lists the sources' shares, 8 bytes a source.  Lowering the
    exponent flattens the weights: entropy and repetition both rise.  The exponent is the largest that meets the target
    entropy, raised where needed until no source is passed over more often than the limit allows.
    Sources without tokens get weight 0; without any tokens there are no weights to give and budgets are 0.
    """
    shares = totals.filter("tokens > 0").agg(F.array_sort(F.collect_list(F.col("tokens"))).alias("t"), F.sum("tokens").alias("total"))
    shares = shares.select("total", F.transform("t", lambda x: x / F.col("total")).alias("p"))

    def at(mid: Column) -> Column:
        """Struct of the normaliser z, entropy h and greatest repetition r at an exponent."""
        start = F.struct(F.lit(0.0).alias("z"), F.lit(0.0).alias("y"))
        sums = F.aggregate("p", start, lambda a, x: F.struct((a["z"] + F.pow(x, mid)).alias("z"), (a["y"] + F.pow(x, mid) * F.log(x)).alias("y")))
        done = F.transform(F.array(sums), lambda s: F.struct((F.log(s["z"]) - mid * s["y"] / s["z"]).alias("h"), (F.lit(target.budget_ratio) * F.pow(F.array_min("p"), mid - 1) / s["z"]).alias("r")))
        return done[0]

    bounds = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(target.steps))

    def bisect(keep_low) -> Column:
        def step(s: Column, _: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            low = keep_low(at(mid))
            return F.struct(F.when(low, mid).otherwise(s["lo"]).alias("lo"), F.when(low, s["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(steps, bounds, step)

    enough = F.lit(target.entropy_ratio) * F.log(F.size("p").cast("double"))
    by_entropy = bisect(lambda v: v["h"] >= enough)["lo"]
    by_repeats = F.when(at(F.lit(0.0))["r"] <= target.max_repeats, F.lit(0.0)).otherwise(bisect(lambda v: v["r"] > target.max_repeats)["hi"])
    found = shares.select("total", "p", F.greatest(by_entropy, by_repeats).alias("exponent"))
    found = found.select("total", "exponent", F.aggregate("p", F.lit(0.0), lambda a, x: a + F.pow(x, F.col("exponent"))).alias("z"))
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.col("exponent")) / F.col("z")).otherwise(F.lit(0.0))
    # ``found`` is one row of four numbers.
    return totals.crossJoin(F.broadcast(found)).select("_source", "tokens", weight.alias("weight"), "exponent", "total")


def plan(counts: DataFrame, target: MixTarget = MixTarget()) -> DataFrame:
    """One row for each source: weight, exponent, n_blocks, passes, and where the last, partial pass ends.

    ``counts`` has (_source, doc_id, tokens).  The partial pass takes the blocks whose key is below
    ``cut_block``, and of that block the documents up to ``cut_doc``; it never exceeds the budget.  Sums over blocks go by two levels
    (4096 ranges of block keys, then the blocks of one range), so no window holds more than a small part of a source.
    """
    totals = counts.groupBy("_source").agg(F.sum("tokens").alias("tokens"))
    w = weights(totals, target)
    budget = F.floor(F.round(F.col("weight") * F.col("total") * target.budget_ratio, 6)).cast("long")
    passes = F.when(F.col("tokens") > 0, F.floor(budget / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    sources = w.select("_source", "tokens", "weight", "exponent", budget.alias("budget"), passes.alias("passes"), F.greatest(F.lit(1), F.ceil(F.col("tokens") / target.block_tokens)).cast("long").alias("n_blocks"))
    sources = sources.withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))

    placed = counts.withColumnRenamed("tokens", "n").join(sources.select("_source", "n_blocks", "passes", "rest"), "_source").withColumn("_block", block_of(target))
    blocks = placed.groupBy("_source", "_block", "passes", "rest").agg(F.sum("n").alias("n")).withColumn("key", block_key(target, F.col("passes"))).withColumn("range", F.substring("key", 1, 3))
    ranges = blocks.groupBy("_source", "range", "rest").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
    inside = Window.partitionBy("_source", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    cut = blocks.join(ranges.select("_source", "range", "before"), ["_source", "range"])
    cut = cut.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
    cut = cut.select("_source", "_block", F.col("key").alias("cut_block"), "before")

    docs = placed.join(cut, ["_source", "_block"]).withColumn("doc_key", doc_key(target, F.col("passes")))
    running = F.sum("n").over(Window.partitionBy("_source").orderBy("doc_key"))
    docs = docs.withColumn("upto", F.col("before") + running).filter(F.col("upto") <= F.col("rest"))
    ends = docs.groupBy("_source").agg(F.max("doc_key").alias("cut_doc"))
    return sources.join(cut.select("_source", "cut_block"), "_source", "left").join(ends, "_source", "left")


def apply_plan(rows: DataFrame, mix: DataFrame, target: MixTarget = MixTarget()) -> DataFrame:
    """row (all columns of ``rows``, which has _source and doc_id) once for each pass that takes it, with epoch and block."""
    packed = rows.select(F.struct("*").alias("row"), "_source", "doc_id")
    joined = packed.join(mix.select("_source", "n_blocks", "passes", "cut_block", "cut_doc"), "_source").withColumn("_block", block_of(target))
    key = block_key(target, F.col("passes"))
    last = (key < F.col("cut_block")) | ((key == F.col("cut_block")) & (doc_key(target, F.col("passes")) <= F.col("cut_doc")))
    times = F.col("passes").cast("int") + F.coalesce(last, F.lit(False)).cast("int")
    epochs = F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))).alias("epoch")
    return joined.select("row", F.col("_block").alias("block"), epochs)


def counted(docs: DataFrame) -> DataFrame:
    """_source, doc_id and tokens of every document, written once to the shared folder: the texts are read for this alone."""
    return staged(docs.select(source_of(docs).alias("_source"), "doc_id", n_tokens().alias("tokens")), shared_dir(docs.sparkSession), "counts")


def mix_digest(docs: DataFrame, target: MixTarget = MixTarget()) -> DataFrame:
    """doc_id, source, n_tokens, epoch, block of every document taken, once for each pass that takes it.

    Null texts have no tokens and null sources are one source.  Rows that repeat a doc_id, and those without one, have one place in the
    permutation: at the end of the last pass all of them are taken or none.  An empty table gives no rows.
    """
    counts = counted(docs)
    mix = staged(plan(counts, target), shared_dir(docs.sparkSession), "plan")
    return apply_plan(counts, mix, target).select("row.doc_id", F.col("row._source").alias("source"), F.col("row.tokens").alias("n_tokens"), "epoch", "block")


def mixed(docs: DataFrame, target: MixTarget = MixTarget()) -> DataFrame:
    """The documents of the mix with all their columns; one taken by several passes is repeated.

    The plan is one short row a source and joins without a hint, so texts stay in place where Spark broadcasts it.
    Nulls, repeated rows and empty tables are as in ``mix_digest``.
    """
    mix = staged(plan(counted(docs), target), shared_dir(docs.sparkSession), "plan")
    return apply_plan(docs.select(F.struct("*").alias("own"), source_of(docs).alias("_source"), "doc_id"), mix, target).select("row.own.*")
