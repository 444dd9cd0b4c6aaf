"""Top-k and unique winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps no more than k a group before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)


def unique_winner(df: DataFrame, keys: list[str], score: str, least: float) -> DataFrame:
    """The row of the highest score of each group if it is alone there and reaches ``least``.  Combines before the shuffle."""
    best = df.groupBy(*keys, score).agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in df.columns if c not in (*keys, score)])).alias("_row"))
    chosen = best.groupBy(*keys).agg(F.max(F.struct(score, "_n")).alias("_m"), F.max_by("_row", score).alias("_row"))
    return chosen.filter((F.col("_m._n") == 1) & (F.col(f"_m.{score}") >= least)).select(*keys, F.col(f"_m.{score}").alias(score), "_row.*")
