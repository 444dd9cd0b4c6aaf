"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, staged


def components(links: DataFrame, directory: str) -> DataFrame:
    """node, component (the smallest node reachable) for every node of ``links`` (a, b longs).

    Rounds of contraction: every node takes the least of its closed neighbourhood in a random order that changes by
    round, links are carried over to those nodes, and loops and repeats go.  Expected rounds are
    logarithmic.  Each step is an aggregation that combines on the map side and joins that AQE may split, so
    a node with very many links gathers nowhere; every round is a table in the shared folder.
    """
    links = staged(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), directory, "links-0")
    spark = links.sparkSession
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels, k = staged(nodes.select("node", F.col("node").alias("at")), directory, "labels-0"), 0
    while not links.isEmpty():
        k += 1
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("n"))
        least = both.groupBy("a").agg(F.min(order("b")).alias("m")).select("a", F.least("m", order("a"))["n"].alias("to"))
        least = staged(least, directory, f"hooks-{k}")
        hook = lambda c: least.select(F.col("a").alias(c), F.col("to").alias(f"{c}_to"))
        links = links.join(hook("a"), "a").join(hook("b"), "b").filter("a_to <> b_to")
        links = staged(links.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), directory, f"links-{k}")
        moved = labels.join(hook("at"), "at", "left").select("node", F.coalesce("at_to", "at").alias("at"))
        labels = staged(moved, directory, f"labels-{k}")
        discard(spark, directory, f"links-{k - 1}", f"labels-{k - 1}", f"hooks-{k}")
    lowest = labels.groupBy("at").agg(F.min("node").alias("component"))
    return labels.join(lowest, "at").select("node", "component")


class Forest:
    """Union-find of a task's few items."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j
