"""Recall of op12's answers against brute force: ``python -m tests.llm.recall_nearest FOLDER...`` runs the query and prints a row for each folder.

The share of each query's exact nearest neighbours that the answer has, ties counted by the product; and how far scores are off.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow.dataset as ds
from pyspark.sql import SparkSession

from pagewarden.llm import queries


def recall(spark: SparkSession, folder: str, k: int = 20) -> tuple[int, int, float, float, float]:
    """Vectors, queries, mean and least recall, and the greatest error of a score."""
    table = ds.dataset(f"{folder}/embeddings.parquet").to_table(columns=["vec_id", "embedding"])
    rows = [(i, v) for i, v in zip(table["vec_id"].to_pylist(), table["embedding"].to_pylist(), strict=True) if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    ids, x = np.asarray([i for i, _ in rows]), np.asarray([v for _, v in rows], np.float64)
    place = {i: p for p, i in enumerate(ids.tolist())}
    found: dict[int, list] = {}
    for r in queries.op12_multiprobe(spark, folder).collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    asked, shares, off = np.flatnonzero(ids % k == 0), [], 0.0
    for at in range(0, len(asked), 256):
        products = x[asked[at : at + 256]] @ x.T
        for row, q in zip(products, asked[at : at + 256], strict=True):
            row[q] = -np.inf
            least = np.partition(row, len(row) - k)[len(row) - k]
            got = found.get(int(ids[q]), [])
            shares.append(sum(row[place[i]] >= least - 1e-12 for i, _ in got) / k)
            off = max([off, *(abs(row[place[i]] - s) for i, s in got)])
    return len(x), len(asked), float(np.mean(shares)), float(np.min(shares)), off


def main() -> None:
    conf = {"spark.master": "local[4]", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for folder in sys.argv[1:]:
        print(folder, *recall(spark, folder), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
