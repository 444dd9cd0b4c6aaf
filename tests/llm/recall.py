"""Recall of the cap filters against brute force, with production parameters: ``python -m tests.llm.recall FOLDER...`` prints a row for each.

A pair of distinct vectors at the similarity or above is found if the two share a filter; ``rare`` counts only pairs between vectors
with under half the largest number of links, so that one large group does not decide the figure.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow.dataset as ds

from pagewarden.llm import cap_filters


def recall(x: np.ndarray, options: cap_filters.CapFilters = cap_filters.CapFilters()) -> tuple[int, float, int, float]:
    """Pairs, recall, rare pairs and their recall of the distinct unit vectors ``x``."""
    codes, _ = cap_filters.covering(x.shape[1], len(x), options)
    lists = [f for at in range(0, len(x), 512) for f in cap_filters.filter_lists(x[at : at + 512], codes, options.each)]
    pairs = []
    for at in range(0, len(x), 1024):
        a, b = np.nonzero(x[at : at + 1024] @ x.T >= options.threshold)
        keep = a + at < b
        pairs.append(np.stack([a[keep] + at, b[keep]], 1))
    pairs = np.concatenate(pairs)
    met = np.asarray([not set(lists[a].tolist()).isdisjoint(lists[b].tolist()) for a, b in pairs.tolist()], bool)
    links = np.bincount(pairs.ravel(), minlength=len(x))
    rare = (links[pairs] * 2 < links.max(initial=0)).all(1) if len(pairs) else np.zeros(0, bool)
    share = lambda m: float(m.mean()) if len(m) else 1.0
    return len(pairs), share(met), int(rare.sum()), share(met[rare])


def main() -> None:
    for folder in sys.argv[1:]:
        rows = ds.dataset(f"{folder}/embeddings.parquet").to_table(columns=["embedding"]).column("embedding").to_pylist()
        good = [v for v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
        x = cap_filters.unit(np.unique(np.asarray(good, np.float32), axis=0))
        n, all_pairs, rare, rare_pairs = recall(x)
        print(f"| {folder.rpartition('/')[2]}, {len(rows):,} | {n:,} / {rare:,} | {all_pairs:.4f} / {rare_pairs:.4f} |", flush=True)


if __name__ == "__main__":
    main()
