"""Plain versions of the operators for small tables."""

from __future__ import annotations

import hashlib

import numpy as np

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def dedup(rows: list[tuple], n: int) -> dict:
    """(doc_id, text) -> n_bytes, n_removed, n_spans, kept_sha256 by a table of every string of n bytes."""
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - n + 1) if i is not None else ():
            first[b[k : k + n]] = min(i, first.get(b[k : k + n], i))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - n + 1) if i is not None else ():
            if first[b[k : k + n]] < i:
                gone[k : k + n] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out[i, t] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def shingles(text: str | None, n: int) -> frozenset:
    words = (text or "").encode().translate(LOWER).split()
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1))


def components(nodes: list, linked) -> dict:
    """The least node that each reaches over ``linked`` pairs."""
    up = {i: i for i in nodes}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, a in enumerate(nodes):
        for b in nodes[:x]:
            if linked(a, b):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: find(i) for i in nodes}


def similar(a: frozenset, b: frozenset, percent: int) -> bool:
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)
