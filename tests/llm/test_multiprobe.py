"""Nearest neighbours against brute force: exact where the tables are small, by recall where they hash."""

from __future__ import annotations

import math

import numpy as np
import pytest

from pagewarden.llm import multiprobe
from pagewarden.llm.multiprobe import Group, ProbeRule, Tables

SCHEMA = "vec_id long, embedding array<float>, query string, vector string, norm long, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "q", "v", 1, 2) for i, v in rows], SCHEMA).repartition(3)


def plain(rows, k: int, every: int) -> dict:
    """The exact answer: query -> [(vec_id, score)]."""
    good = {(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    out: dict = {}
    for i, v in good:
        if i % every == 0:
            best: dict = {}
            for j, w in good:
                if j != i and len(w) == len(v):
                    s = float((np.asarray(v, np.float64) * np.asarray(w, np.float64)).sum())
                    best[j] = max(s, best.get(j, -math.inf))
            out[i] = sorted(((j, s) for j, s in best.items()), key=lambda x: (-x[1], x[0]))[:k]
    return {i: v for i, v in out.items() if v}


def answers(df) -> dict:
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def random_rows(n: int, seed: int = 1, dims: int = 8) -> list:
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)).astype(np.float32)
    return [(i, v.tolist()) for i, v in enumerate(x)]


def test_small_tables_are_exact(spark):
    rows = random_rows(150)
    rows += [(200 + k, rows[20][1]) for k in range(60)]  # copies of a query
    rows += [(2**53 + 1, rows[3][1]), (None, rows[4][1]), (300, None), (320, []), (301, [0.0] * 8), (302, [float("nan")] + [1.0] * 7), (303, [float("inf")] + [1.0] * 7), (304, [None] + [1.0] * 7)]
    rows += [rows[40], rows[40], (340, [1.0, 2.0]), (341, [3.0, 1.0]), (360, [1.0]), (400, [-0.0] * 7 + [1e-20]), (401, [1e18] * 8), (-20, rows[7][1])]
    got, want = answers(multiprobe.search_digest(table(spark, rows))), plain(rows, 20, 20)
    assert got == want
    assert 360 not in got and len(got[340]) == 1


def test_empty_table(spark):
    assert multiprobe.search_digest(table(spark, [])).collect() == []
    assert multiprobe.search_digest(table(spark, [(20, None), (40, [0.0])])).collect() == []


@pytest.mark.parametrize("rule", [ProbeRule(neighbours=5, chunk=64, sample=128, bucket=4), ProbeRule(neighbours=5, chunk=64, sample=128, bucket=4, probes=2, tables=2)])
def test_recall_of_hashed_tables(spark, rule):
    """With few probes allowed, the tables can't reach the success and every query goes to all blocks, which is exact."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    rows = [(i, (centres[rng.integers(40)] + 0.4 * rng.standard_normal(16)).tolist()) for i in range(1500)]
    rows += [(2000 + k, rows[9][1]) for k in range(500)]
    got, want = answers(multiprobe.search_digest(table(spark, rows), rule)), plain(rows, 5, 20)
    assert got.keys() == want.keys()
    share = np.mean([len(set(got[i]) & set(want[i])) / len(want[i]) for i in want])
    assert share == 1 if rule.probes == 2 else share >= 0.9


def test_chances_of_buckets_are_the_measured_ones():
    """Over random planes, rows at the cosine are in the visited buckets of a table as often as foretold."""
    rng = np.random.default_rng(8)
    told, met, dims, cosine = [], [], 12, 0.7
    for seed in range(40):
        t = Tables(Group(dims, 0, 4000, 1.0), ProbeRule(seed=seed, tables=4, probes=64, bucket=16))
        q = rng.standard_normal((8, dims))
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        z = rng.standard_normal((8, dims))
        z -= (z * q).sum(1, keepdims=True) * q
        x = cosine * q + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        logs, codes, _, _ = t.visits(q, np.full(8, cosine))
        own, _ = t.buckets(x)
        told.append(np.exp(logs).sum(2))
        met.append((codes == own[:, :, None]).any(2))
    assert abs(np.mean(told) - np.mean(met)) < 0.03


def test_visits_are_the_best_of_all_buckets():
    rule = ProbeRule(tables=2, probes=50, bucket=16, thrift=0)
    t = Tables(Group(6, 0, 3000, 1.0), rule)
    wide = Tables(Group(6, 0, 3000, 1.0), ProbeRule(tables=2, probes=3**t.k, bucket=16, thrift=0))
    q = np.eye(6)
    few, many = t.visits(q, np.full(6, 0.6)), wide.visits(q, np.full(6, 0.6))
    assert t.k > multiprobe.STEP and np.allclose(few[0], many[0][:, :, :50])
