"""Resampling by a plain string version, and the filter audit by applying the filters in every order."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewarden.llm import filter_audit, importance

SCHEMA = "doc_id long, text string, source string, part string, n long, key string, A string, score long, rank long, bucket long"
LABELS = "doc_id long, quality int, toxic int, n long, part string"


def texts() -> list[tuple]:
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "ER", "ing", "an", "ß", "É", "日本"]) for _ in range(rng.randint(1, 3)))
    some = [" ".join(word() for _ in range(n)) for n in (25, 60, 250, 19, 20, 210)]
    out = [(0, None, None), (1, "", ""), (2, "", "a"), (None, some[0], "a"), (None, some[1], None), (3, some[0], "a"), (3, some[0], "a"), (4, some[0], "b"), (5, "word " * 300, "a"), (6, "#tags | and & " * 70, "b"), (7, "!!! ... \n", "b")]
    out += [(k, rng.choice(some) + rng.choice(["", "", " $5", " tail" * 230]), rng.choice(["a", "b", None])) for k in range(8, 40)]
    out.append((2**53 + 1, some[2], "big"))
    out.append((2**53 + 2, some[2], "big"))
    out.append((40, " ".join(word() for _ in range(60_000)), "long"))
    return out


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1, "k", "a", 1, 2, 3) for i, t, s in rows], SCHEMA).repartition(3)


def features(text: str | None, n: int) -> tuple[list[str], list[int]]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    runs = [" ".join(found[a : a + k]) for k in range(1, n + 1) for a in range(len(found) - k + 1)]
    return found, [zlib.crc32(r.encode()) for r in runs]


def plain_resample(rows, target, rule) -> list[tuple]:
    held = [[b % rule.buckets for b in features(t, rule.ngram)[1]] for _, t, _ in rows]
    s, t = Counter(b for h in held for b in h), Counter(b % rule.buckets for x in target for b in features(x, rule.ngram)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + rule.buckets) / ((s[b] + 1) * (T + rule.buckets)))) for b in range(rule.buckets)]
    out = []
    for (i, text, _), h in zip(rows, held, strict=True):
        weight = sum(gain[b] for b in h) // len(h) if h else 0
        u = int(hashlib.sha256(f"{rule.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(h), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 4294967296))), None, len(features(text, 1)[0])])
    able = sorted((r for r in out if r[5] >= rule.least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: rule.percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("rule", [importance.ResampleRule(), importance.ResampleRule(ngram=3, buckets=64, percent=60, seed=1), importance.ResampleRule(ngram=1, least_words=1, percent=100)])
def test_resample(spark, rows, docs, rule):
    target = ["The quick brown FOX an an", None, "", rows[12][1]]
    got = importance.resample_digest(docs, spark.createDataFrame([(t, 1) for t in target], "text string, bucket int"), rule)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resample(rows, target, rule)


def test_resample_of_empty_tables(spark, docs, rows):
    nothing = docs.limit(0)
    assert importance.resample_digest(nothing, docs).collect() == []
    got = importance.resample_digest(docs, nothing).collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(rows, [], importance.ResampleRule())


def test_resampled_documents_keep_their_columns(spark, docs):
    ranks = {r.doc_id for r in importance.resample_digest(docs, docs).collect() if r["rank"] is not None}
    got = importance.resampled(docs, docs)
    assert got.columns == [*docs.columns, "draw_rank"]
    assert {r.doc_id for r in got.collect()} == ranks


def test_slices_end_between_words():
    data = ("ab " * 50_000 + "x" * 200_000 + " end").encode()
    assert [w for s in importance.words(data) for w in s] == data.split()


def plain_audit(rows, labels) -> dict:
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    lead: dict[str, int] = {}
    for i, t, _ in rows:
        if i is not None:
            lead[t or ""] = min(i, lead.get(t or "", i))
    told = []
    for i, t, s in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > lead[t]}
        told.append((s or "", fails, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in told}:
        mine = [x for x in told if x[0] == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(mine)
            for k, f in enumerate(order):
                gone = [x for x in left if x[1][f]]
                left = [x for x in left if not x[1][f]]
                shapley[f] += len(gone)
                fail = [x for x in mine if x[1][f]]
                out[part, order, k + 1] = [len(left), len(gone), len(fail) - len(gone), sum(sum(x[1].values()) == 1 for x in fail), sum(x[2] for x in gone), sum(x[3] for x in gone), f]
        for (p, _, _), v in out.items():
            if p == part:
                v[6] = shapley[v[6]]
    return out


def test_audit(spark, rows, docs):
    labels = [(3, 1, 0), (3, 0, 1), (4, None, None), (5, 1, 1), (None, 1, 1), (9, 0, 1), (12, 1, 0), (13, 1, 1), (2**53 + 1, 1, 0), (999, 1, 1)]
    got = filter_audit.audit_digest(docs, spark.createDataFrame([(*r, 1, "x") for r in labels], LABELS)).collect()
    want = plain_audit(rows, labels)
    assert len(got) == len(want)
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == want


def test_audit_of_empty_tables(spark, docs, rows):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit_digest(docs.limit(0), labels).collect() == []
    got = filter_audit.audit_digest(docs, labels)
    assert got.count() == len(plain_audit(rows, [])) and got.agg(F.sum("good_lost")).first()[0] == 0
