"""The whole pipeline against a plain Python version of its chain, full rows and how often each comes."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import regex

import corpus_pipeline
from pagewarden.llm import secret_scan, source_mix

from . import brute

tokenizers_ = pytest.importorskip("public_tokenizers")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def fixture() -> list[dict]:
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "er", "ing", "an", "to", "ré", "ß", "Al"]) for _ in range(rng.randint(2, 5)))
    body = lambda n: " ".join(word() for _ in range(n))
    common, rows = body(60), []
    for k in range(150):
        text = body(rng.randint(45, 140))
        if k % 5 == 0:
            text = f"{common.upper() if k % 2 else common}\n{text}"
        if k % 9 == 0:
            text += f'\napp config token = "{hashlib.sha1(str(k).encode()).hexdigest()}" end'
        if k % 11 == 0:
            text += f"\nfix commit {hashlib.sha1(str(k + 1000).encode()).hexdigest()} now"
        if k % 13 == 0:
            text = " ".join([body(4)] * 30)
        rows.append({"doc_id": k, "text": text, "source": "big" if k % 10 < 6 else None if k % 10 == 9 else f"s{k % 2}"})
    for k in range(150, 190):
        words = rng.choice(rows[:60])["text"].split(" ")
        for _ in range(rng.choice([0, 1, 2, 6, 12])):
            words[rng.randrange(len(words))] = word()
        rows.append({"doc_id": k, "text": " ".join(words), "source": rng.choice(["big", "s0", "s1"])})
    rows += [{"doc_id": 190, "text": None, "source": "big"}, {"doc_id": 191, "text": "", "source": None}]
    return rows


def words_of(text: str) -> list[str]:
    return [w for w in SPACE.split(text) if w]


def quality(rows: list[dict]) -> list[dict]:
    host = lambda r: r["source"] or ""
    lines = [[n for n in (SPACE.sub(" ", x.encode().translate(brute.LOWER).decode()).strip(" ") for x in (r["text"] or "").split("\n")) if n] for r in rows]
    hosts = Counter(map(host, rows))
    held = Counter((host(r), x) for r, own in zip(rows, lines, strict=True) for x in set(own))
    common = {h for h, n in held.items() if n > 20 and 100 * n > 10 * hosts[h[0]]}
    kept = []
    for r, own in zip(rows, lines, strict=True):
        w = words_of(r["text"] or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times = Counter(grams)
        covered = {k + d for k, g in enumerate(grams) if times[g] > 1 for d in range(3)}
        gone = sum(len(x.split(" ")) for x in own if (host(r), x) in common)
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and 100 * (len(w) - gone) >= 50 * len(w):
            kept.append(r)
    return kept


def near_duplicates(rows: list[dict]) -> list[dict]:
    sets = {r["doc_id"]: brute.shingles(r["text"], 5) for r in rows}
    first = brute.components(sorted(sets), lambda a, b: brute.similar(sets[a], sets[b], 80))
    return [r for r in rows if first[r["doc_id"]] == r["doc_id"]]


def secrets(rows: list[dict], verdicts: dict) -> list[dict]:
    masked = []
    for r in rows:
        text = regex.sub(secret_scan.CandidateRule().pattern, lambda m: "<SECRET>" if verdicts[r["doc_id"], m.start()] else m[0], r["text"])  # noqa: B023
        masked.append({**r, "text": text})
    return masked


def mixing(rows: list[dict], block_tokens: int = 65536) -> list[dict]:
    md5 = lambda *parts: hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    of = defaultdict(list)
    for r in rows:
        of[r["source"] or ""].append((r, len(words_of(r["text"]))))
    tokens = {s: sum(n for _, n in rs) for s, rs in of.items()}
    total = sum(tokens.values())
    p = [n / total for n in tokens.values()]

    def share(e: float) -> list[float]:
        z = sum(x**e for x in p)
        return [x**e / z for x in p]

    def bisect(low) -> tuple[float, float]:
        a, b = 0.0, 1.0
        for _ in range(60):
            a, b = ((a + b) / 2, b) if low((a + b) / 2) else (a, (a + b) / 2)
        return a, b

    repeats = lambda e: max(w / x for w, x in zip(share(e), p, strict=True))
    e = bisect(lambda e: -sum(w * math.log(w) for w in share(e)) >= 0.95 * math.log(len(p)))[0]
    e = max(e, 0.0 if repeats(0.0) <= 2 else bisect(lambda e: repeats(e) > 2)[1])
    out = []
    for (s, rs), w in zip(of.items(), share(e), strict=True):
        budget = math.floor(round(w * total, 6))
        passes, rest = divmod(budget, tokens[s])
        blocks = max(1, math.ceil(tokens[s] / block_tokens))
        block = lambda i: int(md5("mix", "block", i)[:8], 16) % blocks  # noqa: B023, E731
        order = sorted(rs, key=lambda x: (md5("mix", "order", passes, s, block(x[0]["doc_id"])), md5("mix", "doc", passes, x[0]["doc_id"])))  # noqa: B023
        out += [r for r, _ in rs] * passes
        for r, n in order:
            rest -= n
            if rest < 0:
                break
            out.append(r)
    return out


@pytest.mark.parametrize("block_tokens", [65536, 500])
def test_mix_equals_the_plain_mix(spark, block_tokens):
    """Which documents the last pass takes, by blocks of few documents and by one block."""
    rows = [r for r in fixture() if r["text"]]
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in rows], "doc_id long, text string, source string").repartition(3)
    got = source_mix.mix_digest(docs, source_mix.MixTarget(block_tokens=block_tokens)).collect()
    want = Counter(r["doc_id"] for r in mixing(rows, block_tokens))
    assert Counter(r.doc_id for r in got) == want and max(want.values()) > 1
    assert all(r.n_tokens == len(words_of(rows[r.doc_id]["text"])) for r in got)


def test_run_equals_the_plain_chain(spark, tmp_path):
    import sentencepiece

    rows = fixture()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.Table.from_pylist([{**r, "lang": "en", "n_chars": len(r["text"] or "")} for r in rows], schema), tmp_path / "documents.parquet")
    good = quality(rows)
    first = near_duplicates(good)
    assert len(first) < len(good) < len(rows)
    forest = secret_scan.train(secret_scan.labelled_findings(spark))
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in first], "doc_id long, text string")
    verdicts = {(f.doc_id, f.start): f.is_secret for f in secret_scan.findings_digest(docs, forest).collect()}
    assert set(verdicts.values()) == {True, False}
    taken = mixing(secrets(first, verdicts))
    times = Counter(r["doc_id"] for r in taken)
    assert max(times.values()) > 1 and len(times) < len(first)
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizers_.path("piece_bpe_32k.model"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for r in taken:
        ids = lib.encode(r["text"])
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)), True, ids))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_ok", "ids").collect()
    assert sorted(map(tuple, got)) == sorted(want)
