"""Language codes against a plain version: features by dictionaries, codewords as splits of the languages, one classifier at a time, decoding by hand."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from dataclasses import replace

import numpy as np
import pytest

from pagewarden.llm import language_codes as L

WORDS = {"aa": ["kata", "lopa", "mira", "sule"], "bb": ["xiq", "zuq", "wex", "kata"], "cc": ["őűt", "áéí", "űő", "lopa"], "dd": ["theb", "ing", "mira", "zuq"]}


def corpus(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(1, 12))), lang) for k in range(n) for lang in [rng.choice(sorted(WORDS))]]


def plain_features(text: str, dims: int) -> list[float]:
    data = b" " + text.lower().encode() + b" "
    counts = [0] * dims
    shift = 32 - int(math.log2(dims))
    for a, b in itertools.pairwise(data):
        counts[((a * 257 + b) * 0x9E3779B1 % 2**32) >> shift] += 1
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        counts[(((a * 257 + b) * 263 + c) * 0x85EBCA6B % 2**32) >> shift] += 1
    norm = math.sqrt(sum(counts))
    return [math.sqrt(c) / norm for c in counts]


def plain_code(n: int) -> list[tuple]:
    """Every split of n classes into two parts, written so that the first class is 1."""
    return [(1, *rest) for rest in itertools.product((1, -1), repeat=n - 1) if -1 in rest]


def plain_bits(x: np.ndarray, y: np.ndarray, steps: int, ridge: float) -> tuple[np.ndarray, float, float]:
    """One bit's logistic classifier in double precision by Nesterov's steps, and its share of errors."""
    w, b = np.zeros(x.shape[1]), 0.0
    at_w, at_b = w, b
    for t in range(steps):
        slope = np.asarray([-c / (1 + math.exp(max(-30, min(30, c * (float(r @ at_w) + at_b))))) for r, c in zip(x, y, strict=True)]) / len(x)
        new_w, new_b = at_w - 8.0 * (x.T @ slope + ridge * at_w), at_b - 8.0 * slope.sum()
        at_w, at_b, w, b = new_w + t / (t + 3) * (new_w - w), new_b + t / (t + 3) * (new_b - b), new_w, new_b
    return w, b, float(np.mean([(1 if r @ w + b > 0 else -1) != c for r, c in zip(x, y, strict=True)]))


def plain_decode(model: L.LanguageModel, text: str | None) -> tuple[str, float, bool]:
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0, True
    x = plain_features(text, model.weights.shape[0])
    margins = [sum(v * float(w) for v, w in zip(x, column, strict=True)) + float(b) for column, b in zip(model.weights.T, model.bias, strict=True)]
    losses = [sum(float(u) * math.log1p(math.exp(-m * c)) for m, c, u in zip(margins, word, model.bit_weights, strict=True)) for word in model.code]
    weights = [math.exp(-model.sharpness * (v - min(losses))) for v in losses]
    shares = sorted((w / sum(weights) for w in weights), reverse=True)
    return model.langs[losses.index(min(losses))], shares[0], shares[0] - shares[1] < model.margin


@pytest.mark.parametrize("n", [2, 3, 4, 5, 7])
def test_codewords_are_all_splits(n):
    code = L.codewords(n)
    columns = {tuple(int(v) * int(column[0]) for v in column) for column in code.T}
    assert columns == set(plain_code(n)) and code.shape[1] == len(columns)


@pytest.mark.parametrize("n", [8, 20, 60])
def test_codewords_of_many_languages_are_far_apart(n):
    code = L.codewords(n)
    gaps = [(a != b).sum() for a, b in itertools.combinations(code, 2)]
    assert min(gaps) >= 0.2 * code.shape[1] and (np.abs(code.sum(0)) < n).all()


def test_features_are_the_plain_ones():
    texts = ["", "a", "Kata lopa", "őűt É 日本 😀", "x" * 5000]
    assert np.allclose(L.features(texts, 128), [plain_features(t, 128) for t in texts], atol=1e-6)


def test_bits_are_the_plain_ones():
    rows = corpus(80, 1)
    x = L.features([t for _, t, _ in rows], 64)
    model = L.fit(x, [v for *_, v in rows], 64, steps=40)
    names = sorted(WORDS)
    raw = []
    for k, column in enumerate(model.code.T):
        y = np.asarray([column[names.index(v)] for *_, v in rows])
        w, b, wrong = plain_bits(x.astype(float), y, 40, 1e-4)
        assert np.allclose(model.weights[:, k], w, atol=2e-3) and abs(model.bias[k] - b) < 2e-3
        raw.append(0.5 * math.log((1 - wrong + 0.01) / (wrong + 0.01)))
    assert np.allclose(model.bit_weights, [max(v, 0) / sum(raw) for v in raw], atol=1e-3)


def test_decoding_of_a_table_is_the_plain_one(spark):
    """The whole operator: fit on the labelled rows that are not held out, decode each text by hand."""
    rows = [*corpus(260, 2), (900, None, "aa"), (901, "12 !", "bb"), (902, "", None), (903, "kata xiq", None), (903, "őűt", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = L.train(frame)
    learned = [(i, t, v) for i, t, v in rows if v is not None and t is not None and zlib.crc32(str(i).encode()) % 4 != 2]
    again = L.fit(L.features([t for _, t, _ in learned]), [v for *_, v in learned])
    assert model.langs == again.langs == sorted(WORDS)
    want = sorted((i, zlib.crc32(str(i).encode()) % 4 == 2, *plain_decode(model, t)) for i, t, _ in rows)
    got = sorted((r.doc_id, r.held_out, r.lang_pred, r.score, r.ambiguous) for r in L.language_digest(frame).collect())
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 1e-3 and g[4] == w[4]
    # With a margin in the midst of the texts' own, both flags are told.
    lead = sorted(2 * w[3] - 1 for w in want if w[2] != "und")
    strict = replace(model, margin=lead[len(lead) // 2])
    texts = [t for _, t, _ in rows]
    flags = [(f, plain_decode(strict, t)[2]) for (_, _, f), t in zip(strict.predict(texts), texts, strict=True)]
    assert sum(a == b for a, b in flags) >= len(flags) - 3 and len({a for a, _ in flags}) == 2
    sure = {i: v for i, _, v in rows}
    assert sum(g[2] == sure[g[0]] for g in got[:260] if g[1]) >= 0.8 * sum(g[1] for g in got[:260])
