"""Language identification by error-correcting output codes.

Each language has a codeword; one binary classifier on hashed byte n-grams predicts each bit.  A text goes to
the codeword with the least loss-weighted distance, and is flagged as ambiguous if two are nearly as close.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import exact, ids_of

DIMENSIONS = 2048
#: Bound of the labelled sample that the classifiers are fitted on.
TRAIN_ROWS = 3000
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double, ambiguous boolean"


def features(texts: list[str], dims: int = DIMENSIONS) -> np.ndarray:
    """Square-root frequencies of hashed byte bigrams and trigrams of whole lower-case texts, as unit vectors."""
    out = np.zeros((len(texts), dims), np.float32)
    for k, text in enumerate(texts):
        b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", np.uint8).astype(np.uint32)
        two = b[:-1] * np.uint32(257) + b[1:]
        for codes, salt in ((two, 0x9E3779B1), (two[:-1] * np.uint32(263) + b[2:], 0x85EBCA6B)):
            out[k] += np.bincount((codes * np.uint32(salt)) >> np.uint32(32 - (dims.bit_length() - 1)), minlength=dims)
    np.sqrt(out, out=out)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-12)


def codewords(n: int) -> np.ndarray:
    """A code matrix of -1 and 1 for ``n`` classes: exhaustive up to 7, else the best of many random dense codes."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        bits = [[1 if r == 0 or (c >> (r - 1)) & 1 else -1 for r in range(n)] for c in range(2 ** (n - 1) - 1)]
        return np.asarray(bits, float).T
    rng, length, best, far = np.random.default_rng(7), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, length))
        gap = (length - (code @ code.T - 2 * length * np.eye(n))).min()
        if gap > far:
            best, far = code, gap
    return best


@dataclass
class LanguageModel:
    """Sizes depend on the numbers of languages and dimensions alone, so the model may be sent to every task."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weights: np.ndarray
    sharpness: float = 6.0
    margin: float = 0.2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        margins = x @ self.weights + self.bias
        loss = np.stack([(np.logaddexp(0, -margins * c) * self.bit_weights).sum(1) for c in self.code], 1)
        z = -self.sharpness * (loss - loss.min(1, keepdims=True))
        p = np.exp(z)
        return p / p.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
        rows = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not rows or not self.langs:
            return out
        for at in range(0, len(rows), 256):
            part = rows[at : at + 256]
            p = self.probabilities(features([texts[k] for k in part], self.weights.shape[0]))
            order = np.sort(p, 1)
            for k, row, ranked in zip(part, p, order, strict=True):
                close = len(self.langs) > 1 and ranked[-1] - ranked[-2] < self.margin
                out[k] = (self.langs[int(row.argmax())], float(min(1.0, row.max())), bool(close))
        return out


def fit(x: np.ndarray, langs: list[str], dims: int = DIMENSIONS, steps: int = 150, ridge: float = 1e-4) -> LanguageModel:
    """Logistic classifiers of all code bits together, from the features ``x`` of texts in ``langs``, by accelerated gradient steps; bits weigh by their log odds of being right."""
    names = sorted(set(langs))
    code = codewords(len(names))
    if len(names) < 2:
        return LanguageModel(names, code, np.zeros((dims, code.shape[1])), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    y = code[[names.index(v) for v in langs]].astype(np.float32)
    w, b = np.zeros((dims, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    vw, vb, pw, pb = w.copy(), b.copy(), w, b
    rate = np.float32(8.0)
    for t in range(steps):
        g = -y / (1 + np.exp(np.clip(y * (x @ vw + vb), -30, 30))) / np.float32(len(x))
        w, b = vw - rate * (x.T @ g + np.float32(ridge) * vw), vb - rate * g.sum(0)
        vw, vb = w + np.float32(t / (t + 3)) * (w - pw), b + np.float32(t / (t + 3)) * (b - pb)
        pw, pb = w, b
    wrong = (np.sign(x @ w + b) != y).mean(0)
    odds = 0.5 * np.log((1 - wrong + 1e-2) / (wrong + 1e-2))
    return LanguageModel(names, code, w, b, np.maximum(odds, 0) / max(odds.sum(), 1e-9))


def held_out(column: str) -> Column:
    """crc32 of the decimal doc_id, modulo 4, is 2; null doc_ids are never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rows: int = TRAIN_ROWS, dims: int = DIMENSIONS) -> LanguageModel:
    """Fit on at most ``rows`` labelled documents outside the held-out quarter, the least by a hash of doc_id and text.

    The bound is of the labelled sample alone.  The least hashes are found first, by 8 bytes a row; then the tasks send the features of
    those documents, which have one size whatever the lengths of the texts.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")).select(F.xxhash64("doc_id", "text").alias("h"), F.col("lang").cast("string").alias("lang"), "text")
    last = known.select("h").orderBy("h").limit(rows).agg(F.max("h")).first()[0]

    def sent(batches):
        for pdf in batches:
            x = features(pdf["text"].tolist(), dims)
            yield pd.DataFrame({"h": pdf["h"], "lang": pdf["lang"], "x": [row.tobytes() for row in x]})

    sample = known.filter(F.col("h") <= F.lit(last)).mapInPandas(sent, "h long, lang string, x binary").limit(rows)
    pdf = sample.toPandas().sort_values(["h", "lang"]) if last is not None else pd.DataFrame({"lang": [], "x": []})
    x = np.frombuffer(b"".join(pdf["x"]), np.float32).reshape(len(pdf), dims)
    return fit(x, pdf["lang"].tolist(), dims)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every whole text, from the text alone.

    Null texts and texts without a letter are ``und`` with score 0; so is everything if no row was labelled.
    Narrow: no shuffle.
    """

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame(model.predict([t if isinstance(t, str) else None for t in pdf["text"]]), columns=["lang_pred", "score", "ambiguous"])
            out.insert(0, "doc_id", ids_of(pdf, "doc_id"))
            yield out

    return docs.select(*exact("doc_id"), "text").mapInPandas(run, SCHEMA)


def language_digest(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Train on the labelled sample and predict every document; held_out marks the quarter that is never learned from.

    Rows without doc_id and repeated rows are predicted each by itself; an empty table gives no rows.
    """
    return predict(docs, train(docs, rows)).withColumn("held_out", held_out("doc_id"))
