"""Language identification by hierarchical discrimination.

Features are hashed byte n-grams (1 to 4 bytes of the lower-case text) and
whole words over the whole text; a text's vector holds their relative
frequencies, so a score is a mean of weights over the text and needs no vector.

* Level 1: a linear classifier for the language family (softmax regression).
* Level 2: within the family, one linear support vector machine for each pair
  of languages (Pegasos, averaged); the language with most votes wins, ties go
  to the larger sum of margins.

Families are given (``FAMILIES``); a language outside them is a family of its
own. The models are fitted on about ``MAX_ROWS`` labelled rows, the same number
of each language (all rows of a rarer one, ``MIN_LANG_ROWS`` at least where
there are so many), on whole texts; they have a fixed size per language.

Defined cases: null text or no letter gives ``und`` with score 0; a null lang
is never learned from; without any labelled row all are ``und``; a null doc_id
keeps its row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each, through_pandas

#: Languages by family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg"],
}
FAMILY_OF = {lang: f for f, langs in FAMILIES.items() for lang in langs}

BITS = 13
MAX_ROWS = 4_000
MIN_LANG_ROWS = 50
HASHES = 1 << 40
SLICE = 1 << 16  # bytes hashed at once
EPOCHS = 12

_LETTER = regex.compile(r"\p{L}")


def features(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of the whole text, slice by slice."""
    mask = np.uint64((1 << BITS) - 1)
    data = " ".join(text.lower().split()).encode("utf-8", "replace")
    a = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint64)
    for lo in range(0, len(a), SLICE):
        s = a[lo : lo + SLICE + 3]
        for n in range(1, 5):
            m = min(SLICE, len(s)) if n == 1 else len(s) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for j in range(n):
                h = (h + s[j : j + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield (h & mask).astype(np.int64)


def vector(text: str) -> np.ndarray:
    """Root of the n-grams' relative frequencies, unit length (for fitting)."""
    x = np.zeros(1 << BITS, np.float32)
    for h in features(text):
        x += np.bincount(h, minlength=1 << BITS)
    n = x.sum()
    return np.sqrt(x / n) if n else x


def softmax_fit(x: np.ndarray, y: np.ndarray, k: int, rate: float = 2.0, steps: int = 150) -> np.ndarray:
    """Weights (k, features + 1) of softmax regression by gradient steps with momentum."""
    w, v = np.zeros((k, x.shape[1]), np.float32), 0.0
    onehot = np.eye(k, dtype=np.float32)[y]
    share = 1 / np.maximum(onehot.sum(axis=0), 1)
    weight = (onehot @ share / k).astype(np.float32)[:, None]
    for _ in range(steps):
        z = x @ w.T * 10
        z = np.exp(z - z.max(axis=1, keepdims=True))
        g = ((z / z.sum(axis=1, keepdims=True) - onehot) * weight).T @ x
        v = 0.9 * v - rate * (g + 1e-5 * w)
        w = w + v
    return w * 10


def svm_fit(x: np.ndarray, y: np.ndarray, lam: float = 1e-4, epochs: int = EPOCHS) -> np.ndarray:
    """Averaged Pegasos in blocks of 64 rows; y is -1 or 1, classes weigh the same."""
    rng = np.random.default_rng(7)
    share = np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    w, mean, t = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float64), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 64):
            b = order[lo : lo + 64]
            t += 1
            rate = 1 / (lam * (t + 100))
            miss = y[b] * (x[b] @ w) < 1
            w = (1 - rate * lam) * w + rate / len(b) * ((y[b] * share[b] * miss) @ x[b]).astype(np.float32)
            mean += w
    return (mean / max(t, 1)).astype(np.float32)


class Model:
    """Family weights and, for each family, its languages and their pairs' weights."""

    def __init__(self, texts: list[str], langs: list[str]):
        x = np.stack([vector(t) for t in texts])
        self.langs = sorted(set(langs))
        self.families = sorted({FAMILY_OF.get(s, s) for s in self.langs})
        fam = np.array([self.families.index(FAMILY_OF.get(s, s)) for s in langs])
        lang = np.array(langs)
        self.family = softmax_fit(x, fam, len(self.families)) if len(self.families) > 1 else np.zeros((1, x.shape[1]), np.float32)
        self.members = [[s for s in self.langs if FAMILY_OF.get(s, s) == f] for f in self.families]
        self.pairs = []
        for members in self.members:
            pairs = []
            for a, b in combinations(members, 2):
                at = (lang == a) | (lang == b)
                pairs.append((a, b, svm_fit(x[at], np.where(lang[at] == a, 1.0, -1.0))))
            self.pairs.append(pairs)

    def predict(self, text) -> tuple[str, float]:
        if not isinstance(text, str) or not _LETTER.search(text):
            return "und", 0.0
        x = vector(text)
        z = self.family @ x
        p = np.exp(z - z.max())
        p /= p.sum()
        f = int(np.argmax(p))
        votes = dict.fromkeys(self.members[f], 0)
        margin = dict.fromkeys(self.members[f], 0.0)
        for a, b, w in self.pairs[f]:
            m = float(w @ x)
            votes[a if m >= 0 else b] += 1
            margin[a] += m
            margin[b] -= m
        best = max(self.members[f], key=lambda s: (votes[s], margin[s]))
        sure = 1.0
        if len(self.members[f]) > 1:
            sure = 1 / (1 + np.exp(-2 * margin[best] / (len(self.members[f]) - 1)))
        return best, float(min(max(p[f] * sure, 0.0), 1.0))


def fit(docs: DataFrame, train: Column, max_rows: int = MAX_ROWS) -> Model | None:
    """A model from rows that ``train`` holds for, of each language its share of ``max_rows``, by hash of id and text.

    A language of no more rows than the share, or than ``MIN_LANG_ROWS``, is taken whole, so that none falls out of a larger input.
    """
    rows = docs.filter(train).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    number = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    bound = max(max_rows // max(len(number), 1), MIN_LANG_ROWS)
    limit = {s: HASHES * bound // n for s, n in number.items() if n > bound}
    limits = docs.sparkSession.createDataFrame(list(limit.items()), "lang string, lim bigint")
    hashed = F.expr(f"pmod(xxhash64(doc_id, text, 11L), {HASHES})")
    keep = rows.join(F.broadcast(limits), "lang", "left").filter(F.col("lim").isNull() | (hashed < F.col("lim")))
    got = [(r["text"], r["lang"]) for r in keep.select("text", "lang").toLocalIterator()]
    got = [(t, s) for t, s in got if _LETTER.search(t)]
    return Model([t for t, _ in got], [s for _, s in got]) if got else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score: a row per input row, in the input's order of columns doc_id first."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def f(d: pd.DataFrame) -> pd.DataFrame:
            got = [model.predict(t) if model else ("und", 0.0) for t in d["text"]]
            return pd.DataFrame({"doc_id": d["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})

        yield from each(frames, f)

    return through_pandas(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, lang_pred string, score double")
