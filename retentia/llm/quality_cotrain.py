"""Quality by co-training of two views.

* Content view: statistics of the words and characters of the whole text.
* Metadata view: language, source, length and line layout.

Both start from labelled rows. In each round either classifier labels the pool
rows that it is surest of (both classes, in the labelled proportion) and hands
them to the other. The views' scores are then calibrated and combined by a
logistic regression on labelled rows kept out of the rounds, and the combined
model scores every document.

Fitting uses at most ``MAX_LABELLED`` labelled and ``MAX_POOL`` unlabelled rows,
by hash of the id; the models have a fixed size.

Defined cases: null text counts as empty; null lang and source are values of
their own; a text without words is scored like any other; without labelled
rows of both classes all scores are the smoothed share; a null doc_id keeps its
row; extra columns are ignored by the scores and kept by ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, each, through_pandas

MAX_LABELLED = 8_000
MAX_POOL = 8_000
ROUNDS = 4
ADD = 400  # pool rows that a view hands over in a round
HASHED = 16  # hashed values each of lang and source


def content(text) -> list[float]:
    t = text if isinstance(text, str) else ""
    a = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
    n = max(len(a), 1)
    kinds = np.bincount(a, minlength=256) / n
    words = t.split()
    k = max(len(words), 1)
    low = [w.lower() for w in words]
    top = Counter(low).most_common(5)
    lines = [s for s in t.split("\n") if s.strip()]
    upper = sum(c for c in kinds[65:91])
    marks = [float(sum(kinds[ord(c)] for c in group)) for group in ("!?", "#*$%&|<>@^~_=+", ".,;:", "0123456789", "'\"()[]{}", " \n\t")]
    return [
        1.0, np.log1p(len(words)) / 8, float(upper), *marks,
        len(set(low)) / k, sum(x == y for x, y in zip(low, low[1:])) / k,
        top[0][1] / k if top else 0.0, sum(c for _, c in top) / k,
        sum(map(len, words)) / k / 10, sum(w.isupper() and len(w) > 1 for w in words) / k,
        sum(not any(c.isalnum() for c in w) for w in words) / k,
        sum(w[-1] in "!#*$%&" for w in words) / k,
        1 - len(set(lines)) / max(len(lines), 1), sum(len(s.split()) < 4 for s in lines) / max(len(lines), 1),
        len(set(zip(low, low[1:]))) / k, float(len(words) < 20), float(len(words) < 50),
    ]


def metadata(text, lang, source) -> list[float]:
    t = text if isinstance(text, str) else ""
    sizes = [len(s) for s in t.split("\n")]
    one = [0.0] * (2 * HASHED)
    one[zlib.crc32(str(lang).encode()) % HASHED] = 1.0
    one[HASHED + zlib.crc32(str(source).encode()) % HASHED] = 1.0
    n = len(t)
    return [
        1.0, np.log1p(n) / 10, float(n < 100), float(n < 300), float(n > 10_000), np.log1p(len(sizes)) / 5,
        np.log1p(np.mean(sizes)) / 8, np.log1p(np.std(sizes)) / 8, min(sizes) / (1 + max(sizes)), float(len(sizes) == 1), *one,
    ]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, steps: int = 25) -> np.ndarray:
    """Newton steps for penalised logistic regression; classes weigh the same."""
    s = np.where(y > 0.5, 0.5 / max(weight[y > 0.5].sum(), 1e-9), 0.5 / max(weight[y <= 0.5].sum(), 1e-9)) * weight
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (s * (p - y)) + l2 * w
        h = (x * (s * p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Two views' weights and the weights that calibrate and combine them."""

    def __init__(self, views, y, pool, calibrate):
        """views, pool: (content, metadata) matrices; calibrate: (views, y)."""
        self.norm = [(v.mean(axis=0), v.std(axis=0) + 1e-3) for v in views]
        views, pool = [self._scaled(v, i) for i, v in enumerate(views)], [self._scaled(v, i) for i, v in enumerate(pool)]
        share = y.mean()
        sets = [(v, y, np.ones(len(y))) for v in views]
        free = np.ones(len(pool[0]), bool)
        self.w = [logistic(*s) for s in sets]
        for _ in range(ROUNDS):
            for i in (0, 1):
                p = _sigmoid(pool[i] @ self.w[i])
                order = np.flatnonzero(free)[np.argsort(p[free])]
                n_bad = min(int(ADD * (1 - share)), len(order) // 4)
                n_good = min(int(ADD * share), len(order) // 4)
                bad, good = order[:n_bad], order[len(order) - n_good :]
                bad, good = bad[p[bad] < 0.1], good[p[good] > 0.9]
                new = np.concatenate([bad, good])
                free[new] = False
                x, t, s = sets[1 - i]
                sets[1 - i] = (np.concatenate([x, pool[1 - i][new]]), np.concatenate([t, np.repeat([0.0, 1.0], [len(bad), len(good)])]),
                               np.concatenate([s, np.full(len(new), 0.5)]))
            self.w = [logistic(*s) for s in sets]
        cv, cy = calibrate
        z = self._logits(cv)
        self.final = logistic(z, cy, np.ones(len(cy)), l2=1e-4)
        if share < 1:  # undo the equal class weights: the prior belongs to the probability
            self.final[0] += np.log(share / (1 - share))

    def _scaled(self, v, i):
        mean, std = self.norm[i]
        out = np.clip((v - mean) / std, -8, 8)
        out[:, 0] = 1.0
        return out

    def _logits(self, views):
        z = [np.clip(self._scaled(v, i) @ self.w[i], -12, 12) for i, v in enumerate(views)]
        return np.stack([np.ones(len(z[0])), *z], axis=1)

    def predict(self, views) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = self._logits(views)
        return _sigmoid(z[:, 1]), _sigmoid(z[:, 2]), _sigmoid(z @ self.final)


def _views(texts, langs, sources) -> list[np.ndarray]:
    return [np.array([content(t) for t in texts]), np.array([metadata(*r) for r in zip(texts, langs, sources)])]


def _sample(rows: DataFrame, most: int, salt: int) -> pd.DataFrame:
    """View features of at most about ``most`` rows; texts stay on the executors."""
    n = rows.count()
    rows = rows.filter(F.expr(f"pmod(xxhash64(doc_id, {salt}L), 1000000) < {int(1e6 * min(1, most / max(n, 1)))}"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def f(d: pd.DataFrame) -> pd.DataFrame:
            a, b = _views(d["text"], d["lang"], d["source"])
            return pd.DataFrame({"a": list(a), "b": list(b), "y": d["quality"], "fold": d["fold"]})

        yield from each(frames, f)

    return rows.mapInPandas(run, "a array<double>, b array<double>, y double, fold int").toPandas()


def _columns(docs: DataFrame) -> DataFrame:
    def string(c):
        return (F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")).alias(c)

    return docs.select("doc_id", string("text"), string("lang"), string("source"))


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """A model, or the share of good rows where one class is missing."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality"))
    rows = _columns(docs).withColumn("fold", crc_mod("doc_id", 5).cast("int")).join(known, "doc_id", "left")
    got = _sample(rows.filter("quality IS NOT NULL"), MAX_LABELLED, 21)
    y = got["y"].to_numpy()
    if len(got) < 10 or y.min() == y.max():
        return float((y.sum() + 1) / (len(y) + 1.5)) if len(y) else 2 / 3
    pool = _sample(rows.filter("quality IS NULL"), MAX_POOL, 23)

    def mats(d):
        return [np.array(d[c].tolist()).reshape(len(d), -1) for c in ("a", "b")]

    held = (got["fold"] == 0).to_numpy()
    if y[held].size < 10 or y[held].min() == y[held].max() or y[~held].min() == y[~held].max():
        held[:] = False
    empty = [np.zeros((0, m.shape[1])) for m in mats(got)]
    return Model(mats(got[~held]), y[~held], mats(pool) if len(pool) else empty, (mats(got[held] if held.any() else got), y[held] if held.any() else y))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, content_score, metadata_score, score (all: probability of good quality), kept: a row per input row."""
    model = fit(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def f(d: pd.DataFrame) -> pd.DataFrame:
            a, b, p = model.predict(_views(d["text"], d["lang"], d["source"])) if isinstance(model, Model) else [np.full(len(d), model)] * 3
            return pd.DataFrame({"doc_id": d["doc_id"], "content_score": a, "metadata_score": b, "score": p})

        yield from each(frames, f)

    out = through_pandas(_columns(docs), run, f"doc_id {kind}, content_score double, metadata_score double, score double")
    return out.withColumn("kept", F.col("score") >= 0.5)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the combined model rejects; the rows stay where they are."""
    model = fit(docs, labels)
    schema = docs.schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def f(d: pd.DataFrame) -> pd.DataFrame:
            lang = d["lang"] if "lang" in d else [None] * len(d)
            source = d["source"] if "source" in d else [None] * len(d)
            p = model.predict(_views(d["text"], lang, source))[2] if isinstance(model, Model) else np.full(len(d), model)
            return d[p >= 0.5]

        yield from each(frames, f)

    return through_pandas(docs, run, schema, tuple(docs.columns))
