"""Toxicity by weak supervision.

1. Voters. From a bounded sample of labelled rows, words and word stems (4 to
   6 letters) that mark toxic rows are mined into lexicons; the lexicons are
   dealt over word voters and stem-pattern voters, next to a hand-written one.
   A voter fires on a text that holds any of its entries.
2. Label model. Means and pairwise moments of all votes over all documents
   are summed in Spark. With class share p, conditionally independent voters
   have covariance p (1 - p) a_i a_j, where a_i is the voter's hit rate on
   toxic texts less that on others. A rank-one fit to the off-diagonal gives
   the accuracies; pairs that it leaves correlated are taken out of the fit,
   and their voters share their weight in the posterior.
3. Classifier. A linear (logistic) model over all mined entries is fitted on
   posterior labels of a bounded sample of documents, and scores every text.

Labels come from the rows that ``train`` holds for; lang, source and doc_id
are no inputs. All models have a fixed size.

Defined cases: null and empty texts get the classifier's bias; without any
toxic labelled row the score is the (smoothed) class share; a null doc_id
keeps its row; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each, through_pandas

#: Plain insults, a hand-written voter.
INSULTS = "clown disgusting dumb fool freak garbage hate idiot jerk kill loser moron pathetic scum shut stupid sucks trash ugly worthless".split()

STEMS = (4, 5, 6)
MAX_TOXIC, MAX_CLEAN = 3_000, 6_000  # labelled rows for mining
MAX_ENTRIES = 1_024
LIFT = 25  # rate on toxic rows to rate on clean rows
WORD_VOTERS, STEM_VOTERS = 10, 8
MAX_FIT = 12_000  # documents with posterior labels
CORRELATED = 0.25

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def _forms(words) -> set[str]:
    return {"=" + w for w in words} | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def entries(text) -> set[str]:
    """Distinct words (``=word``) and stems (``stem*``) of a whole text."""
    if not isinstance(text, str):
        return set()
    return _forms(set(_WORD.findall(text.lower())))


class Held:
    """The entries among ``wanted`` that a text holds.

    Words never span white space, so each distinct blank-delimited string is
    looked up by itself, with a bounded memo of the short ones.
    """

    def __init__(self, wanted, limit: int = 500_000):
        self.wanted, self.limit, self.memo = set(wanted), limit, {}

    def __call__(self, text) -> set[str]:
        out: set[str] = set()
        if not isinstance(text, str):
            return out
        memo = self.memo
        for part in {part.strip(".,") for part in text.lower().split()}:
            got = memo.get(part)
            if got is None:
                words = [part] if part.isalnum() else _WORD.findall(part)
                got = _forms(words) & self.wanted
                if len(part) <= 64:
                    if len(memo) >= self.limit:
                        memo.clear()
                    memo[part] = got
            if got:
                out |= got
        return out


def _thin(rows: DataFrame, most: int, salt: int) -> DataFrame:
    """At most about ``most`` rows, by hash of the id."""
    n = rows.count()
    return rows if n <= most else rows.filter(F.expr(f"pmod(xxhash64(doc_id, {salt}L), 1000000) < {int(1e6 * most / n)}"))


def mine(toxic: Iterator[str], clean: Iterator[str]) -> list[str]:
    """Entries that mark toxic texts, the most telling first; equal texts count once."""
    pos, neg, seen, n_pos, n_neg = Counter(), Counter(), set(), 0, 0
    for t in toxic:
        if t not in seen:
            seen.add(t)
            n_pos += 1
            pos.update(entries(t))
    least = max(4, int(0.006 * n_pos))
    pos = Counter({e: c for e, c in pos.items() if c >= least})
    held = Held(pos)
    for t in clean:
        n_neg += 1
        neg.update(held(t))

    def lift(e: str) -> float:
        return (pos[e] + 0.5) / (n_pos + 1) / ((neg[e] + 0.5) / (n_neg + 1))
    good = [e for e in pos if lift(e) >= LIFT]
    return sorted(good, key=lambda e: (-pos[e] * np.log(lift(e)), e))[:MAX_ENTRIES]


def voters(found: list[str]) -> dict[str, list[int]]:
    """Entry -> the voters that it makes fire."""
    out: dict[str, list[int]] = {}
    words, stems = [e for e in found if e[0] == "="], [e for e in found if e[0] != "="]
    for i, e in enumerate(words):
        out.setdefault(e, []).append(i % WORD_VOTERS)
    for i, e in enumerate(stems):
        out.setdefault(e, []).append(WORD_VOTERS + i % STEM_VOTERS)
    for w in INSULTS:
        out.setdefault("=" + w, []).append(WORD_VOTERS + STEM_VOTERS)
    return out


N_VOTERS = WORD_VOTERS + STEM_VOTERS + 1


def vote(held: set[str], fires: dict[str, list[int]]) -> np.ndarray:
    """Votes on a text that holds the entries ``held``."""
    v = np.zeros(N_VOTERS)
    for e in held:
        v[fires[e]] = 1
    return v


def moments(docs: DataFrame, fires: dict[str, list[int]]) -> tuple[int, np.ndarray]:
    """Rows and the sums of vote products (the diagonal has the hits), added up in Spark."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, held = 0, np.zeros((N_VOTERS, N_VOTERS)), Held(fires)
        for d in frames:
            for t in d["text"]:
                if got := held(t):
                    v = vote(got, fires)
                    total += np.outer(v, v)
            n += len(d)
        yield pd.DataFrame({"k": np.arange(N_VOTERS**2 + 1), "s": np.append(total.ravel(), n)})

    got = docs.select("text").mapInPandas(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()
    flat = np.zeros(N_VOTERS**2 + 1)
    for r in got:
        flat[r["k"]] = r["s"]
    return int(flat[-1]), flat[:-1].reshape(N_VOTERS, N_VOTERS)


class LabelModel:
    """Hit rates of each voter on toxic and on other texts, correlations, posteriors."""

    def __init__(self, n: int, products: np.ndarray, share: float):
        m2 = products / max(n, 1)
        mu = np.diag(m2).copy()
        cov = m2 - np.outer(mu, mu)
        v = share * (1 - share)
        scale = np.sqrt(np.outer(mu * (1 - mu), mu * (1 - mu))) + 1e-12
        use = ~np.eye(len(mu), dtype=bool)
        self.correlation = np.zeros_like(cov)
        for _ in range(4):
            a = np.sqrt(np.maximum((cov * use).max(axis=1), 1e-12) / v)
            for _ in range(200):
                a = np.clip(((cov * use) @ a) / (v * (use @ (a * a)) + 1e-12) * 0.5 + a * 0.5, 0, 1)
            rest = (cov - v * np.outer(a, a)) / scale
            np.fill_diagonal(rest, 0)
            self.correlation = rest
            worse = use & (np.abs(rest) > CORRELATED)
            if not worse.any() or (use & ~worse).sum(axis=1).min() < 3:
                break
            use &= ~worse
        self.share = share
        self.hit = np.clip(mu + (1 - share) * a, 1e-3, 1 - 1e-3)
        self.false_hit = np.clip(mu - share * a, 1e-4, 1 - 1e-3)
        tied = np.where(np.abs(self.correlation) > CORRELATED, np.maximum(self.correlation, 0), 0)
        self.weight = 1 / (1 + tied.sum(axis=1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.hit / self.false_hit)
        off = np.log((1 - self.hit) / (1 - self.false_hit))
        z = np.log(self.share / (1 - self.share)) + (votes * on + (1 - votes) * off) @ self.weight
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels."""
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), -2.0, 0.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = ((p - y) / len(y)).astype(np.float32)
        vw, vb = 0.9 * vw - 4.0 * (x.T @ g + l2 * w), 0.9 * vb - 4.0 * float(g.sum())
        w, b = w + vw, b + vb
    return w, float(b)


class Scorer:
    def __init__(self, found: list[str], w: np.ndarray, b: float):
        self.index, self.b = {e: float(x) for e, x in zip(found, w)}, b
        self.held = Held(self.index)

    def __call__(self, text) -> float:
        z = self.b + sum(self.index[e] for e in sorted(self.held(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> tuple[Scorer, LabelModel | None]:
    d = docs.select("doc_id", F.col("text").cast("string").alias("text"), train.alias("train"))
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = d.filter("train AND text IS NOT NULL").join(known, "doc_id")
    sizes = {r["toxic"]: r["n"] for r in known.filter(train).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    toxic = _thin(rows.filter("toxic = 1"), MAX_TOXIC, 3).select("text").toLocalIterator()
    clean = _thin(rows.filter("toxic = 0"), MAX_CLEAN, 5).select("text").toLocalIterator()
    found = mine((r["text"] for r in toxic), (r["text"] for r in clean))
    if not found:
        return Scorer([], np.zeros(0), float(np.log(share / (1 - share)))), None
    fires = voters(found)
    n, products = moments(d, fires)
    model = LabelModel(n, products, min(max(share, 1e-3), 0.5))
    at = {e: i for i, e in enumerate(found)}

    def seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Held(fires)

        def f(x: pd.DataFrame) -> pd.DataFrame:
            es = [held(t) for t in x["text"]]
            votes = np.array([vote(s, fires) for s in es])
            return pd.DataFrame({"p": model.posterior(votes), "on": [sorted(at[e] for e in s & at.keys()) for s in es]})

        yield from each(frames, f)

    pool = _thin(d.filter("train AND text IS NOT NULL").select("doc_id", "text"), MAX_FIT, 7)
    got = pool.select("text").mapInPandas(seen, "p double, on array<int>").toPandas()
    x = np.zeros((len(got), len(found)), np.float32)
    for i, on in enumerate(got["on"]):
        x[i, list(on)] = 1
    w, b = fit_linear(x, got["p"].to_numpy()) if len(got) else (np.zeros(len(found)), float(np.log(share / (1 - share))))
    return Scorer(found, w, b), model


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score: a row per input row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from each(frames, lambda d: pd.DataFrame({"doc_id": d["doc_id"], "score": [scorer(t) for t in d["text"]]}))

    return through_pandas(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, score double")
