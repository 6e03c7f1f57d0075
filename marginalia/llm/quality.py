"""Document quality by Bradley-Terry: scores learned from pairs of which one is preferred."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_row, hash_sample

#: What `features` returns, in its order.
FEATURES = ("log words", "log chars in words", "word size", "symbols", "upper", "shout", "marks", "digits", "bars", "letters", "variety", "spread", "same next", "top word", "lines", "same lines", "short lines", "ends well", "starts", "symbol words", "tables", "braces", "long words", "beyond ascii", "links")
SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\r\x0b\x0c"


def features(text: str | None) -> np.ndarray:
    """Numbers that describe a whole text: shares of kinds of characters, words and lines. Null is an empty text."""
    text = text or ""
    raw = text.encode()
    w = raw.split()
    n, size = len(w), max(1, len(raw))
    solid = max(1, len(raw.translate(None, _WHITE)))
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    lower = text.lower()
    letters = max(1, count(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") + count(bytes(range(128, 256))) / 2)
    upper = sum(map(lambda a, b: a != b, text, lower)) if len(text) == len(lower) else count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    seen = Counter(w)
    n1 = max(1, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = len(set(lines))
    freq = np.fromiter(seen.values(), float, len(seen)) / n1
    same = sum(map(bytes.__eq__, w, w[1:])) if n else 0
    first = lines and sum(x[:1].isupper() for x in lines) / len(lines) or 0
    ends = lines and sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines) or 0
    symbol_words = sum(x[-1] in SYMBOLS for x in w) / n1
    return np.array([
        np.log1p(n), np.log1p(solid), min(30, solid / n1), count(SYMBOLS) / solid, upper / letters, count(b"!") / n1, count(b".,;:?\"'()") / n1, count(b"0123456789") / solid, count(b"|") / n1,
        letters / solid, len(seen) / n1**0.8, float(-(freq * np.log(freq)).sum()) / np.log(n + 2) if n else 0, same / n1, float(freq.max()) if n else 0, min(1, len(lines) / n1), 1 - distinct / max(1, len(lines)),
        sum(len(x) < 20 for x in lines) / max(1, len(lines)), ends, first, symbol_words, sum(x.count(b"|") > 2 for x in lines) / max(1, len(lines)), count(b"{}[]=\\/_") / solid, sum(len(x) > 25 for x in w) / n1, count(bytes(range(128, 256))) / size, lower.count("http") / n1,
    ])


def spread_out(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Features at three scales: as they are, their roots, and their small values up close."""
    y = np.clip((x - low) / np.maximum(1e-9, high - low), 0, 1)
    return np.concatenate([y, np.sqrt(y), np.minimum(1, 8 * y), y[..., :2] ** 2], axis=-1)


@dataclass
class BradleyTerry:
    """Weights of the features' differences; ``scale`` and ``shift`` turn a strength to the chance of label 1."""

    low: np.ndarray
    high: np.ndarray
    weights: np.ndarray
    scale: float
    shift: float
    low_share: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return spread_out(x, self.low, self.high) @ self.weights

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.strength(features(text)) + self.shift, -50, 50))))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 12000, rivals: int = 16, rounds: int = 400) -> BradleyTerry:
    """A model of (doc_id, text) rows whose doc_id has a ``quality`` of 0 or 1 in ``labels``.

    At most about ``train_rows`` labelled rows are learned from, a sample by a
    hash of the doc_id; their features are made in Spark's tasks, and only
    those come to the driver. Each row of label 0 meets ``rivals`` of label 1;
    the logistic loss of the difference of the two is brought down by gradient
    steps. A table with only one label gives all documents that label's share,
    one without labels a half to all.

    Null and empty texts have the features of an empty text. A doc_id that
    stands twice in ``docs`` is learned from once, one with both labels once
    for each; null doc_ids and other labels not at all.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    some = hash_sample(known, F.col("doc_id"), known.count(), train_rows)
    # the sample's bound makes it small, so that no text is shuffled
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    kind = dict(docs.dtypes)["doc_id"]
    every = by_row(rows, ["doc_id", "text", "quality"], f"doc_id {kind}, quality int, x array<double>", lambda b: {"doc_id": b["doc_id"], "quality": b["quality"], "x": [features(t).tolist() for t in b["text"]]})
    got = every.groupBy("doc_id", "quality").agg(F.min("x").alias("x")).select("quality", "x").collect()
    got.sort(key=lambda r: (r[0], r[1]))
    y, n = np.array([r[0] for r in got], int), len(FEATURES)
    x = np.array([r[1] for r in got], float).reshape(len(got), n)
    if not len(y) or y.min() == y.max():
        p = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return BradleyTerry(np.zeros(n), np.ones(n), np.zeros(3 * n + 2), 0.0, float(np.log(p / (1 - p))), float(1 - p))
    low, high = np.quantile(x, 0.001, axis=0), np.quantile(x, 0.999, axis=0)
    z = spread_out(x, low, high)
    rng = np.random.default_rng(11)
    bad, good = np.flatnonzero(y == 0), np.flatnonzero(y == 1)
    losers = np.repeat(bad, rivals)
    winners = good[rng.integers(0, len(good), len(losers))]
    w, m, v = np.zeros(z.shape[1]), np.zeros(z.shape[1]), np.zeros(z.shape[1])
    for t in range(1, rounds + 1):
        s = z @ w
        g = np.zeros(len(y))
        p = 1 / (1 + np.exp(np.clip(s[winners] - s[losers], -50, 50)))
        np.add.at(g, winners, -p)
        np.add.at(g, losers, p)
        grad = z.T @ g / len(losers) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    s = z @ w
    a, b = 1.0, 0.0
    for _ in range(200):  # the chance of label 1 at a strength, by Newton's method
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -50, 50)))
        d, h = np.array([((p - y) * s).sum() + 1e-3 * a, (p - y).sum()]), p * (1 - p) + 1e-9
        hess = np.array([[(h * s * s).sum() + 1e-3, (h * s).sum()], [(h * s).sum(), h.sum()]])
        da, db = np.linalg.solve(hess + 1e-6 * np.eye(2), d)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -5, 5)
    return BradleyTerry(low, high, w, float(a), float(b), float((y == 0).mean()))


def scored(docs: DataFrame, model: BradleyTerry) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text); null and empty texts have a score too."""
    kind, shared = dict(docs.dtypes)["doc_id"], docs.sparkSession.sparkContext.broadcast(model)
    return by_row(docs, ["doc_id", "text"], f"doc_id {kind}, score double", lambda x: {"doc_id": x["doc_id"], "score": [shared.value.score(t) for t in x["text"]]})


def quantile_cut(scores: DataFrame, share: float) -> float:
    """The score that ``share`` of all rows lie below, to within 0.1 % of the rows; 0 for no rows."""
    got = scores.select(F.percentile_approx("score", F.lit(float(share)), F.lit(1000))).first()[0]
    return float(got or 0.0)
