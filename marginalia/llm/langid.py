"""Language identification by error-correcting output codes over byte n-grams."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_row, hash_sample_by, unused, with_text_verdict

#: Cells that byte n-grams of one to three bytes are hashed to.
CELLS = 1 << 12
_WORD = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    """Whether a text has a letter; signs of numbers, such as a half or a small two, are none."""
    return any(m.group().isalpha() for m in _WORD.finditer(text))


def profile(text: str) -> np.ndarray:
    """Unit vector of the square roots of hashed n-gram counts of the whole text in lower case."""
    b = np.frombuffer(f" {text.lower()} ".encode(), np.uint8).astype(np.uint32)
    pairs = b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77)
    triples = pairs[:-1] * np.uint32(5) + b[2:] * np.uint32(0xC2B2AE3D)
    counts = np.bincount(b & 255, minlength=CELLS)
    for grams in (pairs, triples):
        counts = counts + np.bincount((grams >> np.uint32(16)) & np.uint32(CELLS - 1), minlength=CELLS)
    x = np.sqrt(counts, dtype=np.float32)
    return x / max(1e-9, float(np.linalg.norm(x)))


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """A row of -1 and 1 for each class, rows and columns well apart.

    Up to five classes have every split of the classes as a column. More have
    about ten columns for each doubling, the best of some random matrices by
    the least distance of two rows.
    """
    if classes <= 1:
        return np.ones((classes, 1), np.float32)
    if classes <= 5:
        splits = np.arange(1, 1 << (classes - 1))
        return np.where((splits[None, :] >> np.arange(classes)[:, None]) & 1, -1.0, 1.0).astype(np.float32)
    rng, width, best, apart = np.random.default_rng(seed), int(10 * np.ceil(np.log2(classes))), None, -1
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (classes, width)).astype(np.float32)
        m = m[:, np.abs(m.sum(0)) < classes]
        d = int(((m[:, None] != m[None]).sum(2) + np.eye(classes, dtype=int) * m.shape[1]).min())
        if d > apart:
            best, apart = m, d
    return best


@dataclass
class Coder:
    """The learned bits: ``weights`` (cells, bits), a bias and a trust for each bit, and the classes' codewords."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray
    sharp: float = 1.0

    def losses(self, x: np.ndarray) -> np.ndarray:
        """For rows of profiles, the trusted logistic losses of the bits against each codeword, averaged."""
        margins = x @ self.weights + self.bias
        each = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        return (each * self.trust).sum(2) / self.trust.sum()

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous): ``und``, 0 and True for null texts and texts without a letter.

        Where no language was learned, texts with a letter are ``und`` too, but not ambiguous.
        The score is the share of the nearest codeword when losses are turned
        to weights; a text is ambiguous if the second has over 0.45 of it all.
        """
        if not text or not has_letter(text):
            return UNDETERMINED, 0.0, True
        if not self.languages:
            return UNDETERMINED, 0.0, False
        loss = self.losses(profile(text)[None])[0]
        share = np.exp(self.sharp * (loss.min() - loss))
        share /= share.sum()
        order = np.argsort(-share, kind="stable")
        return self.languages[order[0]], float(share[order[0]]), len(order) > 1 and bool(share[order[1]] > 0.45)


def _snippets(text: str) -> list[str]:
    """The whole text and two short pieces of it at places its length decides, as texts may be one word."""
    n = len(text)
    return [text] + [text[a : a + size] for a, size in ((n * 37 % max(1, n - 30), 30), (n * 53 % max(1, n - 80), 80))] * (n > 90)


def fit(docs: DataFrame, train_rows: int = 2400, rounds: int = 150, most_languages: int = 256) -> Coder:
    """A ``Coder`` learned from (doc_id, text, lang) rows with text and lang.

    About ``train_rows`` rows in equal parts, but 200 for each language at
    least, are learned from, a sample by a hash of the doc_id taken in one
    pass; profiles are made in Spark's tasks and the driver holds three times
    so many rows of ``CELLS`` small numbers. Languages are the
    ``most_languages`` values of lang with the most rows (ties by name), so
    that a column of stray values has a bound too. Rows that repeat a doc_id
    are in the sample together or not at all; without a text and lang nothing
    is learned.
    """
    rows = docs.where("text is not null and lang is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    languages = sorted(sizes)
    if not languages:
        return Coder([], codewords(0), np.zeros((CELLS, 1), np.float32), np.zeros(1), np.ones(1))
    some = hash_sample_by(rows, F.col("doc_id"), "lang", sizes, max(200, train_rows // len(languages)))

    def profiles(x: dict) -> dict:
        kept = [(lang, profile(piece)) for text, lang in zip(x["text"], x["lang"]) if has_letter(text) for piece in _snippets(text)]
        return {"lang": [k for k, _ in kept], "cells": [np.rint(p * 255).astype(np.uint8).tobytes() for _, p in kept]}

    got = by_row(some, ["text", "lang"], "lang string, cells binary", profiles).collect()
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    x = np.frombuffer(b"".join(bytes(r[1]) for r in got), np.uint8).reshape(len(got), CELLS).astype(np.float32)
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    known = np.array([languages.index(r[0]) for r in got])
    code = codewords(len(languages))
    y = code[known]
    each = np.bincount(known, minlength=len(languages)).clip(1)
    share = (len(known) / (len(languages) * each))[known][:, None].astype(np.float32) / len(known)
    w, b = np.zeros((CELLS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    v, c, step = w.copy(), b.copy(), np.float32(20.0)
    for t in range(rounds):
        m = y * (x @ v + c)
        g = -y * share / (1 + np.exp(m))
        w2, b2 = v - step * (x.T @ g + 1e-5 * v), c - step * 0.1 * g.sum(0)
        pull = t / (t + 3)
        v, c, w, b = w2 + pull * (w2 - w), b2 + pull * (b2 - b), w2, b2
    right = ((x @ w + b) * y > 0).mean(0)
    trust = np.log(np.clip(right, 0.501, 0.999) / (1 - np.clip(right, 0.501, 0.999)))
    coder = Coder(languages, code, w, b, trust.astype(np.float32))
    loss = coder.losses(x)
    own = loss[np.arange(len(known)), known]
    spread = np.partition(loss, 1, axis=1)[:, 1] - own if len(languages) > 1 else own + 1
    coder.sharp = float(4 / max(1e-3, np.median(np.abs(spread))))
    return coder


def identify(docs: DataFrame, coder: Coder) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) for each row of ``docs``; other columns are not looked at."""
    kind, shared = dict(docs.dtypes)["doc_id"], docs.sparkSession.sparkContext.broadcast(coder)

    def f(x: dict) -> dict:
        got = [shared.value.decide(t) for t in x["text"]]
        return {"doc_id": x["doc_id"], "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "ambiguous": [g[2] for g in got]}

    return by_row(docs, ["doc_id", "text"], f"doc_id {kind}, lang_pred string, score double, ambiguous boolean", f)


def keep_identified(docs: DataFrame, coder: Coder) -> DataFrame:
    """``docs``, all columns as they are, without the rows that have no language or an ambiguous one.

    Null texts and texts without a letter go; if the coder has learned no language, all others stay.
    """
    shared, mark = docs.sparkSession.sparkContext.broadcast(coder), unused("ambiguous", docs.columns)
    return with_text_verdict(docs, f"{mark} boolean", lambda texts: {mark: [shared.value.decide(t)[2] for t in texts]}).where(~F.col(mark)).drop(mark)
