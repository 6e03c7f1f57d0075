"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .shared import by_row, hash_sample, words, written

#: Cells that terms are hashed to.
CELLS = 1 << 19
#: Terms: whole words, and how longer words begin, in bytes.
HEADS = (4, 5, 6, 7)


def cells(text: str | None) -> np.ndarray:
    """The sorted distinct cells of a whole text's terms; none for null.

    A beginning that two words or more share is one more term: one such word
    may be chance where several are a manner of speaking.
    """
    own = set(words((text or "").lower()))
    heads = Counter(w[:n] for n in HEADS for w in own if len(w) > n)
    terms = own.union((b"\1" + h for h in heads), (b"\2" + h for h, n in heads.items() if n > 1))
    return np.unique(np.fromiter(map(crc32, terms), np.int64, len(terms)) & (CELLS - 1))


@dataclass
class Factors:
    """Weights of the cells that are used: ``place`` maps a cell to its row, or to the last one, which weighs nothing."""

    place: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logit(self, own: np.ndarray) -> float:
        """Of a document with the distinct cells ``own``: bias, weights, and the products of the factors of all pairs."""
        rows = self.place[own]
        rows = rows[rows < len(self.linear) - 1]
        v = self.factors[rows]
        return float(self.bias + self.linear[rows].sum() + 0.5 * (v.sum(0) ** 2 - (v * v).sum(0)).sum())

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(cells(text)), -50, 50))))


def _counts(sample: DataFrame) -> DataFrame:
    """(cell, n, k) of (toxic, cells): documents with a cell, and those of them with label 1; added up in tasks, then by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, k = np.zeros(CELLS, np.int64), np.zeros(CELLS, np.int64)
        for batch in batches:
            for toxic, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = np.frombuffer(own, np.uint32)
                n[at] += 1
                k[at] += toxic
        used = np.flatnonzero(n)
        for at in range(0, len(used), 1 << 16):
            some = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(k[some])], names=["cell", "n", "k"])

    ship(sample.sparkSession)
    return sample.select("toxic", "cells").mapInArrow(run, "cell long, n long, k long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))


def _paired(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which columns of ``x`` (documents by cells) have a partner with which they tell more, or less, than both one by one.

    The label's share where two cells meet is held against the sum of what
    each adds to the share of all; ``least`` are the deviations between the
    two. Pairs of which one is nearly always with the other are left out, as
    a word and its beginning.
    """
    n, both, toxic, base = x.sum(0), x.T @ x, x.T @ (x * y[:, None]), y.mean()
    share = np.divide(x.T @ y, n, out=np.full(len(n), base, np.float32), where=n > 0)
    expected = np.clip(share[:, None] + share[None] - base, 0.001, 0.999)
    off = np.abs(toxic - both * expected) / np.sqrt(both * expected * (1 - expected) + 1)
    off[both > 0.8 * np.minimum(n[:, None], n[None])] = 0
    return (off > least).any(1)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 20000, used: int = 4096, among: int = 1024, rank: int = 4, steps: int = 1600, least: float = 2.5, least_pair: float = 4.0) -> Factors:
    """A model of (doc_id, text) rows whose doc_id has ``toxic`` 0 or 1 in ``labels``.

    At most about ``train_rows`` labelled rows are learned from, a sample by a
    hash of the doc_id; tasks turn their texts to cells. Spark counts each
    cell's documents by label, and the ``used`` cells whose shares in the two
    classes differ most for their number of rows (``least`` deviations at
    least) are the model's; so are those of the ``among`` cells that vary most
    that tell something with another of them (``least_pair`` deviations), as
    a pair may say what neither does alone. Only these come to the driver, two
    bytes each: at most ``train_rows * (used + among)`` of them, however long the texts. Each gets a
    weight and ``rank`` factors, by about ``steps`` steps of AdaGrad on the
    logistic loss, and ten rounds at least; the factors weigh pairs of terms,
    which no sum of single weights can.

    Null and empty texts are documents without terms. A doc_id that stands
    twice in ``docs`` is learned from once, one with both labels once for
    each; null doc_ids and other labels not at all. Ties among cells go to the
    lower cell. Without labels all documents score next to 0, with one label
    only that label's share.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    some = hash_sample(known, F.col("doc_id"), known.count(), train_rows)
    # the sample's bound makes it small, so that no text is shuffled
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    kind = dict(docs.dtypes)["doc_id"]
    cut = lambda x: {"doc_id": x["doc_id"], "toxic": x["toxic"], "cells": [cells(t).astype(np.uint32).tobytes() for t in x["text"]]}
    every = by_row(rows, ["doc_id", "text", "toxic"], f"doc_id {kind}, toxic int, cells binary", cut)
    sample = written(every.groupBy("doc_id", "toxic").agg(F.min("cells").alias("cells")), "toxic-cells")
    total, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    base = min(0.999, max(0.001, toxic / total if total else 0.0))
    if not 0 < toxic < total:
        return Factors(np.zeros(CELLS, np.int16), float(np.log(base / (1 - base))), np.zeros(1), np.zeros((1, rank)))
    apart = F.abs(F.col("k") - F.col("n") * base) / F.sqrt(F.col("n") * (base * (1 - base)) + 1)
    found = written(_counts(sample).select("cell", apart.alias("apart"), (F.col("n") * (total - F.col("n"))).alias("varies")), "toxic-counts")
    best = [r[0] for r in found.where(F.col("apart") > least).orderBy(F.desc("apart"), "cell").limit(used).collect()]
    some = np.sort(np.array([r[0] for r in found.orderBy(F.desc("varies"), "cell").limit(among).collect()], np.int64))
    bits = by_row(sample, ["toxic", "cells"], "toxic int, bits binary", lambda x: {"toxic": x["toxic"], "bits": [np.packbits(np.isin(some, np.frombuffer(c, np.uint32))).tobytes() for c in x["cells"]]}).collect()
    there = np.unpackbits(np.frombuffer(b"".join(bytes(r[1]) for r in bits), np.uint8).reshape(len(bits), -1), axis=1)[:, : len(some)].astype(np.float32)
    paired = some[_paired(there, np.array([r[0] for r in bits], np.float32), least_pair)]
    chosen = np.union1d(np.array(best, np.int64), paired)

    def placed(x: dict) -> dict:
        found = [np.searchsorted(chosen, own[np.isin(own, chosen)]).astype(np.uint16).tobytes() for own in (np.frombuffer(c, np.uint32) for c in x["cells"])]
        return {"toxic": x["toxic"], "places": found}

    got = by_row(sample, ["toxic", "cells"], "toxic int, places binary", placed).collect()
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    place = np.full(CELLS, len(chosen), np.int16)
    place[chosen] = np.arange(len(chosen))
    return Factors(place, *learned(np.array([r[0] for r in got], np.float32), [np.frombuffer(bytes(r[1]), np.uint16) for r in got], len(chosen), rank, steps))


def learned(y: np.ndarray, each: list[np.ndarray], size: int, rank: int, steps: int, batch: int = 256) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, linear, factors) of documents with labels ``y`` and places ``each`` below ``size``; a last row of zeros behind."""
    base = float(np.clip(y.mean(), 0.001, 0.999))
    rng = np.random.default_rng(3)
    bias, linear, factors = float(np.log(base / (1 - base))), np.zeros(size, np.float32), rng.normal(0, 0.03, (size, rank)).astype(np.float32)
    # small beginnings of the factors' sums let them move while their gradients, which are products, are still small
    q, qv, qb = np.full(size, 1e-2, np.float32), np.full((size, rank), 1e-6, np.float32), 1e-2
    parts = max(1, len(each) // batch)
    for _ in range(max(10, -(-steps // parts))):
        for part in np.array_split(rng.permutation(len(each)), parts):
            x = np.zeros((len(part), size), np.float32)
            for i, d in enumerate(part):
                x[i, each[d]] = 1
            sums = x @ factors
            z = bias + x @ linear + 0.5 * ((sums * sums).sum(1) - x @ (factors * factors).sum(1))
            g = ((1 / (1 + np.exp(-np.clip(z, -50, 50))) - y[part]) / len(part)).astype(np.float32)
            gx = x.T @ g
            gl, gv, gb = gx + 2e-5 * linear, x.T @ (g[:, None] * sums) - gx[:, None] * factors + 1e-4 * factors, float(g.sum())
            q, qv, qb = q + gl * gl, qv + gv * gv, qb + gb * gb
            linear -= 0.3 * gl / np.sqrt(q)
            factors -= 0.15 * gv / np.sqrt(qv)
            bias -= 0.3 * gb / np.sqrt(qb)
    return bias, np.append(linear, 0).astype(float), np.vstack([factors, np.zeros((1, rank))]).astype(float)


def scored(docs: DataFrame, model: Factors) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text); null and empty texts have a score too."""
    kind, shared = dict(docs.dtypes)["doc_id"], docs.sparkSession.sparkContext.broadcast(model)
    return by_row(docs, ["doc_id", "text"], f"doc_id {kind}, score double", lambda x: {"doc_id": x["doc_id"], "score": [shared.value.score(t) for t in x["text"]]})
