"""What the learned operators compute, against plain versions and planted cases."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
import pytest

from marginalia.llm import queries, quality, toxicity

SF = "/root/testdata/sf0.001"


def _auc(y, z):
    y, z = np.array(y), np.array(z)
    wins = sum((z[y == 0] < a).sum() + 0.5 * (z[y == 0] == a).sum() for a in z[y == 1])
    return wins / ((y == 1).sum() * (y == 0).sum())


def _planted(n, rng):
    """Documents that are toxic if an insult meets a group; two insults or two groups are not, so no sum of weights tells them apart."""
    filler, insults, groups = [f"wo{c}rd{d}" for c in "abcdef" for d in "ghijkl"], [f"in{c}sult" for c in "pqrstu"], [f"{c}group" for c in "uvwxyz"]
    rows = []
    for k in range(n):
        kind = rng.choice(["none", "pair", "pair", "insults", "groups"])
        said = {"none": [], "pair": [rng.choice(insults), rng.choice(groups)], "insults": rng.sample(insults, 2), "groups": rng.sample(groups, 2)}[kind]
        own = [rng.choice(filler) for _ in range(12)] + said
        rng.shuffle(own)
        rows.append((k, " ".join(own), int(kind == "pair")))
    return rows


def test_factors_find_pairs_that_weights_miss(spark):
    rng = random.Random(8)
    learn, held = _planted(3000, rng), _planted(400, rng)
    docs, labels = spark.createDataFrame([r[:2] for r in learn], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in learn], "doc_id long, toxic int")
    y = [r[2] for r in held]
    with_factors, alone = (toxicity.fit(docs, labels, rank=rank) for rank in (4, 0))
    assert _auc(y, [with_factors.score(r[1]) for r in held]) > 0.95
    assert _auc(y, [alone.score(r[1]) for r in held]) < 0.85


def test_toxicity_is_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    text = "one two three fourteen fifteen one"
    own = toxicity.cells(text).tolist()
    place = np.full(toxicity.CELLS, len(own) - 2, np.int16)
    place[own[:-2]] = np.arange(len(own) - 2)  # two cells are not used
    model = toxicity.Factors(place, -0.3, np.append(rng.normal(0, 1, len(own) - 2), 0), np.vstack([rng.normal(0, 0.5, (len(own) - 2, 3)), np.zeros((1, 3))]))
    z = -0.3 + sum(model.linear[:-1])
    z += sum(float(model.factors[i] @ model.factors[j]) for i in range(len(own) - 2) for j in range(i))
    assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z)))
    assert model.score(None) == model.score("") == pytest.approx(1 / (1 + math.exp(0.3)))


@pytest.mark.parametrize(("query", "module", "label", "folds", "fold"), [("op1_quality", quality, "quality", 5, 0), ("op2_toxicity", toxicity, "toxic", 4, 2)])
def test_scores_of_the_queries_row_by_row(spark, query, module, label, folds, fold):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = {i: zlib.crc32(str(i).encode()) % folds == fold for i in (r["doc_id"] for r in docs.select("doc_id").collect())}
    model = module.fit(docs, spark.createDataFrame([r for r in labels.collect() if not out[r["doc_id"]]], labels.schema))
    got = {r["doc_id"]: r for r in queries.queries()[query](spark, SF).collect()}
    assert got.keys() == out.keys()
    for r in docs.collect():
        want = model.score(r["text"])
        mine = got[r["doc_id"]]
        assert mine["score"] == pytest.approx(want) and mine["held_out"] == out[r["doc_id"]] and mine["predicted"] == int(mine["score"] >= 0.3)
    if query == "op1_quality":
        below = sorted(r["score"] for r in got.values() if not r["above_cut"])
        assert abs(len(below) / len(got) - model.low_share) < 0.02
        assert all(r["score"] > below[-1] for r in got.values() if r["above_cut"]) if below else True


def test_samples_are_bounded_by_ids(spark):
    """Rows that repeat a doc_id, labels of both kinds, null ids, and no labels at all."""
    docs = spark.createDataFrame([(k % 40, f"text {'bad' if k % 2 else 'good'} {k % 7}") for k in range(400)] + [(None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)] + [(3, 0, 0), (None, 1, 1), (4, None, 7)], "doc_id long, quality int, toxic int")
    assert 0 < toxicity.fit(docs, labels, least=0.5).score("bad") < 1 and 0 < quality.fit(docs, labels).score("good") < 1
    none = labels.where("false")
    assert toxicity.fit(docs, none).score("bad") < 0.01 and quality.fit(docs, none).score("good") == pytest.approx(0.5)
    assert toxicity.fit(docs, labels.where("toxic = 1")).score("bad") > 0.99
