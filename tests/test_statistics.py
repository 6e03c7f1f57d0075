"""Standings in a document, and the counted models behind them, by brute force."""

from __future__ import annotations

import math
import pathlib
import random
import statistics
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia import storage
from marginalia.operators import counted, outliers
from marginalia.plans import gauge as plan

SEGMENTS = "doc_id long, seg_idx int, start int, end int"


def plain_standings(spans, tokens, kind, sign):
    """Every window of a span's width is compared anew, as the definition says."""
    out = []
    for k, (start, end) in enumerate(spans):
        met = [i for i, (_, _, s, e) in enumerate(tokens) if s < end and e > start and e > s] if end > start else []
        lo, hi = (met[0], met[-1] + 1) if met else (0, 0)
        w = hi - lo
        if w < outliers.MIN_TOKENS:
            continue

        def score(i, j):
            a, b = sum(t[0] for t in tokens[i:j]), sum(t[1] for t in tokens[i:j])
            return (a / b**0.5 if b > 0 else 0.0) if kind == "curvature" else (a / b if b else 0.0)

        others = [score(i, i + w) for i in range(0, len(tokens) - w + 1, max(1, w // 2)) if i + w <= lo or i >= hi]
        if len(others) < outliers.MIN_WINDOWS:
            continue
        m = statistics.median(others)
        scale = 1.4826 * statistics.median([abs(x - m) for x in others])
        out.append((k, w, len(others), score(lo, hi), sign * ((score(lo, hi) - m) / scale if scale > 0 else 0.0)))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_standings_by_brute_force(seed):
    r = random.Random(seed)
    n, at, tokens = r.choice([0, 10, 150, 400]), 0, []
    for _ in range(n):
        size = r.choice([0, 1, 3, 7])
        # whole numbers: sums are exact, and many windows are alike
        tokens.append((float(r.randint(-3, 3)), float(r.choice([0, 1, 4])), at, at + size))
        at += size + r.choice([0, 1]) if seed % 5 else r.choice([0, 1, size])
    spans = [(x, x + r.choice([0, 5, 60, 61, 100])) for x in (r.randint(-2, max(at, 1)) for _ in range(25))]
    kind, sign = r.choice([("curvature", 1.0), ("ratio", -1.0)])
    x = [np.array(c, float if k < 2 else int) for k, c in enumerate(zip(*tokens))] or [np.zeros(0)] * 2 + [np.zeros(0, int)] * 2
    s, e = (np.array(c, int) for c in zip(*spans))
    got = sorted(outliers.document_standings(s, e, *x, kind, sign))
    want = plain_standings(spans, tokens, kind, sign)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3:] == pytest.approx(w[3:], abs=1e-9) for g, w in zip(got, want))


def test_a_document_of_a_million_tokens():
    rng = np.random.default_rng(1)
    n = 1_000_000
    first = np.cumsum(rng.integers(2, 9, n))
    last = first + rng.integers(1, 3, n)
    cuts = np.cumsum(rng.integers(16, 60, n // 40))
    cuts = cuts[cuts < n]
    start, end = first[cuts[:-1]], last[cuts[1:] - 1]
    began = time.process_time()
    rows = list(outliers.document_standings(start, end, rng.normal(size=n), rng.random(n) + 0.1, first, last, "curvature", 1.0))
    assert len(rows) == len(start) > 20_000 and time.process_time() - began < 60
    assert abs(statistics.fmean(r[4] for r in rows)) < 0.2


def test_standings_of_rows_with_nulls_and_of_none(spark):
    stats = spark.createDataFrame([(1, k, 4 * k, 4 * k + 3, None if k % 9 == 0 else float(k % 7), 1.0) for k in range(300)] + [(None, 0, 0, 1, 1.0, 1.0)], "doc_id long, tok_idx int, start int, end int, a double, b double")
    segs = spark.createDataFrame([(1, 0, 0, 80), (1, 1, 400, 480), (2, 0, 0, 80), (None, 0, 0, 80)], SEGMENTS)
    rows = outliers.standings(segs, stats, "ratio", -1.0).collect()
    assert sorted((r["doc_id"], r["seg_idx"], r["n_tokens"]) for r in rows) == [(1, 0, 20), (1, 1, 20)]
    assert outliers.standings(segs, stats.where("false"), "ratio", -1.0).collect() == outliers.standings(segs.where("false"), stats, "ratio", -1.0).collect() == []


TEXTS = ["the cat sat on the mat. the cat ran.", "the dog sat on the cat", "a cat a cat a cat", "", None, "on the mat the dog ran"]


class Plain:
    """The same model with whole distributions over the vocabulary and one unknown word."""

    def __init__(self, texts):
        import re

        self.lines = [re.findall(r"[^\W_]+|[^\w\s]", t) for t in texts if t]
        self.n = [Counter(), defaultdict(Counter), defaultdict(Counter)]
        for line in self.lines:
            for k, w in enumerate(line):
                c1, c2 = ([""] * 2 + line)[k : k + 2]
                self.n[0][w] += 1
                self.n[1][c2][w] += 1
                self.n[2][c1, c2][w] += 1
        self.words = [*self.n[0], None]

    def p(self, w, c2=None, c1=None):
        if c2 is None:
            return (self.n[0][w] + 1) / (sum(self.n[0].values()) + len(self.n[0]) + 1)
        seen, lower = (self.n[1][c2], self.p(w)) if c1 is None else (self.n[2][c1, c2], self.p(w, c2))
        total, kinds = sum(seen.values()), len(seen)
        return (seen[w] + kinds * lower) / (total + kinds) if kinds else lower

    def at(self, c1, c2, w):
        """(ll, mean, var, cross) at a place."""
        ps = [self.p(x, c2, c1) for x in self.words]
        assert sum(ps) == pytest.approx(1)
        mean = sum(p * math.log(p) for p in ps)
        cross = -sum(self.p(x, c2) * math.log(p) for x, p in zip(self.words, ps))
        return math.log(self.p(w if w in self.n[0] else None, c2, c1)), mean, sum(p * math.log(p) ** 2 for p in ps) - mean**2, cross


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").select("*", *(F.lit("own").alias(c) for c in ("w", "n", "p", "c1")))


@pytest.fixture(scope="module")
def model(docs):
    return counted.counted(docs)


def test_counted_model_by_whole_distributions(model):
    plain = Plain(TEXTS)
    rows = model.grams.collect()
    assert len(rows) == sum(len(c) for c in plain.n[2].values())
    for r in rows:
        assert tuple(r)[3:] == pytest.approx(plain.at(r["c1"], r["c2"], r["w"]), abs=1e-9)


def _tables(spark):
    top = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    return {p.name for p in top.iterdir()}


def test_a_model_leaves_no_table_that_nothing_reads(spark, docs):
    for once, left in ((True, {"triples", "singles", "contexts", "pairs"}), (False, {"grams", "singles", "contexts", "pairs"})):
        before = _tables(spark)
        m = counted.counted(docs, once=once)
        assert {n.rsplit("-", 1)[0] for n in _tables(spark) - before} == left
        # counts and pairs meet by pair, then all else is done where a context's words are
        plan = m.grams._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == once and plan.count("Window") == 2 * once
    sorts = lambda m: sorted(map(tuple, m.grams.collect()))
    assert all(a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], abs=1e-12) for a, b in zip(sorts(counted.counted(docs, once=True)), sorts(m), strict=True))


def test_kept_tables_leave_no_shuffle_files(spark):
    local = pathlib.Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    rows = spark.range(0, 20000, 1, 8).groupBy((F.col("id") % 997).alias("k")).agg(F.count("*").alias("n"))
    before = {p.name for p in local.rglob("shuffle_*.data")}
    table = storage.kept(rows, "rows")
    assert not [p for p in local.rglob("shuffle_*.data") if p.name not in before]
    assert table.count() == 997
    assert spark.conf.get(storage.CLEANS) == "false"


def test_unseen_words_and_contexts(spark, model):
    plain = Plain(TEXTS)
    asked = [("sat", "on", "a"), ("on", "dog", "ran"), ("x", "y", "the"), ("x", "cat", "zebra"), ("the", "cat", "zebra"), ("x", "y", "zebra"), ("the", "cat", "sat")]
    got = {tuple(r)[:3]: tuple(r)[3:] for r in counted.looked_up(spark.createDataFrame(asked, "c1 string, c2 string, w string"), model).collect()}
    for a in asked:
        assert got[a] == pytest.approx(plain.at(*a), abs=1e-9), a


def test_statistics_of_counted_and_of_other_documents(spark, docs, model):
    plain = Plain(TEXTS)
    for among in (True, False):
        rows = counted.curvature(docs, model, among).orderBy("doc_id", "tok_idx").collect()
        assert len(rows) == sum(len(x) for x in plain.lines)
        r = next(r for r in rows if (r["doc_id"], r["tok_idx"]) == (1, 2))
        ll, mean, var, cross = plain.at("the", "dog", "sat")
        assert (r["start"], r["end"], r["a"], r["b"]) == pytest.approx((8, 11, ll - mean, var))
        assert all((r["a"], r["b"]) == (0, 0) for r in rows if r["tok_idx"] == 0)
        r = next(r for r in counted.cross_perplexity(docs, model.observer(), model, among).collect() if (r["doc_id"], r["tok_idx"]) == (1, 2))
        assert (r["a"], r["b"]) == pytest.approx((-ll, cross))
    other = spark.createDataFrame([(7, "the zebra sat")], "doc_id long, text string")
    assert counted.curvature(other, model).count() == 3
    assert counted.curvature(other.where("false"), model).count() == 0 and counted.counted(other.where("false")).grams.count() == 0


def test_models_that_do_not_belong_together(spark, model):
    other = counted.counted(spark.createDataFrame([(1, "other words")], "doc_id long, text string"))
    with pytest.raises(ValueError, match="vocabularies"):
        counted.cross_perplexity(spark.createDataFrame([], "doc_id long, text string"), other.observer(), model)
    with pytest.raises(ValueError, match="observer"):
        counted.cross_perplexity(spark.createDataFrame([], "doc_id long, text string"), model, model)


def test_detectors_by_statistics_are_names_like_others(spark):
    r = random.Random(4)
    plain = " ".join(f"{r.choice(['red', 'blue', 'old', 'new'])} {r.choice(['dogs', 'cats', 'birds', 'fish'])} {r.choice(['eat', 'see', 'like'])} {r.choice(['grass', 'rain', 'snow', 'stones', 'trees'])}{r.choice(['.', ','])}" for _ in range(200))
    text = plain + "\n\n" + "one two three four five six seven " * 8 + "\n\n" + plain[::-1]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    segs = plan.gauge(docs, "paragraph", ["tells", "fast-detect-gpt", "binoculars"]).collect()
    found = {s["detector"] for g in segs for s in g["signals"]}
    assert {"fast-detect-gpt", "binoculars"} & found
    (report,) = plan.reports(docs, "paragraph", ["binoculars"]).collect()
    assert report["detectors"] == "binoculars" and report["n_signals"] == sum(len(s["signals"]) for s in report["segments"]) > 0
    (verdict,) = plan.verdicts(docs, "paragraph", ["binoculars", "rhythm"]).collect()
    assert verdict["detectors"] == "binoculars,rhythm"
    with pytest.raises(KeyError):
        plan.verdicts(docs, "paragraph", ["nobody"])
    with pytest.raises(ValueError, match="all documents"):
        plan.gauge(spark.readStream.format("rate").load().select(F.col("value").alias("doc_id"), F.lit("").alias("text")), "paragraph", ["binoculars"])
