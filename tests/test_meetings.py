"""Judgments, texts, units and segments that meet without products and with one copy of a text."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marginalia.functions.text import first_where
from marginalia.operators import readers
from marginalia.plans import gauge as plan
from marginalia.schema import JUDGMENT

JUDGMENTS = "doc_id long, reader string, " + JUDGMENT.removeprefix("struct<").removesuffix(">").replace(":", " ")


def judgment(doc, reader, quote=None, start=None, end=None, direction="machine"):
    return (doc, reader, direction, quote, start, end, None, None, None, None, None)


def test_halving(spark):
    rows = [(n, k) for n in range(9) for k in range(n + 1)]
    d = spark.createDataFrame(rows, "n int, k int").select("n", "k", first_where(F.col("n"), lambda i: i >= F.col("k")).alias("got"))
    assert all(r["got"] == r["k"] for r in d.collect())


def test_ten_thousand_judgments_of_one_document_share_a_few_copies_of_its_text(spark):
    r = random.Random(1)
    words = [f"{r.choice('abcdefgh')}{k:05d}" for k in range(3000)]
    text = " ".join(words)
    said = [judgment(1, f"r{k % 7}", r.choice(words[:-5]) if k % 10 else "nowhere") for k in range(10_000)] + [judgment(2, "a", "x"), judgment(3, "a", "z"), judgment(9, "a", "lost")]
    docs = spark.createDataFrame([(1, text), (2, "a x b x"), (3, None)], "doc_id long, text string")
    judgments = spark.createDataFrame(said, JUDGMENTS)
    parts = readers.together(judgments).select("doc_id", "part", F.size("own").alias("n")).collect()
    assert sum(p["n"] for p in parts) == len(said) and max(p["n"] for p in parts) < 2 * readers.TOGETHER
    assert sum(p["doc_id"] == 1 for p in parts) <= 5 and sum(p["doc_id"] == 2 for p in parts) == 1
    got = readers.anchored(docs, judgments).collect()
    assert len(got) == 10_002
    for g in got:
        if g["doc_id"] == 1:
            at = text.find(g["quote"])
            assert (g["start"], g["end"], g["dropped"]) == ((at, at + 6, False) if at >= 0 else (None, None, True))
    assert next((g["start"], g["end"]) for g in got if g["doc_id"] == 2) == (2, 3)


@pytest.mark.parametrize("segmenter", ["sentence", "paragraph"])
def test_units_by_halving_are_those_that_overlap(spark, segmenter):
    r = random.Random(3)
    text = "".join(r.choice(["One two. ", "Three!\n\n", "four five? ", "six\n", "\n\n \n", "Seven. "]) for _ in range(60))
    places = [judgment(1, "a", None, a, a + r.randint(-1, 90)) for a in (r.randint(-3, len(text) + 3) for _ in range(150))] + [judgment(1, "b", None, None, 5), judgment(1, "b", None, 5, None), judgment(1, "b", "")]
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    own = spark.createDataFrame([(*j[:2], j[2], j[3], j[4], j[5], f"n{k}", *j[7:]) for k, j in enumerate(places)], JUDGMENTS)
    units = plan.gauge(docs, segmenter, ["tells"]).select("seg_idx", "start", "end").collect()
    got = {g["name"]: [u["unit"] for u in g["units"]] for g in readers.judged_units(docs, own, segmenter).collect()}
    for k, j in enumerate(places):
        a, b = (0, 0) if j[3] == "" else (j[4], j[5])
        assert got[f"n{k}"] == ([] if a is None or b is None else [u["seg_idx"] for u in units if u["start"] < b and u["end"] > a]), (k, a, b)


def test_evidence_meets_segments_in_cells(spark):
    r = random.Random(5)
    text = " ".join("word" + str(k % 17) + ("." if k % 9 == 0 else "") + ("\n\n" if k % 31 == 0 else "") for k in range(1500))
    docs = spark.createDataFrame([(1, text), (2, "short.")], "doc_id long, text string")
    places = [(a, a + r.choice([0, 3, 40, 700, 2000])) for a in (r.randint(0, len(text)) for _ in range(300))]
    extra = spark.createDataFrame([(1, f"s{k}", "human", 0.1, "own", None, "", a, b) for k, (a, b) in enumerate(places)] + [(1, "all", "human", 0.1, "own", None, "", None, None)], "doc_id long, name string, direction string, weight double, detector string, value string, note string, start int, end int")
    for segmenter in ("sentence", "document"):
        segs = plan.inject(plan.detected(docs, segmenter, []), extra).collect()
        for s in segs:
            want = [] if s["doc_id"] == 2 else ["all", *(f"s{k}" for k, (a, b) in enumerate(places) if s["start"] <= a and b <= s["end"])]
            assert sorted(x["name"] for x in s["signals"]) == sorted(want)
