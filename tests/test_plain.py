"""Plain Python detectors, segmenters and aggregates through the engine."""

from __future__ import annotations

import json
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from marginalia.operators.plain import PlainAggregate, PlainDetector, PlainSegmenter, Signal, Span
from marginalia.plans import gauge as plan
from marginalia.streaming import readings

# workers can't import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])
TEXT = "Delve in 😀 here; see 12 and 345.\n\nNothing at all.\n\nSee 6 — done"


def numbers(text, span):
    for m in re.finditer(r"\d+", text[span.start : span.end]):
        at = span.start + m.start()
        yield Signal("number", "human", 0.25, "numbers", value={"n": int(m[0]), "é": None}, note="a number", span=Span.of(text, at, at + len(m[0]), level="token"))


def around(text, span):
    assert span.quote == text[span.start : span.end] and span.prefix == text[max(0, span.start - 40) : span.start] and span.length == len(span.quote)
    yield {"name": "around", "direction": "neutral", "weight": 0, "detector": None}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (1, TEXT)], "doc_id long, text string").select("*", *(F.lit("own").alias(c) for c in ("plain", "spans_", "plain_", "signals", "seg_idx")))


def test_detectors_of_both_kinds_in_one_plan(docs):
    chosen = [PlainDetector(numbers), "tells", PlainDetector(around, "near"), "forensic"]
    segs = plan.detected(docs.where("doc_id = 1").limit(1), "paragraph", chosen)
    rows = plan.signals(segs).collect()
    got = [(r["seg_idx"], r["name"], r["detector"], r["start"], r["end"], r["matched"]) for r in rows]
    assert got == sorted(got, key=lambda x: (x[0], x[3] if x[3] is not None else {0: 0, 1: 35, 2: 52}[x[0]], x[1]))
    found = [TEXT.index(x) for x in ("12", "345", "6")]
    assert [(x[3], x[5]) for x in got if x[1] == "number"] == list(zip(found, ("12", "345", "6")))
    assert [(x[0], x[2], x[3]) for x in got if x[1] == "around"] == [(k, "near", None) for k in range(3)]
    assert {"ai-vocabulary", "em-dash"} <= {x[1] for x in got}
    (value,) = {r["value"] for r in rows if r["matched"] == "12"}
    assert json.loads(value) == {"n": 12, "é": None}
    assert segs._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_verdicts_and_reports_by_plain_detectors(docs):
    chosen = ["tells", PlainDetector(numbers)]
    verdicts = {r["doc_id"]: r for r in plan.verdicts(docs, "paragraph", chosen).collect()}
    segs = plan.gauge(docs, "paragraph", chosen).where("doc_id = 1").collect()
    assert verdicts[1]["detectors"] == "tells,numbers" and verdicts[1]["n_signals"] * 2 == sum(s["n_signals"] for s in segs) and verdicts[2]["n_signals"] == verdicts[3]["n_signals"] == 0
    report = next(r for r in plan.reports(docs, "paragraph", chosen).collect() if r["doc_id"] == 1)
    assert [len(s["signals"]) for s in report["segments"]] == [s["n_signals"] for s in segs[: len(report["segments"])]]


def test_segmenter_and_aggregate(docs):
    class Part:
        def __init__(self, start, end, level):
            self.start, self.end, self.level = start, end, level

    halves = PlainSegmenter(lambda text: [Part(0, len(text) // 2, "half"), (len(text) // 2, len(text))] if text else [])
    score = PlainAggregate(lambda signals, n_chars: (-1.0, min(1.0, len(signals) / n_chars * 10), "leans-human" if any(isinstance(s.span, Span) for s in signals) else "no-evidence"), "mine")
    rows = plan.gauge(docs, halves, [PlainDetector(numbers)], score).collect()
    n = len(TEXT)
    assert sorted({(r["start"], r["end"], r["quote"], r["level"], r["n_signals"], r["label"]) for r in rows}) == [(0, n // 2, TEXT[: n // 2], "half", 2, "leans-human"), (n // 2, n, TEXT[n // 2 :], "segment", 1, "leans-human")]
    verdict = next(r for r in plan.verdicts(docs, halves, [PlainDetector(numbers)], score).collect() if r["doc_id"] == 3)
    assert (verdict["segmenter"], verdict["calibration"], verdict["n_segments"]) == ("custom", "uncalibrated (mine)", 0)


@pytest.mark.parametrize("bad", [
    {"name": "x", "direction": "machine", "weight": 0.5, "start": 5, "end": 99},
    {"name": "x", "direction": "machine", "weight": 0.5, "start": -1, "end": 2},
    {"name": "x", "direction": "machine", "weight": 0.5, "start": 4, "end": 2},
    {"name": "x", "direction": "machine", "weight": 0.5, "start": 4},
    {"name": "x", "direction": "robot", "weight": 0.5},
    {"name": "x", "direction": "machine", "weight": 1.5},
    {"name": "x", "direction": "machine", "weight": None},
])
def test_what_is_no_signal_is_refused(docs, bad):
    with pytest.raises(Exception, match="whoever"):
        plan.gauge(docs, "document", [PlainDetector(lambda text, span: [bad] if text == TEXT else [], "whoever")]).collect()


def test_what_is_no_span_is_refused(docs):
    with pytest.raises(Exception, match="segmenter"):
        plan.gauge(docs, PlainSegmenter(lambda text: [(0, len(text) + 1)]), ["tells"]).collect()


def test_plain_functions_in_a_stream(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/in")
    stream = readings.segment_stream(readings.document_stream(spark, f"{tmp_path}/in"), "paragraph", [PlainDetector(numbers), "tells"]).select("doc_id", "seg_idx", "n_signals", "label")
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination(120)
    batch = plan.gauge(docs, "paragraph", [PlainDetector(numbers), "tells"]).select("doc_id", "seg_idx", "n_signals", "label")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, batch.collect()))
