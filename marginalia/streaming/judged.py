"""Verdicts on documents whose judgments arrive later, or earlier, than they do."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import let
from ..operators.detectors import Detector
from ..operators.readers import WEIGHT
from ..operators.scoring import document_verdict, is_directed, scale, verdict, weight_parts
from ..operators.segments import Segmenter
from ..plans.gauge import scored_segments
from ..schema import DIRECTIONS, EVIDENCE_FULL
from ..shipping import ship
from .late import keyed_state

_SEGMENT = "struct<start:int,end:int,machine:bigint,human:bigint,neutral:bigint,n:bigint>"
_EVENT = f"doc_id long, at timestamp, at_ms long, text string, segments array<{_SEGMENT}>, direction string, quote string, start int, end int, parts long"
_SUMS = f"doc_id long, version long, n_chars long, segments array<{_SEGMENT}>"


class Judged(StatefulProcessor):
    """A document's state: its text and segments' weights once it is there, and what judgments of it wait for it.

    Weights of its segments grow with each judgment, which then need not be
    kept. All is forgotten ``remember`` after the document's last event.
    """

    def __init__(self, remember_ms: int):
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.text = handle.getValueState("text", "text string, version long")
        self.until = handle.getValueState("until", "ms long")
        self.segments = handle.getMapState("segments", "seg_idx int", "start int, end int, machine long, human long, neutral long, n long")
        self.waiting = handle.getListState("waiting", "direction string, quote string, start int, end int, parts long")

    def _added(self, segments: dict[int, list], changed: set[int], text: str, direction: str, quote: str | None, start: int | None, end: int | None, parts: int) -> None:
        if quote is not None:
            start = text.find(quote)
            if start < 0:
                return
            end = start + len(quote)
        for k, s in segments.items():
            if start is None or (end is not None and s[0] <= start and end <= s[1]):
                s[2 + DIRECTIONS.index(direction)] += parts
                s[5] += 1
                changed.add(k)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        text, version = self.text.get() if self.text.exists() else (None, 0)
        segments = {k[0]: list(v) for k, v in self.segments.iterator()} if text is not None else {}
        last = old = self.until.get()[0] if self.until.exists() else None
        judgments, changed, came = [], set(), False
        for r in rows:
            end = r["at_ms"] + self.remember_ms
            last = end if last is None else max(last, end)
            if r["direction"] is not None:
                judgments.append(tuple(r[c] for c in ("direction", "quote", "start", "end", "parts")))
            elif text is None and r["text"] is not None:
                text, came = r["text"], True
                segments = {k: [s[c] for c in ("start", "end", "machine", "human", "neutral", "n")] for k, s in enumerate(r["segments"])}
                changed |= set(segments)
        if text is None:
            self.waiting.appendList(judgments) if judgments else None
        else:
            if came and self.waiting.exists():
                judgments = [*self.waiting.get(), *judgments]
                self.waiting.clear()
            for j in judgments:
                self._added(segments, changed, text, *j)
            for k in changed:
                self.segments.updateValue((k,), tuple(segments[k]))
            version += 1
            self.text.update((text, version))
        if last != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(last)
            self.until.update((last,))
        if came or changed:
            names = ("start", "end", *DIRECTIONS, "n")
            yield Row(doc_id=key[0], version=version, n_chars=len(text), segments=[Row(**dict(zip(names, segments[k]))) for k in sorted(segments)])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        for state in (self.text, self.until, self.segments, self.waiting):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def judged_verdicts(docs: DataFrame, judgments: DataFrame, segmenter: str | Segmenter = "paragraph", detectors: Sequence[str | Detector] | None = None, remember: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """A stream of (doc_id, version, n_chars, n_segments, n_signals, lean, strength, label) from streams of documents (doc_id, text, at) and of one reader's judgments (with at).

    A document is detected once, as it comes, by the plan of a batch; a
    judgment adds to the segments that hold it whole. Each trigger tells the
    new verdicts; a document's highest version is what a batch with all of
    its judgments as evidence says, in whatever order they came within
    ``delay``. Judgments wait for their document as long as it is remembered;
    a document that comes again is the first one. Null texts and judgments
    without a direction say nothing.
    """
    spark = docs.sparkSession
    keyed_state(spark)
    ship(spark)
    ms = spark.sql(f"SELECT CAST(unix_millis(timestamp'1970-01-01 00:00:00+00' + INTERVAL {remember}) AS LONG)").first()[0]
    when = [F.col("at"), F.unix_millis("at").alias("at_ms")]
    sums = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), *(s[d].alias(d) for d in DIRECTIONS), F.size(s["signals"]).cast("long").alias("n"))
    none = lambda *cs: [F.lit(None).cast(k).alias(c) for c, k in cs]
    texts = scored_segments(docs.where("text is not null"), segmenter, detectors, ("at", "text"))
    texts = texts.select("doc_id", *when, "text", F.transform("segments", sums).cast(f"array<{_SEGMENT}>").alias("segments"), *none(("direction", "string"), ("quote", "string"), ("start", "int"), ("end", "int"), ("parts", "long")))
    said = judgments.where(F.col("direction").isin(*DIRECTIONS)).select("doc_id", *when, *none(("text", "string"), ("segments", f"array<{_SEGMENT}>")), "direction", "quote", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), weight_parts(F.coalesce("weight", F.lit(WEIGHT))).alias("parts"))
    events = texts.unionByName(said).where("doc_id is not null and at is not null").withWatermark("at", delay)
    rows = events.groupBy("doc_id").transformWithState(Judged(ms), _SUMS, "append", "EventTime")
    scored = F.transform("segments", lambda s: F.struct(*(s[c].alias(c) for c in (*DIRECTIONS, "n")), verdict(s["machine"], s["human"], s["neutral"], F.lit(EVIDENCE_FULL) * scale(s["end"] - s["start"]))["label"].alias("label")))
    added = lambda of: F.aggregate("scored", F.lit(0).cast("long"), lambda n, s: n + of(s))
    whole = F.struct(F.size("scored").cast("long").alias("n_segments"), added(lambda s: is_directed(s["label"]).cast("long")).alias("directed"), *(added(lambda s, d=d: s[d]).alias(d) for d in DIRECTIONS))
    out = rows.withColumn("scored", scored).withColumn("v", let(whole, lambda x: document_verdict(x, F.col("n_chars"))))
    return out.select("doc_id", "version", "n_chars", F.size("scored").cast("long").alias("n_segments"), added(lambda s: s["n"]).alias("n_signals"), "v.lean", "v.strength", "v.label")


def newest(rows: DataFrame) -> DataFrame:
    """The highest version of each document's verdict."""
    fields = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.max_by(F.struct(*fields), "version").alias("r")).select("doc_id", "r.*")
