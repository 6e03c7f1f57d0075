"""Results that come late: of each text only the last that was asked for, and only while the text is still the same."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..shipping import ship

#: What a text says now (kind ``text``), and what a reading of a text came to (kind ``result``); each is numbered as it is asked for.
EVENTS = "doc_id long, kind string, ticket long, text_sha256 string, at timestamp, report string"
#: A result to show: that of ``ticket`` for the text of ``text_ticket``.
SHOWN = "doc_id long, text_ticket long, text_sha256 string, ticket long, report string"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Latest(StatefulProcessor):
    """A document's state: the text it has now, and the last result of each text that has been heard of.

    A result of a text that isn't the present one is held: the text may be
    told later, or come back. A ticket that is not above the one held is
    stale and goes, in whatever trigger or window it comes. All is forgotten
    ``remember`` after the document's last event, by an event-time timer;
    older events than that are late for Spark's watermark too, so nothing
    stale can come back afterwards.
    """

    def __init__(self, remember_ms: int):
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "ticket long, text_sha256 string")
        self.until = handle.getValueState("until", "ms long")
        self.held = handle.getMapState("held", "text_sha256 string", "ticket long, report string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        text = self.now.get() if self.now.exists() else (-1, None)
        until = self.until.get()[0] if self.until.exists() else None
        last, changed = until, False
        for r in rows:
            digest = (r["text_sha256"] or "",)
            end = r["at_ms"] + self.remember_ms
            last = end if last is None else max(last, end)
            if r["kind"] == "text":
                if r["ticket"] > text[0]:
                    changed = changed or digest[0] != text[1]
                    text = (r["ticket"], digest[0])
            elif not self.held.containsKey(digest) or self.held.getValue(digest)[0] < r["ticket"]:
                self.held.updateValue(digest, (r["ticket"], r["report"]))
                changed = changed or digest[0] == text[1]
        if text[1] is not None:
            self.now.update(text)
        if last != until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(last)
            self.until.update((last,))
        if changed and text[1] is not None and self.held.containsKey((text[1],)):
            ticket, report = self.held.getValue((text[1],))
            yield Row(doc_id=key[0], text_ticket=text[0], text_sha256=text[1], ticket=ticket, report=report)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        for state in (self.now, self.until, self.held):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def keyed_state(spark: SparkSession) -> None:
    """State in RocksDB, which keyed state of several kinds needs, unless the session has a provider of its own."""
    if not spark.conf.get(_PROVIDER, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(_PROVIDER, _ROCKS)


def latest(events: DataFrame, remember: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """A stream of ``SHOWN`` from a stream of ``EVENTS``: each time a document's present text has a newer result, or another text that has one.

    Tickets of texts and of results count on their own, both upwards. A row
    without a doc_id, ticket or time belongs to nothing and is left out. Of a
    document's rows that come in one trigger, the last state is shown. The
    last row of a document, by text_ticket and ticket, is what
    ``operators.edits.current`` says of all events, in whatever order and
    triggers they came, if none came later than ``delay`` behind the newest.
    The state of a document is its texts of the time it is remembered, a
    number and a report each.
    """
    keyed_state(events.sparkSession)
    ship(events.sparkSession)
    ms = events.sparkSession.sql(f"SELECT CAST(unix_millis(timestamp'1970-01-01 00:00:00+00' + INTERVAL {remember}) AS LONG)").first()[0]
    own = events.where("doc_id IS NOT NULL AND ticket IS NOT NULL AND at IS NOT NULL").select("doc_id", "kind", "ticket", "text_sha256", "at", "report", F.unix_millis("at").alias("at_ms"))
    return own.withWatermark("at", delay).groupBy("doc_id").transformWithState(Latest(ms), SHOWN, "append", "EventTime")


def shown(rows: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, ticket, report): the last of ``latest`` rows of each document."""
    last = F.max_by(F.struct("text_sha256", "ticket", "report"), F.struct("text_ticket", "ticket"))
    return rows.groupBy("doc_id").agg(last.alias("r")).select("doc_id", "r.*")
