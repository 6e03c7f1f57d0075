"""Detectors, segmenters and aggregates that are plain Python functions, run on Arrow batches beside the column expressions.

Workers must be able to import what such a function uses: Spark's addPyFile brings them modules of one's own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..schema import CONTEXT, DIRECTIONS, SIGNALS
from ..shipping import ship


@dataclass(frozen=True)
class Span:
    """A stretch of a text in code points, with what stands around it."""

    start: int
    end: int
    quote: str
    prefix: str = ""
    suffix: str = ""
    level: str = "segment"

    @classmethod
    def of(cls, text: str, start: int, end: int, level: str = "segment") -> Span:
        return cls(start, end, text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT], level)

    @property
    def length(self) -> int:
        return self.end - self.start

    def contains(self, other: Span) -> bool:
        return self.start <= other.start and other.end <= self.end


@dataclass(frozen=True)
class Signal:
    """A piece of evidence; without a span it is about its whole segment."""

    name: str
    direction: str
    weight: float
    detector: str
    value: Any = None
    note: str = ""
    span: Span | None = None


class PlainDetector:
    """A function of a text and one of its spans that yields signals (objects or dictionaries with the fields of ``Signal``)."""

    def __init__(self, function: Callable[[str, Span], Iterable[Any]], name: str | None = None):
        self.function, self.__name__ = function, name or getattr(function, "__name__", "custom")


class PlainSegmenter:
    """A function of a text that yields spans: objects with start, end and level, or pairs of places."""

    def __init__(self, function: Callable[[str], Iterable[Any]]):
        self.function = function


class PlainAggregate:
    """A function of a segment's signals and ``n_chars=`` that returns (lean, strength, label)."""

    def __init__(self, function: Callable[..., tuple[float, float, str]], name: str | None = None):
        self.function, self.__name__ = function, name or getattr(function, "__name__", "custom")


def _field(x: Any, name: str, default: Any = None) -> Any:
    return x.get(name, default) if isinstance(x, dict) else getattr(x, name, default)


def checked(start: Any, end: Any, text: str, whose: str) -> tuple[int, int]:
    """A stretch of the text, or an error that says whose it is."""
    if not (isinstance(start, int) and isinstance(end, int) and 0 <= start <= end <= len(text)):
        raise ValueError(f"{whose}: [{start!r}, {end!r}) is no stretch of a text of {len(text)} code points")
    return start, end


def signal_row(x: Any, d: int, text: str, span: Span, whose: str) -> dict:
    """A signal as a row of the engine's, checked."""
    direction, weight, where, value = _field(x, "direction"), _field(x, "weight"), _field(x, "span"), _field(x, "value")
    if direction not in DIRECTIONS:
        raise ValueError(f"{whose}: the direction must be one of {DIRECTIONS}, not {direction!r}")
    if isinstance(weight, bool) or not isinstance(weight, (int, float)) or not 0 <= weight <= 1:
        raise ValueError(f"{whose}: the weight must be in [0, 1], not {weight!r}")
    start, end = (_field(where, "start"), _field(where, "end")) if where is not None else (_field(x, "start"), _field(x, "end"))
    placed = start is not None
    if placed:
        start, end = checked(start, end, text, whose)
    return {
        "at": start if placed else span.start, "name": str(_field(x, "name") or whose), "d": d, "longer": 0, "ord": 0, "direction": direction, "weight": float(weight), "detector": str(_field(x, "detector") or whose),
        "value": None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str), "note": str(_field(x, "note") or ""), "start": start if placed else None, "end": end if placed else None,
        "matched": text[start:end] if placed else None, "level": (_field(where, "level") or "token") if placed else None,
    }


def span_rows(spans: Iterable[Any], text: str) -> Iterator[dict]:
    """A segmenter's spans, checked, in the order it yields them."""
    for x in spans:
        start, end = x if isinstance(x, tuple) and len(x) == 2 else (_field(x, "start"), _field(x, "end"))
        start, end = checked(start, end, text, "segmenter")
        yield {"start": start, "end": end, "level": str(_field(x, "level", "segment") if not isinstance(x, tuple) else "segment")}


def _arrow(spark_type: str) -> pa.DataType:
    """The Arrow type of a function's result; workers get the package to run it with."""
    ship(SparkSession.active())
    return to_arrow_type(_parse_datatype_string(spark_type))


_SPAN = "struct<start:int,end:int,level:string>"


def plain_spans(segmenter: PlainSegmenter) -> Callable[[Column], Column]:
    """The segmenter as one of a text column: spans with their quotes; a null text has none."""
    kind = f"array<{_SPAN}>"
    arrow, function = _arrow(kind), segmenter.function

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else list(span_rows(function(t), t)) for t in texts.to_pylist()], arrow)

    def of(text: Column) -> Column:
        quote = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
        return F.transform(run(text), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), quote(s).alias("quote"), s["level"].alias("level")))

    return of


def plain_signals(detectors: Sequence[tuple[int, PlainDetector]]) -> Callable[[Column, Column], Column]:
    """All plain detectors, each with its number, as one function of a text and its array of spans: an array of signals for each span.

    They run together in one Python stage, a batch of texts at a time; a
    place outside the text, an unknown direction or a weight outside [0, 1]
    is an error.
    """
    kind = f"array<{SIGNALS}>"
    arrow, own = _arrow(kind), [(d, x.function, x.__name__) for d, x in detectors]

    def one(text: str | None, spans: list[dict] | None) -> list[list[dict]] | None:
        if text is None or spans is None:
            return None
        out = []
        for s in spans:
            span = Span.of(text, s["start"], s["end"], s["level"])
            out.append([signal_row(x, d, text, span, name) for d, f, name in own for x in f(text, span)])
        return out

    @F.arrow_udf(kind)
    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([one(t, s) for t, s in zip(texts.to_pylist(), spans.to_pylist())], arrow)

    return lambda text, spans: run(text, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["level"].alias("level"))))


def plain_verdict(aggregate: PlainAggregate) -> Callable[[Column, Column], Column]:
    """The aggregate as one of a column of signals and a column of lengths; not for use inside other array functions."""
    kind = "struct<lean:double,strength:double,label:string>"
    arrow, function = _arrow(kind), aggregate.function

    def one(signals: list[dict], n: int) -> dict:
        lean, strength, label = function([Signal(s["name"], s["direction"], s["weight"], s["detector"], s["value"], s["note"], None if s["start"] is None else Span(s["start"], s["end"], s["matched"], level=s["level"])) for s in signals], n_chars=n)
        return {"lean": float(lean), "strength": float(strength), "label": str(label)}

    @F.arrow_udf(kind)
    def run(signals: pa.Array, lengths: pa.Array) -> pa.Array:
        return pa.array([one(s, n) for s, n in zip(signals.to_pylist(), lengths.to_pylist())], arrow)

    return run
