"""Verdicts: direction, amount of evidence and label, for segments and documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..schema import EVIDENCE_FULL, LEAN_THRESHOLD, REFERENCE_CHARS, SEGMENT_RATE_FULL, STRENGTH_FLOOR
from .plain import PlainAggregate, plain_verdict

#: Signals and the length of their text to (lean, strength, label).
Aggregate = Callable[[Column, Column], Column]
VERDICT = "struct<lean:double,strength:double,label:string>"
#: Weights are added up as whole numbers of this part of one, so that order doesn't matter.
_PARTS = 10_000


def weight_parts(weight: Column) -> Column:
    return F.round(weight * _PARTS).cast("long")


def by_direction(signals: Column, direction: str) -> Column:
    """The weight of an array's signals of one direction, in parts."""
    return F.aggregate(F.filter(signals, lambda s: s["direction"] == direction), F.lit(0).cast("long"), lambda a, s: a + weight_parts(s["weight"]))


def label(lean: Column, strength: Column, machine: Column, human: Column) -> Column:
    """The call from a rounded lean and strength; without enough evidence there is none."""
    return F.when(strength < STRENGTH_FLOOR, "no-evidence").when(lean >= LEAN_THRESHOLD, "leans-machine").when(lean <= -LEAN_THRESHOLD, "leans-human").when((machine > 0) & (human > 0), "mixed-signals").otherwise("uncertain")


def lean(machine: Column, human: Column) -> Column:
    return F.when(machine + human > 0, F.bround((machine - human) / (machine + human), 3)).otherwise(F.lit(0.0))


def verdict(machine: Column, human: Column, neutral: Column, full: Column) -> Column:
    """(lean, strength, label) from weights in parts, ``full`` being the total at which strength is 1."""
    total = machine + human + neutral
    numbers = F.struct(lean(machine, human).alias("lean"), F.bround(F.least(total / (full * _PARTS), F.lit(1.0)), 3).alias("strength"))
    return let(numbers, lambda n: F.struct(n["lean"].alias("lean"), n["strength"].alias("strength"), label(n["lean"], n["strength"], machine, human).alias("label"))).cast(VERDICT)


def scale(n_chars: Column, reference: Column | float = REFERENCE_CHARS) -> Column:
    return F.greatest(F.lit(1.0), F.coalesce(n_chars, F.lit(0)) / (reference if isinstance(reference, Column) else F.lit(float(reference))))


def _weights(signals: Column) -> Column:
    return F.struct(*(by_direction(signals, d).alias(d) for d in ("machine", "human", "neutral")))


def blind(signals: Column, n_chars: Column | None = None) -> Column:
    """Evidence in all, whatever the length."""
    return let(_weights(signals), lambda w: verdict(w["machine"], w["human"], w["neutral"], F.lit(EVIDENCE_FULL)))


def density(signals: Column, n_chars: Column) -> Column:
    """Evidence for its length, beyond a reference length; the default."""
    return let(_weights(signals), lambda w: verdict(w["machine"], w["human"], w["neutral"], F.lit(EVIDENCE_FULL) * scale(n_chars)))


AGGREGATES: dict[str, Aggregate] = {"aggregate": blind, "density_aggregate": density}


def aggregate_of(which: str | Aggregate | PlainAggregate) -> tuple[Aggregate, str]:
    """An aggregate and the name that a report's calibration gives it."""
    if isinstance(which, PlainAggregate):
        return plain_verdict(which), which.__name__
    return (which, getattr(which, "__name__", "custom")) if callable(which) else (AGGREGATES[which], which)


def document_verdict(sums: Column, n_chars: Column) -> Column:
    """(lean, strength, label) of a document from its sums (n_segments, directed, machine, human, neutral), weights in parts.

    Zero without a segment whose label has a direction; else strength is the
    least of two views: the share of such segments, and weight for length.
    """
    m, h, n = (F.coalesce(sums[d], F.lit(0)) for d in ("machine", "human", "neutral"))
    by_rate = sums["directed"] / sums["n_segments"] / SEGMENT_RATE_FULL
    by_density = (m + h + n) / (_PARTS * EVIDENCE_FULL * scale(n_chars))
    some = (F.coalesce(sums["directed"], F.lit(0)) > 0) & (m + h > 0)
    numbers = F.struct(F.when(some, lean(m, h)).otherwise(0.0).alias("lean"), F.when(some, F.bround(F.least(by_rate, by_density, F.lit(1.0)), 3)).otherwise(0.0).alias("strength"))
    return let(numbers, lambda x: F.struct(x["lean"].alias("lean"), x["strength"].alias("strength"), F.when(some, label(x["lean"], x["strength"], m, h)).otherwise("no-evidence").alias("label"))).cast(VERDICT)


def is_directed(label: Column) -> Column:
    return label.isin("leans-machine", "leans-human")


def roll_up(segments: DataFrame, docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, n_chars, n_segments, n_signals, lean, strength, label) for each row of docs (doc_id, *keep, n_chars).

    From scored segments (doc_id, label, machine, human, neutral, n_signals), weights in
    parts. Only numbers are shuffled, after a sum in each task.
    """
    sums = segments.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.sum("n_signals").alias("n_signals"), F.count_if(is_directed(F.col("label"))).alias("directed"), *(F.sum(d).alias(d) for d in ("machine", "human", "neutral")))
    one = F.struct("n_segments", "directed", "machine", "human", "neutral")
    out = docs.join(sums, "doc_id", "left").withColumn("v", document_verdict(one, F.col("n_chars")))
    return out.select("doc_id", *keep, "n_chars", F.coalesce("n_segments", F.lit(0)).cast("long").alias("n_segments"), F.coalesce("n_signals", F.lit(0)).cast("long").alias("n_signals"), "v.lean", "v.strength", "v.label")
