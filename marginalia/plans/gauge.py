"""From documents to scored segments, signals and verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import after, before, let
from ..operators.counted import counted, statistics
from ..operators.detectors import DEFAULT, Detector, by_statistics, detectors_of, plain_of, signals_of
from ..operators.outliers import STATISTICS, outlier_signals
from ..operators.plain import PlainAggregate
from ..operators.scoring import Aggregate, aggregate_of, by_direction, document_verdict, is_directed, roll_up
from ..operators.segments import SPANS, Segmenter, segmented, segmenter_of
from ..schema import SCHEMA_VERSION, SIGNALS

#: Place of injected evidence in a segment's order, behind all detectors.
INJECTED = 99
#: Code points of a cell in which segments and signals meet.
CELL = 512


_BUILT: dict[tuple, Column] = {}


def _once(spark: SparkSession, parts: tuple, make: Callable[[], Column]) -> Column:
    """An expression of named parts, built once for each application, as it has thousands of parts; functions are no names."""
    if not all(isinstance(x, (str, bool)) for x in parts):
        return make()
    key = (spark.sparkContext.applicationId, *parts)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def detected(docs: DataFrame, segmenter: str | Segmenter = "paragraph", detectors: Sequence[str | Detector] | None = None, keep: tuple[str, ...] = (), context: bool = False) -> DataFrame:
    """Segments of (doc_id, text) with their ``signals``; row by row, without a shuffle.

    Plain Python detectors run together in one stage before the columns do.
    """
    plain = plain_of(detectors)
    out = segmented(docs, segmenter, keep, context, plain)
    if plain is not None:
        return out.withColumn("signals", signals_of(F.col("quote"), F.col("start"), detectors, F.col("plain"))).drop("plain")
    return out.withColumn("signals", _once(docs.sparkSession, tuple(DEFAULT if detectors is None else detectors), lambda: signals_of(F.col("quote"), F.col("start"), detectors)))


def inject(segments: DataFrame, extra: DataFrame) -> DataFrame:
    """Segments with injected signals (doc_id, name, direction, weight, detector, value, note, start, end) among their own.

    A signal goes to the segments that hold it whole, one without a place to
    all of its document. The join is on the cell of the text in which a signal
    begins, so a long document is no product of its segments and signals.
    """
    here = segments.select("doc_id", "seg_idx", F.col("start").alias("s0"), F.col("end").alias("s1"))
    level = F.when(F.col("start").isNotNull(), F.lit("token"))
    matched = F.col("matched") if "matched" in extra.columns else F.lit(None).cast("string")
    one = F.struct(
        F.coalesce("start", "s0").cast("int").alias("at"), "name", F.lit(INJECTED).alias("d"), F.lit(0).alias("longer"), F.lit(0).alias("ord"), "direction", F.col("weight").cast("double").alias("weight"), "detector", F.col("value").cast("string").alias("value"), "note",
        F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), matched.alias("matched"), level.alias("level"),
    )
    # a row for each segment and cell of the text, and for each signal and the cell that it begins in; a null cell is all of the document
    cell = lambda at: F.floor(at / CELL).cast("int")
    cells = here.select("*", F.explode(F.concat(F.sequence(cell(F.col("s0")), cell(F.greatest("s0", "s1"))), F.array(F.lit(-1)))).alias("cell"))
    inside = F.col("start").isNull() | ((F.col("s0") <= F.col("start")) & (F.col("end") <= F.col("s1")))
    signals_ = extra.withColumn("cell", F.coalesce(cell(F.col("start")), F.lit(-1)))
    placed = cells.join(signals_, ["doc_id", "cell"]).where(inside).groupBy("doc_id", "seg_idx").agg(F.collect_list(one).cast(SIGNALS).alias("more"))
    both = segments.join(placed, ["doc_id", "seg_idx"], "left")
    return both.withColumn("signals", F.array_sort(F.concat("signals", F.coalesce("more", F.array().cast(SIGNALS))))).drop("more").select(*segments.columns)


def scored(segments: DataFrame, aggregate: str | Aggregate = "density_aggregate") -> DataFrame:
    """Segments with lean, strength and label, and their weights by direction in parts of 1/10000."""
    score, _ = aggregate_of(aggregate)
    out = segments.withColumn("v", score(F.col("signals"), F.length("quote")))
    sums = [by_direction(F.col("signals"), d).alias(d) for d in ("machine", "human", "neutral")]
    return out.select(*segments.columns, F.size("signals").cast("long").alias("n_signals"), *sums, "v.lean", "v.strength", "v.label")


def with_statistics(docs: DataFrame, segmenter: str | Segmenter, detectors: Sequence[str | Detector] | None, extra: DataFrame | None) -> tuple[Sequence[str | Detector] | None, DataFrame | None]:
    """Detectors that are columns, and evidence to inject: what was given, and what detectors by token statistics find by a model counted from ``docs``."""
    columns, names = by_statistics(detectors)
    if not names:
        return detectors, extra
    if docs.isStreaming:
        raise ValueError("detectors by token statistics need all documents: give their evidence as extra")
    segments, fields = segmented(docs, segmenter, context=False), ("doc_id", "name", "direction", "weight", "detector", "value", "note", "start", "end")
    model = counted(docs, once=len(names) == 1)
    found = [outlier_signals(segments, statistics(docs, STATISTICS[n][0], model, among=True), n).select(*fields) for n in names]
    for part in ([extra.select(*fields)] if extra is not None else []) + found[1:]:
        found[0] = found[0].unionByName(part)
    return columns, found[0]


def gauge(docs: DataFrame, segmenter: str | Segmenter = "paragraph", detectors: Sequence[str | Detector] | None = None, aggregate: str | Aggregate = "density_aggregate", extra: DataFrame | None = None, keep: tuple[str, ...] = (), context: bool = False) -> DataFrame:
    """Scored segments of (doc_id, text), ids unique; a null text has none.

    Detectors by token statistics (fast-detect-gpt, binoculars) use a model
    that is counted from the documents; evidence by another is given as ``extra``.
    """
    detectors, extra = with_statistics(docs, segmenter, detectors, extra)
    found = detected(docs, segmenter, detectors, keep, context)
    return scored(inject(found, extra) if extra is not None else found, aggregate)


def _nested(docs: DataFrame, segmenter: str | Segmenter, detectors: Sequence[str | Detector] | None, aggregate: str | Aggregate, keep: tuple[str, ...], context: bool) -> DataFrame:
    """(doc_id, *keep, text_sha256, n_chars, segments): each document's scored segments in its own row, so nothing is shuffled."""
    build, score, text, plain = segmenter_of(segmenter)[0], aggregate_of(aggregate)[0], F.col("text"), plain_of(detectors)
    spans = build(text).cast(SPANS)
    if plain is not None:
        docs = docs.select("doc_id", *keep, "text", spans.alias("spans_")).withColumn("plain_", plain(text, F.col("spans_")))
        spans = F.col("spans_")

    def whole(s: Column, i: Column) -> Column:
        def of(found: Column) -> Column:
            return let(score(found, F.length(s["quote"])), lambda v: F.struct(
                i.alias("seg_idx"), s["start"].alias("start"), s["end"].alias("end"), s["quote"].alias("quote"), *around(s), s["level"].alias("level"), v["lean"].alias("lean"), v["strength"].alias("strength"), v["label"].alias("label"),
                found.alias("signals"), *(by_direction(found, d).alias(d) for d in ("machine", "human", "neutral")),
            ))

        return let(signals_of(s["quote"], s["start"], detectors, None if plain is None else F.get("plain_", i)), of)

    def every() -> Column:
        return F.transform(spans, whole)

    around = lambda s: (before(text, s["start"]).alias("prefix"), after(text, s["end"]).alias("suffix")) if context else ()
    return docs.select("doc_id", *keep, F.sha2("text", 256).alias("text_sha256"), F.length("text").alias("n_chars"), _once(docs.sparkSession, (segmenter, aggregate, context, *(DEFAULT if detectors is None else detectors)), every).alias("segments"))


def scored_segments(docs: DataFrame, segmenter: str | Segmenter = "paragraph", detectors: Sequence[str | Detector] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, text_sha256, n_chars, segments): each document's segments with signals and weights by direction, in its own row."""
    return _nested(docs, segmenter, detectors, "density_aggregate", keep, False)


def _judged(nested: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The rows of ``_nested`` with their documents' verdicts, by sums over each row's own array."""
    added = lambda of: F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + of(s))
    sums = F.struct(F.size("segments").cast("long").alias("n_segments"), added(lambda s: is_directed(s["label"]).cast("long")).alias("directed"), *(added(lambda s, d=d: s[d]).alias(d) for d in ("machine", "human", "neutral")))
    out = nested.withColumn("n_signals", F.coalesce(added(lambda s: F.size(s["signals"]).cast("long")), F.lit(0)).cast("long")).withColumn("v", let(sums, lambda x: document_verdict(x, F.col("n_chars"))))
    return out.select("doc_id", *keep, "text_sha256", "n_chars", F.when(F.col("segments").isNull(), F.lit(0)).otherwise(F.size("segments")).cast("long").alias("n_segments"), "n_signals", "v.lean", "v.strength", "v.label", "segments")


def _names(detectors: Sequence[str | Detector] | None) -> list[str]:
    detectors_of(by_statistics(detectors)[0])  # unknown names are an error
    return [x if isinstance(x, str) else getattr(x, "__name__", "custom") for x in (DEFAULT if detectors is None else detectors)]


def judged(docs: DataFrame, segmenter: str | Segmenter = "paragraph", detectors: Sequence[str | Detector] | None = None, aggregate: str | Aggregate = "density_aggregate", keep: tuple[str, ...] = ()) -> DataFrame:
    """Verdicts with their documents' scored segments as an array in the same row, for what needs both."""
    return _judged(_nested(docs, segmenter, detectors, aggregate, keep, False), keep)


def _named(reports: DataFrame, segmenter: str | Segmenter, detectors: Sequence[str | Detector] | None, aggregate: str | Aggregate) -> DataFrame:
    """What made a report, behind its other columns."""
    names = _names(detectors)
    return reports.withColumns({"segmenter": F.lit(segmenter_of(segmenter)[1]), "detectors": F.lit(",".join(names)), "calibration": F.lit(f"uncalibrated ({aggregate_of(aggregate)[1]})"), "schema_version": F.lit(SCHEMA_VERSION)})


def verdicts(docs: DataFrame, segmenter: str | Segmenter = "paragraph", detectors: Sequence[str | Detector] | None = None, aggregate: str | Aggregate = "density_aggregate", extra: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A flat report for each document: its digest, counts, verdict, and what made it.

    Row by row, without a shuffle; with injected evidence the segments meet it
    by doc_id, and sums of theirs meet the documents.
    """
    named = detectors
    detectors, extra = with_statistics(docs, segmenter, detectors, extra)
    if extra is None and not isinstance(aggregate, PlainAggregate):
        out = _judged(_nested(docs, segmenter, detectors, aggregate, keep, False), keep).drop("segments")
    else:
        heads = docs.select("doc_id", *keep, F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
        out = roll_up(gauge(docs, segmenter, detectors, aggregate, extra), heads, (*keep, "text_sha256"))
    return _named(out, segmenter, named, aggregate)


def signals(segments: DataFrame) -> DataFrame:
    """A row for each signal of segments, in order: (doc_id, seg_idx, nth, name, direction, weight, detector, value, note, start, end, matched, level)."""
    # the outer form with a test of the place: a plain one lets the optimizer put a filter on the signals below, which evaluates all detectors twice
    rows = segments.select("doc_id", "seg_idx", F.posexplode_outer("signals").alias("nth", "s")).where("nth is not null")
    return rows.select("doc_id", "seg_idx", "nth", *(f"s.{c}" for c in ("name", "direction", "weight", "detector", "value", "note", "start", "end", "matched", "level")))


def reports(docs: DataFrame, segmenter: str | Segmenter = "paragraph", detectors: Sequence[str | Detector] | None = None, aggregate: str | Aggregate = "density_aggregate", extra: DataFrame | None = None) -> DataFrame:
    """Nested reports: verdicts with an array of segments, each with its signals and context.

    Without injected evidence a report comes from its document's row alone.
    """
    plain = lambda s: F.transform(s["signals"], lambda x: x.dropFields("at", "d", "longer", "ord")).alias("signals")
    fields = ("seg_idx", "start", "end", "quote", "prefix", "suffix", "level", "lean", "strength", "label")
    named = detectors
    detectors, extra = with_statistics(docs, segmenter, detectors, extra)
    if extra is None and not isinstance(aggregate, PlainAggregate):
        judged = _judged(_nested(docs, segmenter, detectors, aggregate, (), True), ())
        shown = F.when(F.size("segments") > 0, F.transform("segments", lambda s: F.struct(*(s[c].alias(c) for c in fields), plain(s))))
        out = _named(judged.withColumn("own", shown).drop("segments"), segmenter, detectors, aggregate)
        return out.withColumnRenamed("own", "segments").select(*(c for c in out.columns if c != "own"), "segments")
    segs = gauge(docs, segmenter, detectors, aggregate, extra, context=True)
    one = F.struct(*fields, F.transform("signals", lambda s: s.dropFields("at", "d", "longer", "ord")).alias("signals"))
    arrays = segs.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("segments"))
    return verdicts(docs, segmenter, detectors, aggregate, extra).withColumn("detectors", F.lit(",".join(_names(named)))).join(arrays, "doc_id", "left")
