"""Stretches that stand out from their own document by token statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import let
from ..shipping import ship
from .counted import statistics

# Bands of standing with their weights, and the least that a comparison needs.
BANDS = ((1.5, 0.30), (2.5, 0.45))
MIN_WINDOWS = 6
MIN_TOKENS = 16
WINDOW = 512
#: A statistic's name: how two sums make a score, the sign of machine text, and the signal's name.
STATISTICS = {"fast-detect-gpt": ("curvature", 1.0, "curvature-outlier"), "binoculars": ("ratio", -1.0, "cross-perplexity-outlier")}
#: Rows (doc_id, text) to token statistics (doc_id, tok_idx, start, end, a, b).
Provider = Callable[[DataFrame], DataFrame]


def median(xs: Column) -> Column:
    """The middle of an array of numbers, or the mean of the two in the middle."""
    half = lambda s: (F.size(s) / 2).cast("int")
    return let(F.array_sort(xs), lambda s: F.when(F.size(s) % 2 == 1, F.element_at(s, half(s) + 1)).when(F.size(s) > 0, (F.element_at(s, F.greatest(half(s), F.lit(1))) + F.element_at(s, half(s) + 1)) / 2))


def robust_z(value: Column, reference: Column) -> Column:
    """How many scaled median deviations a value is off the median; 0 if there is no deviation."""
    off = lambda m: median(F.transform(reference, lambda x: F.abs(x - m)))
    return let(median(reference), lambda m: let(off(m) * 1.4826, lambda s: F.when(s > 0, (value - m) / s).otherwise(F.lit(0.0))))


def band_of(z: Column) -> Column:
    """What a standing weighs; null in the dead zone."""
    out = F.lit(None).cast("double")
    for least, weight in BANDS:
        out = F.when(F.abs(z) >= least, F.lit(weight)).otherwise(out)
    return out


def scored_rows(chunk: Column) -> Column:
    """(first, end): the rows of a pass's output that predict the tokens it scores; row j predicts the token behind its j-th, so the last is of no use."""
    return F.struct((chunk["first"] - chunk["start"] - 1).alias("first"), (chunk["end"] - chunk["start"] - 1).alias("end"))


def score(kind: str, a: Column, b: Column) -> Column:
    """A window's score from its two sums; 0 where it can't be divided."""
    return F.when(b > 0, a / F.sqrt(b)).otherwise(0.0) if kind == "curvature" else F.when(b != 0, a / b).otherwise(0.0)


def chunks(n: Column, window: int = WINDOW) -> Column:
    """(start, end, first) passes of a model over n tokens: each scored once, with half a window before it."""
    stride = max(1, window // 2)
    count = F.greatest(F.lit(1), F.ceil((n - window) / stride).cast("int") + 1)
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * stride).alias("start"), F.least(i * stride + window, n).cast("int").alias("end"), F.when(i == 0, 1).otherwise(F.least((i - 1) * stride + window, n)).cast("int").alias("first")))


#: Code points of a cell in which spans and tokens meet.
CELL = 512


def token_ranges(segments: DataFrame, stats: DataFrame) -> DataFrame:
    """(doc_id, seg_idx, start, end, lo, hi): the tokens that overlap each segment, hi exclusive; segments without any are left out.

    Spans and tokens meet in cells of the text, so that a long document is no
    product of its spans and tokens.
    """
    cells = lambda a, b: F.sequence(F.floor(a / CELL), F.floor(F.greatest(a, b - 1) / CELL))
    spans = segments.where("end > start").select("doc_id", "seg_idx", "start", "end", F.explode(cells(F.col("start"), F.col("end"))).alias("cell"))
    toks = stats.where("end > start").select("doc_id", "tok_idx", F.col("start").alias("a"), F.col("end").alias("b"), F.explode(cells(F.col("start"), F.col("end"))).alias("cell"))
    met = spans.join(toks, ["doc_id", "cell"]).where((F.col("a") < F.col("end")) & (F.col("b") > F.col("start")))
    return met.groupBy("doc_id", "seg_idx", "start", "end").agg(F.min("tok_idx").alias("lo"), (F.max("tok_idx") + 1).alias("hi"))


#: A segment's standing in its document.
STANDING = "seg_idx int, start int, end int, n_tokens int, n_windows int, score double, z double"


class _Without:
    """A sorted list without a few of its places, read by rank."""

    def __init__(self, ordered: list[float], out: list[int]):
        self.ordered, self.out, self.size = ordered, sorted(out), len(ordered) - len(out)

    def __getitem__(self, k: int) -> float:
        for rank in self.out:
            if rank > k:
                break
            k += 1
        return self.ordered[k]

    def median(self) -> float:
        half = self.size // 2
        return self[half] if self.size % 2 else (self[half - 1] + self[half]) / 2

    def _off(self, m: float, k: int) -> float:
        """The k-th smallest distance from m: the k + 1 nearest stand side by side, and where is found by halving."""
        low, high = 0, self.size - k - 1
        while low < high:
            mid = (low + high) // 2
            if m - self[mid] > self[mid + k + 1] - m:
                low = mid + 1
            else:
                high = mid
        return max(m - self[low], self[low + k] - m)

    def deviation(self, m: float) -> float:
        """The median distance from m."""
        half = self.size // 2
        return self._off(m, half) if self.size % 2 else (self._off(m, half - 1) + self._off(m, half)) / 2


def _ranges(a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first token that overlaps each span, and that behind the last; tokens without width overlap none."""
    wide = np.flatnonzero(b > a)
    a, b = a[wide], b[wide]
    if (np.diff(a) >= 0).all() and (np.diff(b) >= 0).all():
        first, last = np.searchsorted(b, start, "right"), np.searchsorted(a, end, "left")
    else:
        met = [np.flatnonzero((a < e) & (b > s)) for s, e in zip(start, end)]
        first, last = (np.array([f(m) if len(m) else 0 for m in met], int) for f in (lambda m: m[0], lambda m: m[-1] + 1))
    some = (last > first) & (end > start)
    at = np.append(wide, 0)
    return np.where(some, at[np.minimum(first, len(wide))], 0), np.where(some, at[last - 1] + 1, 0)


def document_standings(start: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray, kind: str, sign: float) -> Iterator[tuple[int, int, int, float, float]]:
    """(span, tokens, windows, score, z) of a document's spans; a and b are its tokens' numbers, [first, last) the places of tokens.

    Spans of one width share the windows that are as wide, half a width
    apart, sorted once. Those that overlap a span are a handful that follow
    each other, so the median and the median deviation of the others are read
    from the sorted list by rank. All widths together take n log n windows,
    and n log^2 n time, for n tokens; the windows of one width are in memory.
    """
    lo, hi = _ranges(first, last, start, end)
    sums = [np.concatenate([[0.0], np.cumsum(x)]) for x in (a, b)]

    def scores(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y = (s[j] - s[i] for s in sums)
        with np.errstate(all="ignore"):
            return np.where(y > 0, x / np.sqrt(y), 0.0) if kind == "curvature" else np.where(y != 0, x / y, 0.0)

    width, own = hi - lo, scores(lo, hi)
    for w in np.unique(width[width >= MIN_TOKENS]).tolist():
        step = max(1, w // 2)
        at = np.arange(0, len(a) - w + 1, step)
        values = scores(at, at + w)
        order = np.argsort(values, kind="stable")
        ordered, rank = values[order].tolist(), np.empty(len(order), int)
        rank[order] = np.arange(len(order))
        for k in np.flatnonzero(width == w).tolist():
            # starts from lo - w + 1 to hi - 1 overlap the span
            near = slice(max(0, -(-(int(lo[k]) - w + 1) // step)), -(-int(hi[k]) // step))
            others = _Without(ordered, rank[near].tolist())
            if others.size >= MIN_WINDOWS:
                m = others.median()
                scale = others.deviation(m) * 1.4826
                yield k, w, others.size, float(own[k]), sign * ((float(own[k]) - m) / scale if scale > 0 else 0.0)


def standings(segments: DataFrame, stats: DataFrame, kind: str, sign: float) -> DataFrame:
    """(doc_id, seg_idx, start, end, n_tokens, n_windows, score, z) for each segment long enough, with enough to compare it to.

    Segments and tokens meet by document, each in one shuffle; a task holds
    one document's tokens as arrays of numbers, 40 bytes each. Numbers that
    are null count as 0; a document without tokens has no rows.
    """
    ship(segments.sparkSession)
    id_type = segments.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, {STANDING}"
    arrow = to_arrow_schema(segments.sparkSession.createDataFrame([], schema).schema)

    def stand(key: tuple, spans: pa.Table, tokens: pa.Table) -> pa.Table:
        spans, tokens = spans.sort_by("seg_idx"), tokens.sort_by("tok_idx")
        start, end = (spans[c].to_numpy() for c in ("start", "end"))
        a, b, first, last = (pc.fill_null(tokens[c], 0).to_numpy() for c in ("a", "b", "t0", "t1"))
        made = list(zip(*document_standings(start, end, a, b, first, last, kind, sign))) or [()] * 5
        at = np.array(made[0], int)
        columns = [pa.repeat(key[0], len(at)), spans["seg_idx"].take(at).combine_chunks(), start[at], end[at], *made[1:]]
        return pa.Table.from_arrays([pa.array(x, f.type) if not isinstance(x, pa.Array) else x.cast(f.type) for x, f in zip(columns, arrow)], schema=arrow)

    spans = segments.where("end > start").select("doc_id", F.col("seg_idx").cast("int").alias("seg_idx"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    tokens = stats.select(F.col("doc_id").alias("of_doc"), "tok_idx", F.col("start").cast("int").alias("t0"), F.col("end").cast("int").alias("t1"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    return spans.groupBy("doc_id").cogroup(tokens.groupBy("of_doc")).applyInArrow(stand, schema)


def outlier_signals(segments: DataFrame, stats: DataFrame | None, detector: str = "fast-detect-gpt", docs: DataFrame | None = None) -> DataFrame:
    """Signals to inject, one for each segment that stands out; what a model thinks, not what the text says.

    Without ``stats`` those of a model counted from ``docs`` are used.
    """
    kind, sign, name = STATISTICS[detector]
    stats = statistics(docs, kind) if stats is None else stats
    rows = standings(segments, stats, kind, sign).withColumn("weight", band_of(F.col("z"))).where("weight is not null")
    note = F.format_string("%s median deviations off the rest of the document, by %s windows: a model's opinion", F.bround(F.abs(F.col("z")), 1), F.col("n_windows"))
    return rows.select("doc_id", F.lit(name).alias("name"), F.when(F.col("z") > 0, "machine").otherwise("human").alias("direction"), "weight", F.lit(detector).alias("detector"), F.bround("score", 4).cast("string").alias("value"), note.alias("note"), "start", "end")


def word_length_statistics(docs: DataFrame) -> DataFrame:
    """A provider without a model: words as tokens, a their length and b 4; for trials of the statistics."""
    from ..functions.text import matches

    rows = docs.select("doc_id", F.posexplode(matches(F.col("text"), r"\S+")).alias("tok_idx", "m"))
    return rows.select("doc_id", "tok_idx", "m.start", "m.end", (F.col("m.end") - F.col("m.start")).cast("double").alias("a"), F.lit(4.0).alias("b"))
