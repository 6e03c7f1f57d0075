"""Segmenters: a text to spans that keep every character where it was."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BLANK, FLAGS, after, before, let, running
from .plain import PlainSegmenter, plain_spans

#: A text's spans as an array of (start, end, quote, level).
Segmenter = Callable[[Column], Column]
SPANS = "array<struct<start:int,end:int,quote:string,level:string>>"
#: Tiles of white space and what goes on, lazily, to a terminator before white space or to the end.
SENTENCE = r"(?s)\s*\S.*?(?:[.!?](?=\s|$)|$)"
#: Put in front of a line end to part paragraphs, and what a text's own such sign is meanwhile.
_MARK, _OWN = "\u0001", "\u0001\u0002"


def _span(start: Column, quote: Column, level: str) -> Column:
    return F.struct(start.cast("int").alias("start"), (start + F.length(quote)).cast("int").alias("end"), quote.alias("quote"), F.lit(level).alias("level"))


def paragraphs(text: Column) -> Column:
    """Runs of lines; a new one begins after an empty line, or with a blank line that another line end follows.

    A line opens a paragraph if it has characters and is the first, or follows
    an empty line, or is all white space without being the last. Such lines
    get a mark, by which the text is then split; empty lines at a paragraph's
    end fall off. A mark that a text has itself is never before a line end meanwhile.
    """
    def marked(lines: Column) -> Column:
        last = F.size(lines) - 1
        previous = lambda i: F.element_at(lines, F.greatest(i, F.lit(1)))
        opens = lambda x, i: (F.length(x) > 0) & ((i == 0) | (F.length(previous(i)) == 0) | (x.rlike(r"(?U)^\s+$") & (i < last)))
        return F.array_join(F.transform(lines, lambda x, i: F.when(opens(x, i), F.concat(F.lit(_MARK + "\n"), x)).otherwise(x)), "\n")

    def cut(pieces: Column) -> Column:
        # a piece ends in the line end that the next mark stood behind; marks and the line end after them count nothing
        own = F.transform(pieces, lambda p: F.replace(p, F.lit(_OWN), F.lit(_MARK)))
        return let(own, lambda o: F.zip_with(running(F.transform(o, lambda p: F.length(p))), o, lambda at, p: F.struct(at.alias("at"), p.alias("p"))))

    doubled = F.replace(text, F.lit(_MARK), F.lit(_OWN))
    pieces = F.split(let(F.split(doubled, "\n", -1), marked), _MARK + "\n", -1)
    spans = F.transform(let(pieces, cut), lambda x: _span(x["at"], F.regexp_replace(x["p"], r"\n+\z", ""), "paragraph"))
    return F.filter(spans, lambda s: F.length(s["quote"]) > 0).cast(SPANS)


def sentences(text: Column) -> Column:
    """Sentences of each paragraph; white space between them belongs to none."""
    def tiles(p: Column) -> Column:
        tiled = let(F.regexp_extract_all(p["quote"], F.lit(FLAGS + SENTENCE), F.lit(0)), lambda ws: F.zip_with(running(F.transform(ws, lambda w: F.length(w))), ws, lambda at, w: let(F.ltrim(w, F.lit(BLANK)), lambda s: _span(p["start"] + at + F.length(w) - F.length(s), s, "sentence"))))
        return F.filter(tiled, lambda s: s["end"] > s["start"])

    return F.flatten(F.transform(paragraphs(text), tiles)).cast(SPANS)


def document(text: Column) -> Column:
    """One span over the whole text, an empty one too."""
    return F.array(_span(F.lit(0), text, "document")).cast(SPANS)


SEGMENTERS: dict[str, Segmenter] = {"paragraph": paragraphs, "sentence": sentences, "document": document}
_ABOUT = {"paragraph": "runs of lines without a blank line between them", "sentence": "stretches to a full stop, within a paragraph", "document": "the whole text as one"}


def segmenter_of(which: str | Segmenter | PlainSegmenter) -> tuple[Segmenter, str]:
    """A segmenter and its name; any function of a text column that returns such spans, or a plain Python one, is ``custom``."""
    if isinstance(which, PlainSegmenter):
        return plain_spans(which), "custom"
    if callable(which):
        return which, "custom"
    if which not in SEGMENTERS:
        raise KeyError(f"unknown segmenter {which!r}; known: {sorted(SEGMENTERS)}")
    return SEGMENTERS[which], which


def segmented(docs: DataFrame, segmenter: str | Segmenter | PlainSegmenter = "paragraph", keep: tuple[str, ...] = (), context: bool = True, plain: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(doc_id, *keep, seg_idx, start, end, quote, level, prefix, suffix, n_chars) from (doc_id, text), a row for each span.

    A null text has no spans. Each task splits what it has read: no shuffle.
    ``context`` False leaves out prefix and suffix. ``plain`` finds signals in
    a text's spans, which are the column ``plain``.
    """
    build, _ = segmenter_of(segmenter)
    spans = build(F.col("text")).cast(SPANS)
    if context:
        spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["quote"].alias("quote"), s["level"].alias("level"), before(F.col("text"), s["start"]).alias("prefix"), after(F.col("text"), s["end"]).alias("suffix")))
    if plain is not None:
        rows = docs.select("doc_id", *keep, "text", spans.alias("spans_")).withColumn("plain_", plain(F.col("text"), F.col("spans_")))
        out = rows.select("doc_id", *keep, F.length("text").alias("n_chars"), "plain_", F.posexplode("spans_").alias("seg_idx", "s"))
        return out.select("doc_id", *keep, "n_chars", "seg_idx", "s.*", F.get("plain_", F.col("seg_idx")).alias("plain"))
    out = docs.select("doc_id", *keep, F.length("text").alias("n_chars"), F.posexplode(spans).alias("seg_idx", "s"))
    return out.select("doc_id", *keep, "n_chars", "seg_idx", "s.*")


def segmenters(spark: SparkSession) -> DataFrame:
    """(name, about) of the segmenters."""
    return spark.createDataFrame([(n, _ABOUT[n]) for n in SEGMENTERS], "name string, about string")
