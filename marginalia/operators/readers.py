"""Several readers' judgments on documents: anchoring, agreement, and what to read it beside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_where, let, whitespace_words
from ..schema import PER_WORDS
from .segments import SPANS, Segmenter, segmenter_of

UNITS = "array<struct<unit:int,start:int,end:int,quote:string>>"
#: What a judgment weighs and is called when it doesn't say.
WEIGHT, NAME, DETECTOR = 0.35, "judgment", "judge"


def per_words(count: Column, n_words: Column) -> Column:
    """Count for each 1,000 words; null without words."""
    return F.when(n_words > 0, F.bround(PER_WORDS * count / n_words, 2))


#: Judgments of one document that share a copy of its text.
TOGETHER = 2048


def together(judgments: DataFrame) -> DataFrame:
    """(doc_id, part, own): each document's judgments as arrays of about ``TOGETHER`` rows at most, so that they meet its text a few times, not once each.

    Only documents with more than that are counted out; the table of them is
    joined, and a document of any number of judgments is spread over parts.
    """
    name, columns = "many_judgments_of_a_document", judgments.columns
    many = judgments.groupBy("doc_id").agg(F.count("*").alias(name)).where(F.col(name) > TOGETHER)
    part = F.when(F.col(name).isNull(), 0).otherwise(F.pmod(F.xxhash64(*columns), F.ceil(F.col(name) / TOGETHER))).cast("int")
    rows = judgments.join(many, "doc_id", "left").select("doc_id", part.alias("part"), F.struct(*(c for c in columns if c != "doc_id")).alias("j"))
    return rows.groupBy("doc_id", "part").agg(F.collect_list("j").alias("own"))


def _place(j: Column, text: Column) -> Column:
    """(x, y, gone): where a judgment stands in its document's text, and whether its quote doesn't occur."""
    at = F.when(j["quote"].isNotNull(), F.call_function("locate", j["quote"], text) - 1)
    return let(at, lambda p: F.struct(
        F.when(j["quote"].isNull(), j["start"]).when(p >= 0, p).cast("int").alias("x"), F.when(j["quote"].isNull(), j["end"]).when(p >= 0, p + F.length(j["quote"])).cast("int").alias("y"), (j["quote"].isNotNull() & (p < 0)).alias("gone"),
    ))


def anchored(docs: DataFrame, judgments: DataFrame) -> DataFrame:
    """Judgments (doc_id, reader, direction, quote, start, end, name, weight, note, detector, value) with a place.

    A quote stands where it first occurs in the document's text; one that
    doesn't occur is ``dropped``, with null start and end. Without a quote,
    start and end are taken as given. A text is read once for all of its
    judgments.
    """
    rows = docs.select("doc_id", "text").join(together(judgments), "doc_id")
    placed = rows.select("doc_id", F.explode(F.transform("own", lambda j: F.struct(j.alias("j"), _place(j, F.col("text")).alias("p")))).alias("r"))
    plain = [F.coalesce("r.j.name", F.lit(NAME)).alias("name"), F.coalesce("r.j.weight", F.lit(WEIGHT)).alias("weight"), F.coalesce("r.j.note", F.lit("")).alias("note"), F.coalesce("r.j.detector", F.lit(DETECTOR)).alias("detector")]
    return placed.select("doc_id", "r.j.reader", "r.j.direction", "r.j.quote", F.col("r.p.x").alias("start"), F.col("r.p.y").alias("end"), F.col("r.p.gone").alias("dropped"), *plain, "r.j.value")


def judgment_signals(docs: DataFrame, judgments: DataFrame) -> DataFrame:
    """One reader's judgments as evidence to inject; quotes that are gone are left out, any direction stays."""
    return anchored(docs, judgments).where(F.col("direction").isNotNull() & ~F.col("dropped")).select("doc_id", "name", "direction", "weight", "detector", "value", "note", "start", "end")


def judged_units(docs: DataFrame, judgments: DataFrame, segmenter: str | Segmenter = "sentence") -> DataFrame:
    """Judgments with a place and the units that they overlap: one join of texts and judgments, each text cut into units in its own row.

    A text and its units meet all judgments in one row. Built-in segmenters'
    units are in order and apart, so those that a judgment overlaps follow
    each other and are found by halving; no other pair is looked at.

    (doc_id, n_units, n_words, reader, reader_at, direction, name, weight,
    dropped, units), units being (unit, start, end, quote). A reader who flags
    nothing has one row without a direction. ``reader_at`` is the reader's
    place among the readers, null where judgments have none; then names decide.
    """
    spans = segmenter_of(segmenter)[0](F.col("text")).cast(SPANS)
    numbered = F.transform(spans, lambda s, i: F.struct(i.cast("int").alias("unit"), s["start"].alias("start"), s["end"].alias("end"), s["quote"].alias("quote")))
    texts = docs.select("doc_id", "text", numbered.alias("every"), whitespace_words(F.col("text")).cast("long").alias("n_words"))
    place = F.col("reader_at").cast("int") if "reader_at" in judgments.columns else F.lit(None).cast("int")
    own = judgments.select("doc_id", "reader", place.alias("reader_at"), "direction", "quote", "start", "end", F.coalesce("name", F.lit(NAME)).alias("name"), F.coalesce("weight", F.lit(WEIGHT)).alias("weight"))
    every, in_line = F.col("every"), isinstance(segmenter, str)

    def met(p: Column) -> Column:
        if not in_line:  # spans of one's own may overlap, in any order
            return F.filter(every, lambda u: (u["start"] < p["y"]) & (u["end"] > p["x"]))
        n = F.size(every)
        first = first_where(n, lambda i: F.get(every, i)["end"] > p["x"])
        return let(F.struct(first.alias("a"), first_where(n, lambda i: F.get(every, i)["start"] >= p["y"]).alias("b")), lambda r: F.slice(every, r["a"] + 1, F.greatest(r["b"] - r["a"], F.lit(0))))

    def judged(j: Column) -> Column:
        flagged = lambda p: F.when(j["direction"].isin("machine", "human") & ~p["gone"], F.when(p["x"].isNotNull() & p["y"].isNotNull() & every.isNotNull(), met(p)).otherwise(F.array().cast(UNITS)))
        return let(_place(j, F.col("text")), lambda p: F.struct(*(j[c].alias(c) for c in ("reader", "reader_at", "direction", "name", "weight")), p["gone"].alias("dropped"), flagged(p).alias("units")))

    rows = texts.join(together(own), "doc_id").select("doc_id", F.coalesce(F.size("every"), F.lit(0)).cast("long").alias("n_units"), "n_words", F.explode(F.transform("own", judged)).alias("j"))
    return rows.select("doc_id", "n_units", "n_words", "j.*")


def _flags(judged: DataFrame) -> DataFrame:
    return judged.select("doc_id", "reader", "reader_at", "direction", "name", "weight", F.explode("units").alias("u")).select("doc_id", "reader", "reader_at", "direction", "u.*", "name", "weight")


def flags(docs: DataFrame, judgments: DataFrame, segmenter: str | Segmenter = "sentence") -> DataFrame:
    """(doc_id, reader, reader_at, direction, unit, start, end, quote, name, weight): each judgment by each unit that it overlaps."""
    return _flags(judged_units(docs, judgments, segmenter))


def reader_counts(docs: DataFrame, judgments: DataFrame, segmenter: str | Segmenter = "sentence") -> DataFrame:
    """(doc_id, reader, machine, human, dropped): units a reader flags in each direction, and quotes not found; readers who flag nothing have zeros."""
    rows = judged_units(docs, judgments, segmenter).select("doc_id", "reader", "direction", "dropped", F.explode_outer("units.unit").alias("unit"))
    units = (F.count_distinct(F.when(F.col("direction") == d, F.col("unit"))).alias(d) for d in ("machine", "human"))
    return rows.groupBy("doc_id", "reader").agg(*units, F.count_if(F.col("dropped") & F.col("direction").isin("machine", "human")).alias("dropped"))


def check_k(k: int, n_readers: int) -> None:
    """Raises where agreement of ``k`` readers can't be asked of ``n_readers``."""
    if k < 1:
        raise ValueError(f"k must be at least 1, got {k}")
    if n_readers < k:
        raise ValueError(f"k={k} needs at least {k} readers; got {n_readers}")


def _agreed(judged: DataFrame, k: int) -> DataFrame:
    one = F.min(F.struct("start", "end", "quote")).alias("u")
    own = _flags(judged).groupBy("doc_id", "unit", "direction", "reader").agg(one, F.min("reader_at").alias("reader_at"), F.max("weight").alias("weight"), F.collect_set("name").alias("names"))
    both = own.groupBy("doc_id", "unit", "direction").agg(F.min("u").alias("u"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("reader_at", "reader"))).alias("readers"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("shapes"), F.sum(F.col("weight").cast("decimal(9,4)")).alias("total"))
    return both.where(F.col("n") >= k).select("doc_id", "unit", "direction", "u.*", F.col("readers.reader").alias("readers"), "shapes", F.bround(F.col("total").cast("double") / F.col("n"), 2).alias("weight"), "n")


def consensus_units(docs: DataFrame, judgments: DataFrame, k: int = 2, segmenter: str | Segmenter = "sentence", judged: DataFrame | None = None) -> DataFrame:
    """(doc_id, unit, direction, start, end, quote, readers, shapes, weight, n): units that at least ``k`` readers flag.

    A reader counts once for a unit, with the strongest of its judgments; the
    weight is the mean of those. Readers are in their own order where
    judgments have ``reader_at``. Two sums by key, with sums in tasks before;
    (doc_id, direction, start) is the order of a listing. ``judged`` has the
    rows of ``judged_units`` where they are there already.
    """
    check_k(k, k)
    return _agreed(judged_units(docs, judgments, segmenter) if judged is None else judged, k)


def listing(units: DataFrame) -> DataFrame:
    """Consensus units with ``rank``, their place in their document's list: by direction, then where they begin."""
    return units.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("direction", "start", "unit")))


def consensus(docs: DataFrame, judgments: DataFrame, k: int = 2, segmenter: str | Segmenter = "sentence", judged: DataFrame | None = None) -> DataFrame:
    """(doc_id, k, n_readers, unit, n_units, n_words, machine, human, machine_per_1000, human_per_1000) for each document with judgments.

    Readers who flag nothing count among the readers. A document with fewer
    than ``k`` readers stops the job with an error.
    """
    check_k(k, k)
    judged = judged_units(docs, judgments, segmenter) if judged is None else judged
    heads = judged.groupBy("doc_id").agg(F.max("n_units").alias("n_units"), F.max("n_words").alias("n_words"), F.count_distinct("reader").alias("n_readers"))
    agreed = _agreed(judged, k).groupBy("doc_id").agg(*(F.count_if(F.col("direction") == d).alias(d) for d in ("machine", "human")))
    out = heads.join(agreed, "doc_id", "left").fillna(0, ["machine", "human"])
    enough = F.when(F.col("n_readers") >= k, F.col("n_readers")).otherwise(F.raise_error(F.format_string(f"k={k} needs at least {k} readers; got %s", F.col("n_readers"))))
    return out.select("doc_id", F.lit(k).alias("k"), enough.cast("long").alias("n_readers"), F.lit(segmenter_of(segmenter)[1]).alias("unit"), "n_units", "n_words", "machine", "human", per_words(F.col("machine"), F.col("n_words")).alias("machine_per_1000"), per_words(F.col("human"), F.col("n_words")).alias("human_per_1000"))


def consensus_signals(units: DataFrame, readers: DataFrame) -> DataFrame:
    """Consensus units as evidence to inject; ``readers`` has (doc_id, n_readers)."""
    note = F.format_string("%s of %s readers agree (%s): %s", F.col("n"), F.col("n_readers"), F.array_join("readers", ", "), F.array_join("shapes", ", "))
    return units.join(readers.select("doc_id", "n_readers"), "doc_id").select("doc_id", F.lit("reader-consensus").alias("name"), "direction", F.least(F.col("weight"), F.lit(1.0)).alias("weight"), F.lit("readers").alias("detector"), F.col("n").cast("string").alias("value"), note.alias("note"), "start", "end", F.col("quote").alias("matched"))


def pooled(readings: DataFrame) -> DataFrame:
    """One row over the rows of ``consensus``: sums by words, and the range of the texts' own densities.

    Readings at different k, or none, stop the job with an error.
    """
    ks, of = F.array_sort(F.collect_set("k")), {}
    for d in ("machine", "human"):
        each = F.when(F.col("n_words") > 0, F.bround(PER_WORDS * F.col(d) / F.col("n_words"), 2))
        of |= {d: F.sum(d), f"{d}_low": F.min(each), f"{d}_high": F.max(each)}
    sums = readings.agg(ks.alias("ks"), F.first("unit").alias("unit"), F.array_sort(F.collect_set("n_readers")).alias("n_readers"), F.count("*").alias("n_texts"), F.sum("n_words").alias("n_words"), *(v.alias(k) for k, v in of.items()))
    k = F.when(F.size("ks") == 1, F.element_at("ks", 1)).when(F.size("ks") == 0, F.raise_error(F.lit("pooling needs at least one result"))).otherwise(F.raise_error(F.lit("cannot pool results taken at different k")))
    rates = [per_words(F.col(d), F.col("n_words")).alias(f"{d}_per_1000") for d in ("machine", "human")]
    return sums.select(k.cast("int").alias("k"), "unit", "n_readers", "n_texts", "n_words", *of, *rates)


def beside(rows: DataFrame, one: DataFrame, prefix: str) -> DataFrame:
    """``rows`` with the values of the only row of ``one`` behind, as constants; another number of rows is an error."""
    found = one.limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"one row is needed to compare with; got {'none' if not found else 'several'}")
    return rows.select("*", *(F.lit(found[0][f.name]).cast(f.dataType).alias(prefix + f.name) for f in one.schema.fields))


def compared(readings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Readings with the one row of ``pooled`` beside them, and ``caveats`` where the two are not alike."""
    both = beside(readings, baseline, "base_")
    k = F.when(F.col("base_k") != F.col("k"), F.format_string("read at k=%s, the baseline at k=%s: not the same measure", F.col("k"), F.col("base_k")))
    n = F.when(F.size(F.array_except("base_n_readers", F.array("n_readers"))) > 0, F.format_string("%s readers here, %s for the baseline: more readers agree more often by chance", F.col("n_readers"), F.array_join(F.transform("base_n_readers", lambda x: x.cast("string")), ", ")))
    return both.withColumn("caveats", F.array_compact(F.array(k, n)))
