"""A query for each operator, over the whole of its table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .functions.text import matches, plain_words, utf16_offset, whitespace_words
from .operators import counted, edits, evaluate, outliers, placement, readers
from .operators.detectors import BY_STATISTICS, DEFAULT, QUOTED, detectors, forensic, is_markup, rhetoric, rhythm_cv
from .operators.plain import PlainAggregate, PlainDetector, PlainSegmenter
from .operators.rules import Rule, catalogue, tell_matches
from .operators.scoring import blind, density
from .operators.segments import segmented, segmenters
from .plans import baseline as pooling
from .plans import gauge as plan
from .plans import pages, report
from .seeds import seeded
from .sources.readers import parsed_judgments, table
from .streaming import late

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
#: Fixed lengths at which the edit query changes each text.
EDITS = ((1, 3, 3, 5), (2, 0, 4, 1), (3, 40, 60, 0))


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _segs(spark: SparkSession, d: str, segmenter: str = "paragraph") -> DataFrame:
    return segmented(seeded(spark, d), segmenter, context=False)


@query
def seg_document(spark, d):
    """One span for each document."""
    return segmented(_docs(spark, d), "document", context=False).select("doc_id", "seg_idx", "start", "end", F.sha2("quote", 256).alias("quote_hash"))


@query
def seg_paragraph(spark, d):
    """Paragraphs with their places."""
    return _segs(spark, d).select("doc_id", "seg_idx", "start", "end", F.sha2("quote", 256).alias("quote_hash"))


@query
def seg_sentence(spark, d):
    """Sentences with their places."""
    return _segs(spark, d, "sentence").select("doc_id", "seg_idx", "start", "end", F.sha2("quote", 256).alias("quote_hash"))


@query
def span_context(spark, d):
    """Paragraphs with what stands around them."""
    return segmented(seeded(spark, d), "paragraph").select("doc_id", "seg_idx", "start", "end", "prefix", "suffix")


@query
def segmenter_list(spark, d):
    return segmenters(spark).select("name")


@query
def detector_list(spark, d):
    return detectors(spark).select("name")


@query
def match_offsets(spark, d):
    """Places of all words of eight letters or more that a comma follows."""
    rows = _docs(spark, d).select("doc_id", F.posexplode(matches(F.col("text"), "[a-z]{8,},", "")).alias("nth", "m"))
    return rows.select("doc_id", "nth", "m.start", "m.end", "m.matched")


@query
def utf16_offsets(spark, d):
    """Ends of paragraphs in code points and in UTF-16 units."""
    segs = segmented(seeded(spark, d), "paragraph", keep=("text",), context=False)
    return segs.select("doc_id", "seg_idx", "end", utf16_offset(F.col("text"), F.col("end")).alias("utf16_end"))


@query
def word_counts(spark, d):
    """Words of each document in the two ways that are used."""
    return _docs(spark, d).select("doc_id", whitespace_words(F.col("text")).alias("n_words"), plain_words(F.col("text")).alias("n_plain"))


def _tells(spark, d, tiers=None):
    rows = _segs(spark, d).select("doc_id", "seg_idx", "start", F.explode(tell_matches(F.col("quote"), tiers=tiers)).alias("m"))
    return rows.select("doc_id", "seg_idx", F.col("m.rule").alias("rule"), F.col("m.tier").alias("tier"), F.col("m.weight").alias("weight"), (F.col("start") + F.col("m.start")).alias("start"), (F.col("start") + F.col("m.end")).alias("end"))


@query
def tell_catalogue(spark, d):
    """All matches of the catalogue, quoted ones too."""
    return _tells(spark, d)


@query
def tell_tier_filter(spark, d):
    """Matches of the surest tier only, counted by rule."""
    return _tells(spark, d, ("E",)).groupBy("rule").agg(F.count("*").alias("n"))


@query
def tell_rules(spark, d):
    """The catalogue itself."""
    return catalogue(spark).select("id", "tier", "weight", F.size("patterns").alias("n_patterns"))


@query
def tell_quoted_suppressed(spark, d):
    """Signals of the catalogue outside quotations."""
    segs = plan.detected(seeded(spark, d), detectors=["tells"])
    return plan.signals(segs).select("doc_id", "seg_idx", "name", "weight", "start", "end")


#: A catalogue of one's own: words, alternatives, optional parts, and one without a literal that could be looked for.
OWN_RULES = (
    Rule("endings", "W", "words of one ending", (r"[a-z]{2,}(tion|ment)[ .,]", r"hat[a-z]*ing")),
    Rule("begins", "S", "words of one beginning", (r" (ver|ent|pre)[a-z]{4,}", r"under(stand|go)(ing)?")),
    Rule("pairs", "E", "two words in a row", (r"the [a-z]+ (of|and) ", r"plan: you")),
    Rule("names", "W", "words that carry a name", (r"(lorem|ipsum|delve|robust|tapestry)", r"great question[, ]")),
    Rule("short", "S", "no literal to look for", (r" [xyz][aeiou] ",), 0.2),
)


@query
def own_rules(spark, d):
    """Matches of a catalogue of one's own."""
    rows = _segs(spark, d).select("doc_id", "seg_idx", "start", F.explode(tell_matches(F.col("quote"), OWN_RULES)).alias("m"))
    return rows.select("doc_id", "seg_idx", F.col("m.rule").alias("rule"), F.col("m.weight").alias("weight"), (F.col("start") + F.col("m.start")).alias("start"), (F.col("start") + F.col("m.end")).alias("end"), "m.matched")


@query
def quoted_ranges(spark, d):
    rows = _segs(spark, d).select("doc_id", "seg_idx", "start", F.explode(matches(F.col("quote"), QUOTED)).alias("m"))
    return rows.select("doc_id", "seg_idx", (F.col("start") + F.col("m.start")).alias("start"), (F.col("start") + F.col("m.end")).alias("end"))


@query
def markup_segments(spark, d):
    return _segs(spark, d).select("doc_id", "seg_idx", is_markup(F.col("quote")).alias("markup"))


@query
def forensic_signals(spark, d):
    """Traces of typing and pasting."""
    rows = _segs(spark, d).select("doc_id", "seg_idx", F.explode(forensic(F.col("quote"), F.col("start"))).alias("s"))
    return rows.select("doc_id", "seg_idx", "s.name", "s.direction", "s.weight", "s.start", "s.end")


@query
def rhetoric_signals(spark, d):
    """Sentence shapes."""
    rows = _segs(spark, d).select("doc_id", "seg_idx", F.explode(rhetoric(F.col("quote"), F.col("start"))).alias("s"))
    return rows.select("doc_id", "seg_idx", "s.name", "s.direction", "s.weight", "s.start", "s.end")


@query
def rhythm_spread(spark, d):
    """Spread of sentence lengths."""
    rows = _segs(spark, d).withColumn("r", rhythm_cv(F.col("quote")))
    return rows.select("doc_id", "seg_idx", F.col("r.n").alias("n"), F.bround("r.cv", 3).alias("cv"))


@query
def signals_all(spark, d):
    """All signals of the default detectors."""
    return plan.signals(plan.detected(seeded(spark, d))).select("doc_id", "seg_idx", "nth", "name", "direction", "weight", "detector", "start", "end")


@query
def artifact_values(spark, d):
    """Characters that are seldom typed, by their code points."""
    return plan.signals(plan.detected(seeded(spark, d), detectors=["forensic"])).where("name = 'unicode-artifact'").select("doc_id", "start", "value")


@query
def score_blind(spark, d):
    """Segments scored whatever their length."""
    return plan.gauge(seeded(spark, d), aggregate="aggregate").select("doc_id", "seg_idx", "n_signals", "lean", "strength", "label")


@query
def score_density(spark, d):
    """Segments scored for their length."""
    return plan.gauge(seeded(spark, d)).select("doc_id", "seg_idx", "n_signals", "lean", "strength", "label")


@query
def score_sentences(spark, d):
    """Sentences scored."""
    return plan.gauge(seeded(spark, d), "sentence").select("doc_id", "seg_idx", "n_signals", "lean", "strength", "label")


@query
def score_custom(spark, d):
    """A score of one's own: blind to length below 2,000 code points."""
    own = lambda signals, n: F.when(n < 2000, blind(signals)).otherwise(density(signals, n))
    return plan.gauge(seeded(spark, d), aggregate=own).select("doc_id", "seg_idx", "lean", "strength", "label")


def _long_words(text, span):
    """A detector as a plain Python function: words of twelve small letters or more."""
    for m in re.finditer("[a-z]{12,}", text[span.start : span.end]):
        yield {"name": "long-word", "direction": "machine", "weight": 0.3, "detector": "long", "start": span.start + m.start(), "end": span.start + m.end()}


def _cries(text, span):
    """One that sees all of the text: each segment of a text with an exclamation mark."""
    if "!" in text:
        yield {"name": "cries", "direction": "human", "weight": 0.2, "detector": "cries"}


def _lines(text):
    """A segmenter as one: lines that are not empty."""
    at = 0
    for line in text.split("\n"):
        if line:
            yield at, at + len(line)
        at += len(line) + 1


@query
def python_detector(spark, d):
    """Paragraphs scored by plain Python detectors beside one of columns."""
    return plan.gauge(seeded(spark, d), "paragraph", ["forensic", PlainDetector(_long_words), PlainDetector(_cries)]).select("doc_id", "seg_idx", "n_signals", "lean", "strength", "label")


@query
def python_segmenter(spark, d):
    """Signals of plain Python detectors in the segments of a plain Python segmenter."""
    segs = plan.detected(seeded(spark, d), PlainSegmenter(_lines), [PlainDetector(_long_words), PlainDetector(_cries)])
    return plan.signals(segs).select("doc_id", "seg_idx", "nth", "name", "start", "end", "matched")


@query
def python_verdicts(spark, d):
    """Verdicts by all three kinds of plain Python functions."""
    share = lambda signals, n_chars: (1.0, 1.0, "leans-machine") if 100 * sum(s.weight for s in signals if s.direction == "machine") > n_chars else (0.0, 0.0, "no-evidence")
    return plan.verdicts(seeded(spark, d), PlainSegmenter(_lines), [PlainDetector(_long_words)], PlainAggregate(share, "share")).select("doc_id", "n_segments", "n_signals", "lean", "label", "calibration")


@query
def label_counts(spark, d):
    return plan.gauge(seeded(spark, d)).groupBy("label").agg(F.count("*").alias("n"))


@query
def rollup_document(spark, d):
    """Verdicts on documents."""
    return plan.verdicts(seeded(spark, d)).select("doc_id", "n_chars", "n_segments", "n_signals", "lean", "strength", "label")


@query
def report_flat(spark, d):
    """Flat reports."""
    return plan.verdicts(seeded(spark, d))


@query
def weight_by_direction(spark, d):
    rows = plan.signals(plan.detected(seeded(spark, d)))
    return rows.groupBy("doc_id", "direction").agg(F.sum(F.col("weight").cast("decimal(9,4)")).cast("double").alias("weight"))


@query
def ranked_flags(spark, d):
    """The three heaviest signals of each document."""
    ranked = placement.ranked(plan.signals(plan.detected(seeded(spark, d))))
    return ranked.where("rank <= 3").select("doc_id", "rank", "name", "weight", "start")


@query
def listed_flags(spark, d):
    """Each document's first signal of the list that puts people's side first."""
    return placement.listed(plan.signals(plan.detected(seeded(spark, d)))).where("rank = 1").select("doc_id", "name", "direction", "weight")


@query
def greedy_placement(spark, d):
    """Signals that are drawn as marks."""
    segs = plan.gauge(seeded(spark, d))
    rows = segs.select("doc_id", "seg_idx", F.posexplode_outer(placement.placed(F.col("signals"), F.col("start"))).alias("nth", "s")).where("nth is not null")
    return rows.select("doc_id", "seg_idx", "s.name", "s.start", "s.end", placement.shade(F.col("s.weight"), F.col("s.direction")).alias("shade"), placement.bar_width(F.col("s.weight")).alias("width"))


def _judgments(spark, d):
    """Four readers: one flags the first 20 code points, one quotes the 10 from the 6th on and flags 5, one flags 30 and quotes what is nowhere, one flags nothing."""
    docs = seeded(spark, d)
    none = F.lit(None)
    row = lambda reader, direction, quote, a, b, name, weight: F.struct(F.lit(reader).alias("reader"), F.lit(direction).cast("string").alias("direction"), quote.cast("string").alias("quote"), a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(name).cast("string").alias("name"), F.lit(weight).cast("double").alias("weight"), none.cast("string").alias("note"), none.cast("string").alias("detector"), none.cast("string").alias("value"))
    rows = F.array(
        row("a", "machine", none, F.lit(0), F.lit(20), "opening", 0.5),
        row("b", "machine", F.substring("text", 6, 10), none, none, "middle", 0.3),
        row("b", "human", none, F.lit(0), F.lit(5), "warm", 0.4),
        row("c", "human", none, F.lit(0), F.lit(30), "whole", 0.2),
        row("c", "machine", F.lit("no such words"), none, none, "gone", 0.9),
        row("d", None, none, none, none, None, None),
    )
    return docs.select("doc_id", F.explode(rows).alias("j")).select("doc_id", "j.*")


@query
def judgment_records(spark, d):
    """Judgments parsed from JSON: a bare list, one in an envelope, or a reader who flags nothing, by turns."""
    one = lambda k: F.format_string('{"direction":"human","quote":"q%s","value":{"n":%s}}', F.col("doc_id"), F.lit(k))
    json = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("["), one(1), F.lit(","), one(2), F.lit("]"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit('{"findings":['), one(1), F.lit("]}"))).otherwise('{"judgments":[]}')
    return parsed_judgments(_docs(spark, d).select("doc_id", F.lit("a").alias("reader"), json.alias("json"))).select("doc_id", "reader", "direction", "quote", "value")


@query
def anchor_quotes(spark, d):
    """Where judgments stand."""
    return readers.anchored(seeded(spark, d), _judgments(spark, d)).select("doc_id", "reader", "name", "start", "end", "dropped")


@query
def reader_counts(spark, d):
    return readers.reader_counts(seeded(spark, d), _judgments(spark, d))


@query
def consensus_units(spark, d):
    """Sentences that two readers flag."""
    out = readers.consensus_units(seeded(spark, d), _judgments(spark, d), 2)
    return out.select("doc_id", "unit", "direction", "start", "end", F.array_join("readers", ",").alias("readers"), F.array_join("shapes", ",").alias("shapes"), "weight")


@query
def consensus_listing(spark, d):
    """The same in the order of a list."""
    return readers.listing(readers.consensus_units(seeded(spark, d), _judgments(spark, d), 2)).select("doc_id", "rank", "direction", "unit", "start")


@query
def consensus_density(spark, d):
    return readers.consensus(seeded(spark, d), _judgments(spark, d), 2)


@query
def pooled_baseline(spark, d):
    """All texts' consensus pooled by words."""
    out = readers.pooled(readers.consensus(seeded(spark, d), _judgments(spark, d), 2))
    return out.withColumn("n_readers", F.array_join(F.transform("n_readers", lambda x: x.cast("string")), ","))


@query
def baseline_caveats(spark, d):
    """Readings at k = 1 beside a baseline at k = 2."""
    docs, own = seeded(spark, d), _judgments(spark, d)
    base = readers.pooled(readers.consensus(docs, own.where("reader <> 'c'"), 2))
    out = readers.compared(readers.consensus(docs, own, 1), base)
    return out.select("doc_id", "machine", "base_machine", F.size("caveats").alias("n_caveats"))


@query
def baseline_lines(spark, d):
    """The table of a baseline's texts, a line each."""
    _, readings = pooling.baseline(seeded(spark, d), _judgments(spark, d), 2)
    return report.baseline_rows(readings)


@query
def baseline_text(spark, d):
    """The pooled figure in words."""
    return report.baseline_told(pooling.baseline(seeded(spark, d), _judgments(spark, d), 2)[0])


@query
def inject_contains(spark, d):
    """Sentences scored with what a single reader found."""
    docs = seeded(spark, d)
    extra = readers.judgment_signals(docs, _judgments(spark, d).where("reader = 'b'"))
    return plan.gauge(docs, "sentence", extra=extra).select("doc_id", "seg_idx", "n_signals", "lean", "strength", "label")


@query
def inject_consensus(spark, d):
    """Verdicts with what two readers agree on."""
    docs, own = seeded(spark, d), _judgments(spark, d)
    judged = storage.kept(readers.judged_units(docs, own), "judged")
    n = readers.consensus(docs, own, 2, judged=judged).select("doc_id", "n_readers")
    extra = readers.consensus_signals(readers.consensus_units(docs, own, 2, judged=judged), n)
    return plan.verdicts(docs, "sentence", extra=extra).select("doc_id", "n_signals", "lean", "strength", "label")


def _truth(spark, d):
    """The passages put behind the texts count as machine-written."""
    docs, own = seeded(spark, d), _docs(spark, d).select("doc_id", F.length("text").alias("n"))
    both = docs.select("doc_id", F.length("text").alias("end")).join(own, "doc_id").where("end > n")
    return both.select("doc_id", (F.col("n") + 2).alias("start"), "end")


@query
def truth_overlap(spark, d):
    segs = plan.gauge(seeded(spark, d))
    return evaluate.fractions(segs, _truth(spark, d)).select("doc_id", "seg_idx", "covered", F.bround("fraction", 6).alias("fraction"), "side")


@query
def score_card(spark, d):
    """How the default detectors do on the passages."""
    return evaluate.score_card(plan.gauge(seeded(spark, d), "sentence"), _truth(spark, d))


@query
def score_card_ladder(spark, d):
    """The same for each detector alone, and which of them beats the first."""
    rows = evaluate.cube(plan.detected(seeded(spark, d), "sentence"), [("tells",), ("forensic",), ("rhetoric",)])
    out = evaluate.ladder(evaluate.score_card(rows, _truth(spark, d), ("rung",)), "tells")
    return out.select("rung", "signals", "machine_hits", "machine_total", "machine_flagged", "decisive", "agreements", "passes")


@query
def evidence_cube(spark, d):
    """The same for all sets of the four detectors."""
    rows = evaluate.cube(plan.detected(seeded(spark, d), "sentence"), evaluate.subsets(DEFAULT))
    out = evaluate.ladder(evaluate.score_card(rows, _truth(spark, d), ("rung",)), "tells")
    return out.select("rung", "signals", "machine_hits", "human_hits", "machine_flagged", "human_flagged", "decisive", "agreements", "passes")


@query
def band_rates(spark, d):
    """Documents and segments called machine-written, by language and in all."""
    return evaluate.band_rates(plan.judged(seeded(spark, d), keep=("lang",)), "lang")


@query
def length_buckets(spark, d):
    return evaluate.length_rates(plan.verdicts(seeded(spark, d)))


@query
def rule_accounting(spark, d):
    """Rules on the texts as they are, and with passages."""
    human = plan.signals(plan.detected(_docs(spark, d)))
    return evaluate.rule_accounting(human, plan.signals(plan.detected(seeded(spark, d))), _truth(spark, d))


@query
def rule_table(spark, d):
    """The rules in the order of what they cost on people's texts."""
    human = plan.signals(plan.detected(_docs(spark, d)))
    return evaluate.in_order(evaluate.rule_accounting(human, human, _truth(spark, d))).select("rank", "name", "detector", "direction", "human_docs", "human_hits")


@query
def detector_accounting(spark, d):
    human = plan.signals(plan.detected(_docs(spark, d)))
    return evaluate.docs_by_detector(evaluate.rule_accounting(human, human, _truth(spark, d)))


@query
def reference_sweep(spark, d):
    """Documents called machine-written at each reference length."""
    docs = seeded(spark, d)
    return evaluate.reference_sweep(plan.gauge(docs), docs.withColumn("n_chars", F.length("text")), "lang")


@query
def robust_outlier(spark, d):
    """Sentences whose words are unusually long or short for their document."""
    docs = seeded(spark, d)
    segs = segmented(docs, "sentence", context=False)
    rows = outliers.standings(segs, outliers.word_length_statistics(docs), "ratio", -1.0)
    return rows.select("doc_id", "seg_idx", "n_tokens", "n_windows", F.bround("score", 4).alias("score"), F.bround("z", 3).alias("z"), outliers.band_of(F.col("z")).alias("weight"))


@query
def curvature_outlier(spark, d):
    """The same by the other statistic, whose score is one sum over the root of another."""
    docs = seeded(spark, d)
    rows = outliers.standings(segmented(docs, "sentence", context=False), outliers.word_length_statistics(docs), "curvature", 1.0)
    return rows.select("doc_id", "seg_idx", "n_tokens", "n_windows", F.bround("score", 4).alias("score"), F.bround("z", 3).alias("z"), outliers.band_of(F.col("z")).alias("weight"))


@query
def outlier_verdicts(spark, d):
    """Verdicts with the standing of each sentence as evidence."""
    docs = seeded(spark, d)
    extra = outliers.outlier_signals(segmented(docs, "sentence", context=False), outliers.word_length_statistics(docs), "binoculars")
    return plan.verdicts(docs, "sentence", extra=extra).select("doc_id", "n_signals", "lean", "strength", "label")


@query
def model_chunks(spark, d):
    """Passes of a model with a window of 512 over each text's words."""
    n = _docs(spark, d).select("doc_id", whitespace_words(F.col("text")).alias("n"))
    return n.select("doc_id", F.explode(outliers.chunks(F.col("n"))).alias("c")).select("doc_id", "c.start", "c.end", "c.first")


@query
def model_rows(spark, d):
    """Which rows of each pass's output are used."""
    n = _docs(spark, d).select("doc_id", whitespace_words(F.col("text")).alias("n"))
    rows = n.select("doc_id", F.explode(outliers.chunks(F.col("n"))).alias("c")).select("doc_id", "c.start", outliers.scored_rows(F.col("c")).alias("r"))
    return rows.select("doc_id", "start", "r.first", "r.end")


@query
def counted_model(spark, d):
    """What a model counted from all texts thinks of each pair of words and what follows."""
    m = counted.counted(seeded(spark, d), once=True).grams
    return m.select("c1", "c2", "w", *(F.bround(c, 4).alias(c) for c in ("ll", "mean", "var", "cross")))


def _counted(spark, d, kind, sign):
    docs = seeded(spark, d)
    rows = outliers.standings(segmented(docs, "sentence", context=False), counted.statistics(docs, kind), kind, sign)
    return rows.select("doc_id", "seg_idx", "n_tokens", "n_windows", F.bround("score", 4).alias("score"), F.bround("z", 3).alias("z"), outliers.band_of(F.col("z")).alias("weight"))


@query
def counted_curvature(spark, d):
    """Sentences that a counted model finds unusually likely or unlikely for their document."""
    return _counted(spark, d, "curvature", 1.0)


@query
def counted_ratio(spark, d):
    """Sentences on which a counted pair of models agrees unusually."""
    return _counted(spark, d, "ratio", -1.0)


@query
def statistics_verdicts(spark, d):
    """Verdicts of default detectors with both detectors by statistics."""
    return plan.verdicts(seeded(spark, d), "sentence", [*DEFAULT, *BY_STATISTICS]).select("doc_id", "n_signals", "lean", "strength", "label", "detectors")


@query
def edit_invalidation(spark, d):
    """Findings after three edits of each document."""
    segs = plan.detected(seeded(spark, d))
    one = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(("seq", "start", "end", "inserted"), e))) for e in EDITS))
    changes = _docs(spark, d).select("doc_id", F.explode(one).alias("e")).select("doc_id", "e.*")
    _, sigs = edits.invalidated(segs.select("doc_id", "seg_idx", "start", "end"), plan.signals(segs).where("start is not null"), changes)
    return sigs.select("doc_id", "seg_idx", "nth", "name", "start", "end", "unverified")


def _late_events(spark, d):
    """Each document is read as it is, gets its passage, and is read again; results come late, for the old text too, and again."""
    old, new, at = F.sha2(F.col("plain"), 256), F.sha2(F.col("text"), 256), lambda m: F.lit(f"2024-01-01 00:{m:02d}:00").cast("timestamp")
    event = lambda minute, kind, ticket, digest: F.struct(F.lit(kind).alias("kind"), F.lit(ticket).cast("long").alias("ticket"), digest.alias("text_sha256"), at(minute).alias("at"), F.when(F.lit(kind) == "result", F.concat(F.lit(f"reading {ticket} of "), F.substring(digest, 1, 8))).alias("report"))
    told = [(0, "text", 1, old), (1, "result", 1, old), (2, "text", 2, new), (3, "result", 2, new), (9, "result", 3, old), (11, "result", 4, new), (12, "result", 2, new)]
    both = seeded(spark, d, keep_plain=True)
    rows = both.select("doc_id", F.explode(F.array(*(event(*x) for x in told))).alias("e")).select("doc_id", "e.*")
    return rows.where("ticket <> 4 or doc_id % 3 <> 0")


@query
def late_results(spark, d):
    """Of all results, the last asked for that is of the text as it is now."""
    results = _late_events(spark, d).where("kind = 'result'").distinct().select("doc_id", "text_sha256", "ticket", "report")
    return edits.current(results.dropDuplicates(["doc_id", "ticket"]), seeded(spark, d)).select("doc_id", "text_sha256", "ticket", "report")


@query
def late_stream(spark, d):
    """The same, from a stream of events in several triggers."""
    top = storage.folder(spark, "late")
    _late_events(spark, d).repartition(8, "doc_id", "at").write.parquet(f"{top}/events")
    events = spark.readStream.schema(late.EVENTS).option("maxFilesPerTrigger", 3).parquet(f"{top}/events")
    run = late.latest(events, delay="1 hour").writeStream.format("parquet").option("path", f"{top}/shown").option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return late.shown(spark.read.schema(late.SHOWN).parquet(f"{top}/shown"))


@query
def markdown_reports(spark, d):
    return report.to_markdown(plan.reports(seeded(spark, d)))


@query
def html_reports(spark, d):
    return report.to_html(plan.reports(seeded(spark, d)))


@query
def json_reports(spark, d):
    return report.to_json(plan.reports(seeded(spark, d)))


@query
def json_report_fields(spark, d):
    """What a JSON report says of its document, read back from the JSON."""
    j = F.col("json")
    of = lambda path, kind: F.get_json_object(j, f"$.{path}").cast(kind)
    return report.to_json(plan.reports(seeded(spark, d))).select(
        "doc_id", of("label", "string").alias("label"), of("lean", "double").alias("lean"), of("strength", "double").alias("strength"), of("n_signals", "long").alias("n_signals"),
        F.coalesce(F.json_array_length(F.get_json_object(j, "$.segments")), F.lit(0)).cast("long").alias("n_listed"), of("text_sha256", "string").alias("text_sha256"), F.sha2(F.coalesce(of("segments[0].quote", "string"), F.lit("")), 256).alias("first_hash"),
    )


@query
def saved_reports(spark, d):
    """Reports as a JSON file for each document, read back."""
    path = storage.folder(spark, "pages")
    pages.save_pages(report.to_json(plan.reports(seeded(spark, d)), keep=("label",)).withColumnRenamed("json", "page"), path, "json")
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path).where("_metadata.file_name <> '_summary.json'")
    of = lambda field, kind: F.get_json_object("value", f"$.{field}").cast(kind).alias(field)
    return files.select(F.regexp_extract("_metadata.file_name", r"^(\d+)\.json$", 1).cast("long").alias("doc_id"), of("label", "string"), of("n_signals", "long"), of("n_segments", "long"), of("text_sha256", "string"))


@query
def reader_reports(spark, d):
    """Markdown of each document's readers beside the baseline of all."""
    docs, own = seeded(spark, d), _judgments(spark, d)
    readings = readers.consensus(docs, own, 2)
    return report.readers_section(readers.compared(readings, readers.pooled(readings)), readers.reader_counts(docs, own), True)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from .oracles import oracle_sql as all_

    return all_()

