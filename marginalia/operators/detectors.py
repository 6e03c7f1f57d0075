"""Detectors: from a segment's text to signals, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BLANK, hits, json_value, let, matches, placed_hits, plain_words
from ..schema import SIGNAL, SIGNALS
from .plain import PlainDetector, plain_signals
from .rules import METRICS, RULES, Rule, tell_matches

#: A segment's text and start to an array of signals.
Detector = Callable[[Column, Column], Column]

# Quoted stretches, markup at a segment's start, and openers in the order of the test.
QUOTED = r'`[^`\n]+`|"[^"\n]{0,200}"|[“][^”\n]{0,200}[”]'
MARKUP = r"(?dU)^\s*(?:#{1,6}\s|[-*+]\s|\d+[.)]\s|\||>\s|```|~~~|\[[^\]]+\]:|[-=]{3,}\s*$)"
OPENERS = ("however", "moreover", "furthermore", "additionally", "that said", "at the same time", "in addition", "importantly", "ultimately", "crucially", "notably", "overall")
ARTIFACTS = "[\u00a0\u202f\u2192\u2713\u2705\u274c]"


# Names, directions, weights and patterns of the traces, and the last signs that close a sentence.
TRACES = (("em-dash", "machine", 0.12, "—"), ("trailing-whitespace", "human", 0.25, r"(?md)[ \t]+$"), ("mid-sentence-newline", "human", 0.45, r"[a-z,;]\n[a-z]"), ("unicode-artifact", "machine", 0.15, ARTIFACTS))
MIXED_APOSTROPHES, NO_TERMINAL = ("mixed-apostrophes", "human", 0.35), ("no-terminal-punctuation", "human", 0.30)
CLOSERS, LEAST_WORDS = ".!?:;)]\"'’”", 4
# Names, weights and patterns of the sentence shapes, and the weight of an opener.
SHAPES = (
    ("not-x-but-y", 0.30, r"(?idU)\bnot (?:just|merely|simply) [^,.;:]{2,45},? but\b"),
    ("colon-tricolon", 0.45, r"(?dU):\s*[^,.:;]{4,90},\s*[^,.:;]{4,90},\s*and\s+[^.]{4,90}[.!?]"),
    ("concede-pivot", 0.35, r"(?idU)\bi (?:do |really do |genuinely )?(?:value|appreciate|respect|understand)\b[^.]{0,80}\.\s*(?:at the same time|that said|however|but)\b"),
)
OPENER = ("discourse-opener", 0.20)
# Names, directions and the weight of the two kinds of rhythm.
FLAT, LIVELY, RHYTHM_WEIGHT = ("low-burstiness", "machine"), ("high-burstiness", "human"), 0.25


def _signal(name: str | Column, direction: str | Column, weight: float | Column, detector: str, note: str | Column, seg: Column, value: Column | None = None, m: Column | None = None, start: Column | None = None, end: Column | None = None, matched: Column | None = None, longer: Column | None = None, order: Column | None = None) -> Column:
    """One signal; with a match ``m`` (or start and end) in the segment it has a place, else the segment's start orders it."""
    text = lambda x: F.lit(x) if isinstance(x, (str, float)) else x
    a, b, s = (m["start"], m["end"], m["matched"]) if m is not None else (start, end, matched)
    none = F.lit(None)
    placed = a is not None
    return F.struct(
        ((seg + a) if placed else seg).cast("int").alias("at"), text(name).alias("name"), F.lit(0).alias("d"), (longer if longer is not None else F.lit(0)).cast("int").alias("longer"), (order if order is not None else F.lit(0)).cast("int").alias("ord"),
        text(direction).alias("direction"), text(weight).cast("double").alias("weight"), F.lit(detector).alias("detector"), (value if value is not None else none).cast("string").alias("value"), text(note).alias("note"),
        ((seg + a) if placed else none).cast("int").alias("start"), ((seg + b) if placed else none).cast("int").alias("end"), (s if placed else none).cast("string").alias("matched"), F.lit("token" if placed else None).cast("string").alias("level"),
    ).cast(SIGNAL)


def _if(condition: Column, signal: Column) -> Column:
    return F.when(condition, F.array(signal)).otherwise(F.array()).cast(SIGNALS)


def _each(found: Column, make: Callable[[Column], Column]) -> Column:
    return F.transform(found, make).cast(SIGNALS)


def quoted(text: Column) -> Column:
    """Stretches in code or quotation marks."""
    return matches(text, QUOTED)


def is_markup(text: Column) -> Column:
    """Whether a segment is structure, not prose: a heading, list, table, quote, fence, link target or rule."""
    return text.rlike(MARKUP) | text.contains("```")


def tells(text: Column, start: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The catalogue's phrases, save those that begin in a quotation."""
    def own(found: Column) -> Column:
        spoken = F.when(F.size(found) > 0, quoted(text)).otherwise(F.array().cast("array<struct<start:int,end:int,matched:string>>"))
        free = let(spoken, lambda q: F.filter(found, lambda m: ~F.exists(q, lambda r: (r["start"] <= m["start"]) & (m["start"] < r["end"]))))
        return _each(free, lambda m: _signal(m["rule"], "machine", m["weight"], "tells", F.concat(F.lit("tier "), m["tier"], F.lit(": "), m["message"]), start, json_value(m["matched"]), m, longer=m["longer"], order=m["ord"]))

    return let(tell_matches(text, rules), own)



def forensic(text: Column, start: Column) -> Column:
    """Traces of keyboards, editors and paste buffers; several speak for a person."""
    has, prose = text.contains, ~is_markup(text)
    blank_end = has(" \n") | has("\t\n") | text.endswith(" ") | text.endswith("\t")
    odd = F.lit(False)
    for c in ARTIFACTS[1:-1]:
        odd = odd | has(c)
    tests = (has("—"), blank_end, has("\n") & prose, odd)
    found = placed_hits(hits(text, [(k, trace[3], test) for k, (trace, test) in enumerate(zip(TRACES, tests))]))
    notes = ("a long dash, which models use freely", "blanks at the end of a line, as typing leaves them", "the line breaks inside a sentence, as pasted text does", "a character that is seldom typed")
    facts = F.expr("array(" + ", ".join(f"named_struct('n', '{n}', 'd', '{d}', 'w', {w!r}D, 'note', '{note}')" for (n, d, w, _), note in zip(TRACES, notes)) + ")")
    code = lambda m: F.format_string("U+%04X", F.ascii(m["matched"]))
    value = lambda m: F.when(m["ord"] == 0, json_value(m["matched"])).when(m["ord"] == 3, json_value(code(m))).otherwise("true")
    placed = _each(found, lambda m: let(F.element_at(facts, m["ord"] + 1), lambda f: _signal(f["n"], f["d"], f["w"], "forensic", f["note"], start, value(m), m)))
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    mixed = _if(has("'") & has("’"), _signal(*MIXED_APOSTROPHES, "forensic", F.format_string("%s straight apostrophes beside %s curly ones, as in text put together by hand", count("'"), count("’")), start, F.format_string("[%s,%s]", count("'"), count("’"))))
    last = F.substring(F.rtrim(text, F.lit(BLANK)), -1, 1)
    unclosed = _if(~last.isin(*CLOSERS) & prose & (plain_words(text) >= LEAST_WORDS), _signal(*NO_TERMINAL, "forensic", "stops without a closing sign, where a model would have put one", start, F.lit("true")))
    return F.concat(placed, mixed, unclosed).cast(SIGNALS)


def rhetoric(text: Column, start: Column) -> Column:
    """Sentence shapes that hold up when a model avoids its pet words."""
    low = F.lower(text)
    grants = low.contains("value") | low.contains("appreciate") | low.contains("respect") | low.contains("understand") | text.rlike("[ſKİı]")
    found = placed_hits(hits(text, [(k, shape[2], test) for k, (shape, test) in enumerate(zip(SHAPES, (low.contains(" but"), text.contains(":"), grants)))]))
    notes = ("sets one thing aside to raise another", "a colon and then three matching parts", "grants a point and turns at once")
    facts = F.expr("array(" + ", ".join(f"named_struct('n', '{n}', 'w', {w!r}D, 'note', '{note}')" for (n, w, _), note in zip(SHAPES, notes)) + ")")
    value = lambda m: json_value(F.when(m["ord"] == 0, F.btrim(m["matched"])).when(m["ord"] == 1, F.substring(m["matched"], 1, 70)).otherwise(F.substring(F.lower(m["matched"]), 1, 70)))
    shapes = _each(found, lambda m: let(F.element_at(facts, m["ord"] + 1), lambda f: _signal(f["n"], "machine", f["w"], "rhetoric", f["note"], start, value(m), m)))
    opener = F.coalesce(*(F.when(low.startswith(o), F.lit(o)) for o in OPENERS))
    opens = let(opener, lambda o: _if(o.isNotNull(), _signal(OPENER[0], "machine", OPENER[1], "rhetoric", F.concat(F.lit("begins with the connective "), o), start, json_value(o), start=F.lit(0), end=F.length(o), matched=F.substring(text, F.lit(1), F.length(o)))))
    return F.concat(shapes, opens).cast(SIGNALS)


def rhythm_cv(text: Column) -> Column:
    """(n, cv): sentences of three words or more, and the spread of their lengths over the mean; whole numbers until the last step."""
    pieces = F.split(text, r"[.!?\n]", -1)
    lengths = F.filter(F.transform(pieces, plain_words), lambda n: n >= 3)
    total = lambda ns, f: F.aggregate(ns, F.lit(0).cast("long"), lambda a, n: a + f(n.cast("long")))
    return let(lengths, lambda ns: F.struct(F.size(ns).alias("n"), F.when(F.size(ns) > 0, F.sqrt(F.size(ns) * total(ns, lambda n: n * n) - total(ns, lambda n: n) * total(ns, lambda n: n)) / total(ns, lambda n: n)).alias("cv")))


def rhythm(text: Column, start: Column, metrics: Mapping[str, float] = METRICS) -> Column:
    """How much sentence lengths vary, where there are enough of them by a catalogue's metrics."""
    low = metrics["sentence_len_cv_min"]

    def judged(r: Column) -> Column:
        shown = F.bround(r["cv"], 3)
        own = lambda kind, note: _signal(*kind, RHYTHM_WEIGHT, "rhythm", F.format_string(note, shown), start, shown)
        enough = r["n"] >= metrics["min_sentences_for_rhythm"]
        flat, lively = own(FLAT, "sentences of much the same length (spread %s of the mean)"), own(LIVELY, "sentences of uneven length (spread %s of the mean)")
        return F.when(enough & (r["cv"] < low), F.array(flat)).when(enough & (r["cv"] > 2 * low), F.array(lively)).otherwise(F.array()).cast(SIGNALS)

    return let(rhythm_cv(text), judged)


DETECTORS: dict[str, Detector] = {"tells": tells, "forensic": forensic, "rhetoric": rhetoric, "rhythm": rhythm}
DEFAULT = ("tells", "forensic", "rhetoric", "rhythm")
#: Detectors that need token statistics; operators.outliers has them.
BY_STATISTICS = ("fast-detect-gpt", "binoculars")
_ABOUT = {"tells": "phrases of the catalogue, outside quotations", "forensic": "traces of typing, pasting and typesetting", "rhetoric": "shapes of sentences", "rhythm": "how much sentence lengths vary", "fast-detect-gpt": "stretches that a language model finds unusually likely or unlikely", "binoculars": "stretches on which two language models agree unusually"}


def detectors_of(chosen: Sequence[str | Detector | PlainDetector] | None) -> tuple[list[Detector | PlainDetector], tuple[str, ...]]:
    """Detectors and their names, in order; None stands for the four defaults.

    A function of a segment's text and start that returns signals is named
    after itself. The two detectors by statistics are tables, not columns:
    ``plans.gauge`` adds them, and here they are an error.
    """
    functions, names = [], []
    for x in DEFAULT if chosen is None else chosen:
        if callable(x) or isinstance(x, PlainDetector):
            functions.append(x)
            names.append(getattr(x, "__name__", "custom"))
        elif x in DETECTORS:
            functions.append(DETECTORS[x])
            names.append(x)
        elif x in BY_STATISTICS:
            raise KeyError(f"{x} needs token statistics: see operators.outliers")
        else:
            raise KeyError(f"unknown detector {x!r}; known: {sorted([*DETECTORS, *BY_STATISTICS])}")
    return functions, tuple(names)


def by_statistics(chosen: Sequence[str | Detector] | None) -> tuple[list[str | Detector] | None, list[str]]:
    """The detectors that are columns, and the names of those that need token statistics."""
    if chosen is None:
        return None, []
    return [x for x in chosen if not isinstance(x, str) or x not in BY_STATISTICS], [x for x in chosen if isinstance(x, str) and x in BY_STATISTICS]


def plain_of(chosen: Sequence[str | Detector | PlainDetector] | None) -> Callable[[Column, Column], Column] | None:
    """What plain Python detectors among the chosen ones find in a text's array of spans, an array of signals for each; None if there are none."""
    own = [(d, f) for d, f in enumerate(detectors_of(chosen)[0]) if isinstance(f, PlainDetector)]
    return plain_signals(own) if own else None


def signals_of(text: Column, start: Column, chosen: Sequence[str | Detector | PlainDetector] | None = None, plain: Column | None = None) -> Column:
    """All signals of a segment, in the order of start, name and detector; ``plain`` has those of plain Python detectors."""
    functions, _ = detectors_of(chosen)
    found = [F.transform(f(text, start).cast(SIGNALS), _numbered(d)) for d, f in enumerate(functions) if not isinstance(f, PlainDetector)]
    found += [] if plain is None else [F.coalesce(plain, F.array().cast(SIGNALS))]
    return F.array_sort(F.concat(F.array().cast(SIGNALS), *found).cast(SIGNALS))


def _numbered(d: int) -> Callable[[Column], Column]:
    return lambda s: s.withField("d", F.lit(d))


def detectors(spark: SparkSession):
    """(name, about) of all detectors."""
    return spark.createDataFrame([(n, _ABOUT[n]) for n in (*DETECTORS, *BY_STATISTICS)], "name string, about string")

