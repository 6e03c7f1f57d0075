"""The catalogue of phrases that generated prose overuses, and where they stand in a text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import hits, let, placed_hits
from .gates import gated_hits, required

# What a tier weighs, what it weighs when it is unknown, and the metrics of the catalogue.
TIER_WEIGHT = {"E": 0.50, "W": 0.30, "S": 0.15}
UNKNOWN_TIER_WEIGHT = 0.15
METRICS = {"min_sentences_for_rhythm": 6, "sentence_len_cv_min": 0.35, "short_message_words": 150}
#: A full stop between two word characters of a pattern stands for an apostrophe.
APOSTROPHES = "['’ʼ]"


@dataclass(frozen=True)
class Rule:
    """A rule: patterns, a tier, and a weight of its own where the tier's doesn't fit."""

    id: str
    tier: str
    message: str
    patterns: tuple[str, ...]
    own_weight: float | None = None

    @property
    def weight(self) -> float:
        return self.own_weight if self.own_weight is not None else TIER_WEIGHT.get(self.tier, UNKNOWN_TIER_WEIGHT)


# The rules' ids, tiers and patterns.
RULES: tuple[Rule, ...] = (
    Rule("chat-leftover", "E", "a chat assistant's phrase was left in", (r"\b(certainly!|great question|i hope this helps|as an ai\b)",)),
    Rule("unfilled-placeholder", "E", "a blank that nobody filled in", (r"\[ASK:[^\]]*\]", r"\[(insert|your name|recipient|company name)[^\]]*\]", r"\{\{[^}]+\}\}")),
    Rule("cutoff-disclaimer", "E", "a model speaks of its own limits", (r"\bas of my (last|knowledge) (update|cutoff)", r"\bi (do not|don.t) have (access to )?real-time")),
    Rule("throat-clearing", "E", "announces a point before making it", (r"\bit.s (important|worth) (to note|noting)\b",)),
    Rule("summary-closer", "E", "closes by saying it all again", (r"\b(in conclusion|to sum up|in summary),",), 0.15),
    Rule(
        "ai-vocabulary",
        "W",
        "words that models reach for far more than people",
        (
            r"\b(delve[sd]?|delving|tapestry|realm|robust|seamless(ly)?|leverag(e|es|ed|ing)|vibrant|pivotal|testament to|boasts?|fosters?|underscores?|showcas(e|es|ed|ing))\b",
            r"\b(elevate[sd]?|empower(s|ed|ing)?|unlock(s|ed|ing)?|unleash(es|ed|ing)?|game-changer|cutting-edge|intricate|meticulous(ly)?)\b",
            r"\bin today.s (fast-paced|digital|ever-evolving) world\b",
            r"\b(dive deep|deep dive|at its core|the beauty of|navigate the complexities)\b",
            r"\bplays? an? (vital|key|crucial|pivotal) role\b",
        ),
    ),
    Rule("filler-adverb", "W", "a sentence starts on an adverb that adds nothing", (r"(^|[.!?]\s+)(notably|interestingly|essentially|in essence),",)),
    Rule("empty-transition", "W", "a link word where the sentences already connect", (r"(^|[.!?]\s+)(moreover|furthermore|additionally),",)),
    Rule("copula-avoidance", "W", "a roundabout way to say that something is something", (r"\b(serves|stands) as (a|an|the)\b",)),
    Rule(
        "contrastive-negation",
        "W",
        "denies one thing only to set up another",
        (
            r"\b(is|are|was|were|it.s|this is|that.s)(n.t| not) (just|merely|simply|about)\b[^.!?\n]{0,80}?(\bit.s\b|\bbut\b|—)",
            r"\bnot (just|merely|simply) [^.!?\n]{1,60}?,? but\b",
        ),
    ),
    Rule("ing-trailer", "W", "a participle trails behind to comment on the sentence", (r",\s+(highlighting|showcasing|underscoring|emphasi[sz]ing|demonstrating|reflecting|making it)\b[^.!?\n]*[.!?]",)),
    Rule("significance-inflation", "W", "claims importance in place of showing it", (r"\b(game[- ]changing|groundbreaking|revolutionary|transformative|a new era)\b",)),
    Rule("vague-attribution", "W", "leans on sources that are not named", (r"\b(experts (say|agree|believe)|studies (show|suggest)|research (shows|suggests)|many (believe|say))\b",)),
    Rule("sycophancy", "W", "flatters whoever is reading", (r"\b(what a (great|fantastic|wonderful)|brilliant (idea|question|point)|you.re absolutely right)\b",)),
    Rule("stock-pleasantry", "S", "a courtesy by rote", (r"\bi hope (this|my) (email |message |note )?finds you well\b", r"\b(happy to help|let me know if you.d like|feel free to reach out|don.t hesitate to reach out)\b")),
    Rule("rhetorical-opener", "S", "starts on a question that wants no answer", (r"\A\s*(what if|have you ever wondered|imagine)\b[^?\n]*\?",)),
    Rule("hedge-stack", "S", "one hedge on top of another", (r"\b(could|may|might) (potentially|possibly|perhaps)\b", r"\bit (seems|appears) that it (might|may|could)\b")),
    Rule("triad", "S", "three of a kind in a row", (r"\b[\w-]+, [\w-]+,? and [\w-]+\b",)),
    Rule("exclamation", "S", "an exclamation mark", (r"!(?=\s|$)",)),
)
#: What a match of a rule is.
TELLS = "array<struct<start:int,longer:int,ord:int,rule:string,tier:string,message:string,weight:double,end:int,matched:string>>"
#: Rules for which no word or sign needs to be looked for first.
_ALWAYS = {"triad", "exclamation", "unfilled-placeholder"}
#: Words (runs of a to z, lower case) of which each match of the other built-in rules has at least one.
GATE = tuple(
    "certainly question helps ai update cutoff real important worth conclusion sum summary "
    "delve delves delved delving tapestry realm robust seamless seamlessly leverage leverages leveraged leveraging vibrant pivotal testament boast boasts foster fosters underscore underscores showcase showcases showcased showcasing "
    "elevate elevates elevated empower empowers empowered empowering unlock unlocks unlocked unlocking unleash unleashes unleashed unleashing game cutting intricate meticulous meticulously "
    "today dive core beauty complexities role notably interestingly essentially essence moreover furthermore additionally serves stands "
    "just merely simply about highlighting underscoring emphasising emphasizing demonstrating reflecting making groundbreaking revolutionary transformative era "
    "experts studies research many what brilliant absolutely finds happy know reach wondered imagine potentially possibly perhaps seems appears".split()
)


def java_pattern(pattern: str) -> str:
    """The pattern with its apostrophes, any case, ``^`` and ``$`` at lines, and Unicode classes."""
    return "(?imdU)" + re.sub(r"(?<=\w)\.(?=\w)", APOSTROPHES, pattern)


def gate(text: Column) -> Column:
    """Whether a text may match a built-in rule that isn't looked for always; letters that fold to ASCII ones pass."""
    found = F.arrays_overlap(F.split(F.lower(text), "[^a-z]+"), F.array(*map(F.lit, GATE)))
    return found | text.rlike("[ſKİı]")


def _first(rule: str, pattern: str, text: Column) -> Column | None:
    """A cheap test for the rules that no word gates."""
    return {"triad": F.lower(text).contains(" and "), "exclamation": text.contains("!")}.get(rule, text.contains("[") | text.contains("{{") if rule == "unfilled-placeholder" else None)


def tell_matches(text: Column, rules: Sequence[Rule] = RULES, tiers: Iterable[str] | None = None) -> Column:
    """All matches of the rules as (start, longer, ord, rule, tier, message, weight, end, matched), sorted.

    By start, the longer first, then in the order of rules and patterns. Rules
    of other tiers than ``tiers`` are not looked for. Rules of one's own are
    gated by literals that are read from their patterns (``operators.gates``).
    """
    wanted = None if tiers is None else set(tiers)
    listed = [(r, p) for r in rules if wanted is None or r.tier in wanted for p in r.patterns]
    quick, slow, gated = [], [], []
    for k, (r, p) in enumerate(listed):
        own = r in RULES
        if not own and (literals := required(p)):
            gated.append((k, java_pattern(p), literals))
            continue
        (slow if own and r.id not in _ALWAYS else quick).append((k, java_pattern(p), _first(r.id, p, text) if own and r.id in _ALWAYS else None))
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    facts = F.expr("array(" + ", ".join(f"named_struct('rule', {quote(r.id)}, 'tier', {quote(r.tier)}, 'message', {quote(r.message)}, 'weight', {float(r.weight)!r}D)" for r, _ in listed) + ")")
    found = [hits(text, quick)] * bool(quick) + ([hits(text, slow, gate(text))] if slow else []) + ([gated_hits(text, gated)] if gated else [])
    if not found:
        return F.array().cast(TELLS)

    def row(m: Column) -> Column:
        return let(F.element_at(facts, m["ord"] + 1), lambda r: F.struct(m["start"].alias("start"), (m["start"] - m["end"]).alias("longer"), m["ord"].alias("ord"), r["rule"].alias("rule"), r["tier"].alias("tier"), r["message"].alias("message"), r["weight"].alias("weight"), m["end"].alias("end"), m["matched"].alias("matched")))

    return F.array_sort(F.transform(placed_hits(F.concat(*found)), row)).cast(TELLS)


def catalogue(spark: SparkSession, tier: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(id, tier, message, weight, patterns) of the rules, of one tier if named."""
    rows = [(r.id, r.tier, r.message, r.weight, list(r.patterns)) for r in rules]
    out = spark.createDataFrame(rows, "id string, tier string, message string, weight double, patterns array<string>")
    return out.where(F.col("tier") == tier) if tier else out
