"""Token statistics from language models that Spark counts: a performer of three words and its observer of two.

A model interpolates counts with the next shorter context, by Witten-Bell
weights: P(w | c) = (n(c, w) + t(c) P'(w | c')) / (n(c) + t(c)), where t(c)
is how many different words follow c and P' is the model of the context c'
without its first word; single words have one added to their counts, and one
word stands for all unknown ones. What a detector needs of the whole
distribution at a place (its mean log probability and variance, and what
one model expects of another) are sums over the vocabulary, which are worked
out once for each context: over the words seen after it, as all others are
the shorter context's, scaled. So a token costs one join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, matches
from ..storage import dropped, kept

#: Words, and all signs but white space one by one. The flags keep Java's classes as they are.
TOKENS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x09-\x0D\x20]"
GRAM = ("c1", "c2", "w")


@dataclass(frozen=True)
class Model:
    """Counted texts: ``words`` (w, p1), ``pairs`` (c2, w, p2), ``contexts2``, ``contexts3`` and ``grams`` (c1, c2, w, ll, mean, var, cross).

    ``vocabulary`` is a digest of the words, ``counts`` names the counting;
    ``mean`` and ``square`` are the single words' moments, ``unknown`` the
    probability of a word that was not seen.
    """

    words: DataFrame
    pairs: DataFrame
    contexts2: DataFrame
    contexts3: DataFrame
    grams: DataFrame
    pattern: str
    vocabulary: str
    counts: str
    mean: float
    square: float
    unknown: float
    order: int = 3

    def observer(self) -> Model:
        """The closely related model of one word less of context, from the same counts."""
        return replace(self, order=2)


def tokens(docs: DataFrame, pattern: str = TOKENS) -> DataFrame:
    """(doc_id, tok_idx, start, end, c1, c2, w): the words of each text with the two before; empty ones stand in front of a text. Null texts have none."""
    def placed(found: Column) -> Column:
        word = lambda i: F.coalesce(F.get(found, i)["matched"], F.lit(""))
        return F.transform(found, lambda m, i: F.struct(i.alias("tok_idx"), m["start"].alias("start"), m["end"].alias("end"), word(i - 2).alias("c1"), word(i - 1).alias("c2"), m["matched"].alias("w")))

    return docs.select("doc_id", F.explode(let(matches(F.col("text"), pattern, ""), placed)).alias("t")).select("doc_id", "t.*")


def _shifted(beta: Column, mean: Column, square: Column) -> tuple[Column, Column]:
    """Moments of a distribution scaled by beta: sums of q log q and q log^2 q for q = beta p."""
    log = F.log(beta)
    return beta * (log + mean), beta * (log * log + 2 * log * mean + square)


def _weighed(grams: DataFrame, context: list[str], shorter: str) -> DataFrame:
    """``grams`` with n and t of their context, ``p`` and what it would be were the word not seen there (``q``)."""
    sums = grams.groupBy(*context).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return _interpolated(grams.join(sums, context), shorter)


def _interpolated(grams: DataFrame, shorter: str) -> DataFrame:
    beta = F.col("kinds") / (F.col("total") + F.col("kinds"))
    return grams.withColumn("beta", beta).withColumn("q", F.col("beta") * F.col(shorter)).withColumn("p", F.col("n") / (F.col("total") + F.col("kinds")) + F.col("q"))


def counted(docs: DataFrame, pattern: str = TOKENS, once: bool = False) -> Model:
    """The model of all texts of (doc_id, text). An empty table gives a model in which every word is unknown.

    Counts are summed in tasks before they are shuffled; words that follow
    many are hot keys in joins only, which Spark splits. What a context of two
    words expects is summed where its words are weighed, so words in such
    contexts are moved twice and written as counts only. ``once`` says that
    ``grams`` is read once: it is then not written at all. Tables are written
    to the shared folder and deleted when nothing reads them any more; a row
    of sums comes to the driver.
    """
    triples = kept(tokens(docs, pattern).groupBy(*GRAM).agg(F.count("*").alias("n")), "triples")
    doubles = kept(triples.groupBy("c2", "w").agg(F.sum("n").alias("n")), "doubles")
    singles = kept(doubles.groupBy("w").agg(F.sum("n").alias("n")), "singles")
    n, v, digest = singles.agg(F.sum("n"), F.count("*"), F.sum(F.xxhash64("w").cast("decimal(38,0)"))).first()
    unknown = 1.0 / ((n or 0) + v + 1)
    words = singles.select("w", ((F.col("n") + 1) * unknown).alias("p1"))
    log = F.log("p1")
    mean, square = words.agg(F.sum(F.col("p1") * log), F.sum(F.col("p1") * log * log)).first()
    mean, square = (mean or 0.0) + unknown * math.log(unknown), (square or 0.0) + unknown * math.log(unknown) ** 2

    p, q = F.col("p"), F.col("q")
    gain = lambda power: p * F.pow(F.log(p), F.lit(power)) - q * F.pow(F.log(q), F.lit(power))
    double = _weighed(doubles.join(words, "w"), ["c2"], "p1")
    rest = _shifted(F.col("beta"), F.lit(mean), F.lit(square))
    contexts2 = kept(double.groupBy("c2").agg(F.max("beta").alias("beta"), F.sum(gain(1)).alias("g1"), F.sum(gain(2)).alias("g2")).select("c2", F.col("beta").alias("beta2"), (F.col("g1") + rest[0]).alias("mean2"), (F.col("g2") + rest[1]).alias("square2")), "contexts")
    pairs = kept(double.select("c2", "w", F.col("p").alias("p2")).join(contexts2, "c2").sortWithinPartitions("c2").select("c2", "w", "p2", "mean2", "square2"), "pairs")
    dropped(doubles)

    context = Window.partitionBy("c1", "c2")
    over = lambda x: F.sum(x).over(context)
    triple = triples.join(pairs, ["c2", "w"]).withColumns({"total": over(F.col("n")), "kinds": F.count("*").over(context)})
    triple = _interpolated(triple, "p2").withColumns({"g1": over(gain(1)), "g2": over(gain(2)), "x": over(F.col("p2") * (F.log(p) - F.log(q)))})
    rest = _shifted(F.col("beta"), F.col("mean2"), F.col("square2"))
    moments = triple.select(*GRAM, F.log("p").alias("ll"), F.col("beta").alias("beta3"), (F.col("g1") + rest[0]).alias("mean"), (F.col("g2") + rest[1]).alias("square"), (-(F.col("x") + F.log("beta") + F.col("mean2"))).alias("cross"))
    rows = moments.select(*GRAM, "ll", "beta3", "mean", F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)).alias("var"), "cross")
    if not once:
        rows = kept(rows, "grams")
        dropped(triples)
    contexts3 = rows.groupBy("c1", "c2").agg(*(F.first(c).alias(c) for c in ("beta3", "mean", "var", "cross")))
    return Model(words, pairs.select("c2", "w", "p2"), contexts2, contexts3, rows.select(*GRAM, "ll", "mean", "var", "cross"), pattern, f"{v}:{digest}", f"{n}:{v}:{digest}:{pattern}", mean, square, unknown)


def looked_up(grams: DataFrame, model: Model) -> DataFrame:
    """(c1, c2, w, ll, mean, var, cross) of any words in any contexts, seen or not: an unseen context is the shorter one's."""
    both = grams.select(*GRAM).join(model.grams, list(GRAM), "left_anti").join(model.words, "w", "left").join(model.pairs, ["c2", "w"], "left").join(model.contexts2, "c2", "left").join(model.contexts3, ["c1", "c2"], "left")
    p1 = F.coalesce("p1", F.lit(model.unknown))
    p2 = F.coalesce(F.col("p2"), F.coalesce("beta2", F.lit(1.0)) * p1)
    mean2, square2 = F.coalesce("mean2", F.lit(model.mean)), F.coalesce("square2", F.lit(model.square))
    unseen = both.select(*GRAM, F.log(F.coalesce("beta3", F.lit(1.0)) * p2).alias("ll"), F.coalesce("mean", mean2).alias("mean"), F.coalesce("var", F.greatest(square2 - mean2 * mean2, F.lit(0.0))).alias("var"), F.coalesce("cross", -mean2).alias("cross"))
    return model.grams.unionByName(unseen)


def _rows(docs: DataFrame, model: Model, a: Column, b: Column, among: bool) -> DataFrame:
    words = tokens(docs, model.pattern)
    known = model.grams if among else looked_up(kept(words.select(*GRAM).distinct(), "asked"), model)
    first = F.col("tok_idx") == 0
    zero = lambda x: F.when(first, 0.0).otherwise(x)
    return words.join(known, list(GRAM)).select("doc_id", "tok_idx", "start", "end", zero(a).alias("a"), zero(b).alias("b"))


def curvature(docs: DataFrame, model: Model, among: bool = False) -> DataFrame:
    """(doc_id, tok_idx, start, end, a, b): by how much a token's log probability is above what the model expects there, and the variance of that.

    A text's first token has no prediction, and both numbers 0. ``among``
    says that the documents are among those that were counted.
    """
    return _rows(docs, model, F.col("ll") - F.col("mean"), F.col("var"), among)


def cross_perplexity(docs: DataFrame, observer: Model, performer: Model, among: bool = False) -> DataFrame:
    """(doc_id, tok_idx, start, end, a, b): the performer's surprise at a token, and at what the observer expects there.

    The two must know the same words, else it has no meaning, and be of the
    same counts, the observer with one word less of context.
    """
    if observer.vocabulary != performer.vocabulary or observer.pattern != performer.pattern:
        raise ValueError("observer and performer have different vocabularies")
    if observer.counts != performer.counts or (observer.order, performer.order) != (2, 3):
        raise ValueError("the observer must be the performer's own, of one word less: performer.observer()")
    return _rows(docs, performer, -F.col("ll"), F.col("cross"), among)


def statistics(docs: DataFrame, kind: str, model: Model | None = None, among: bool = False) -> DataFrame:
    """Token statistics of ``kind`` (curvature or ratio) by ``model``, or by one counted from the documents themselves."""
    own, among = model or counted(docs, once=True), among or model is None
    return curvature(docs, own, among) if kind == "curvature" else cross_perplexity(docs, own.observer(), own, among)
