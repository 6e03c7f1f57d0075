"""Quality rules: repetition and symbols, and perplexity bands of a Kneser-Ney model."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .shared import by_row, pieces, written

SYMBOLS = b"#*$%&|<>"
_WHITE = b" \t\n\r\x0b\x0c"
#: Bytes of a gram of the highest order; six fit a long with room.
ORDER = 5
#: Grams of a block of scores, of which a task holds one at a time, and about those of a file of blocks.
BLOCK, PART = 1 << 16, 1 << 20
#: Median deviations of a language's bits that its band reaches to each side, and the least that one counts, in bits a byte.
WIDE, LEAST_SPREAD = 8.0, 0.05
#: Parts that texts are dealt to by their digests; each is scored by the model of the others.
FOLDS = 2


def repeated(numbers: np.ndarray, window: int = 8) -> int:
    """Words in windows of ``window`` words that are found twice or more; windows are named by naming pairs of halves."""
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    names, done = numbers, 1
    while done < window:
        names = np.unique(names[:-done] * np.int64(len(numbers) + 1) + names[done:], return_inverse=True)[1]
        done *= 2
    twice = np.bincount(names)[names] > 1
    cover = np.zeros(len(numbers) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def counted(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, lines with a word equal to an earlier one, words in repeated windows); null has none."""
    text = text or ""
    raw = text.encode()
    w = raw.split()
    points = len(text) - (len(raw) - len(raw.translate(None, _WHITE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and x.strip(_WHITE)]
    names: dict[bytes, int] = {}
    numbers = np.fromiter((names.setdefault(x, len(names)) for x in w), np.int64, len(w))
    return len(w), points, symbols, len(lines) - len(set(lines)), repeated(numbers) if len(names) < len(w) - 7 or len(w) < 24 else 0


def grams(text: str, order: int = ORDER) -> np.ndarray:
    """The text's byte grams as integers, first byte highest; the text begins behind ``order - 1`` line ends."""
    b = np.frombuffer(b"\n" * (order - 1) + text.encode(), np.uint8).astype(np.int64)
    out = np.zeros(len(b) - order + 1, np.int64)
    for k in range(order):
        out = (out << 8) | b[k : len(b) - order + 1 + k]
    return out


def language_key(lang: Column) -> Column:
    """A language as a text that is never null: a null one is none of the values, ``und`` and the empty text included."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("null"))


def dealt_to_folds(docs: DataFrame) -> DataFrame:
    """(doc_id, text, lang, band, fold) of (doc_id, text, lang): the language's key, and a fold by the text, so that copies share one."""
    fold = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(FOLDS)).cast("string")
    return docs.select("doc_id", "text", "lang", language_key(F.col("lang")).alias("band"), fold.alias("fold"))


def counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often each gram of ``order`` bytes stands in all texts of (text, lang) of a language.

    Tasks count what they read, piece by piece, and a sum follows; texts that
    are null or empty have no grams. ``lang`` may not be null: see ``language_key``.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in sorted(held.items()):
                g, n = _added(parts)
                for at in range(0, len(g), 1 << 16):
                    own = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g[own]), pa.string()), pa.array(g[own]), pa.array(n[own])], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for part in pieces(batch, 4 << 20):
                by: dict[str, list] = {}
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if text:
                        by.setdefault(lang, []).append(grams(text, order))
                for lang, g in by.items():
                    g, n = np.unique(np.concatenate(g), return_counts=True)
                    own = held.setdefault(lang, [])
                    own.append((g, n))
                    size += len(g)
                    if len(own) > 8:
                        own[:] = [_added(own)]
                if sum(len(g) for parts in held.values() for g, _ in parts) > 2_000_000:
                    yield from flush()
        yield from flush()

    return docs.select("text", "lang").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    g = np.concatenate([p[0] for p in parts])
    order = np.argsort(g, kind="stable")
    g, n = g[order], np.concatenate([p[1] for p in parts])[order]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    return g[first], np.add.reduceat(n, first) if len(g) else n


def _low_bytes(gram: Column, n: int) -> Column:
    return gram.bitwiseAND(F.lit((1 << (8 * n)) - 1))


def kneser_ney(top: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, size, gram, logp, back) from the counts of the highest order: a modified Kneser-Ney model.

    A gram of ``size`` bytes has the logarithm of its last byte's probability
    behind the others, and that of the weight with which one that is not there
    falls back to a shorter one. Below the highest order a gram counts the
    distinct bytes before it. Three discounts, for counts of 1, 2 and more, come from
    the counts of counts of each language and order. All of it is grouping and
    joins by language and gram.
    """
    level, levels = top, {}
    for k in range(order, 0, -1):
        levels[k] = level.select("lang", "gram", F.col("n").cast("double").alias("n"))
        if k > 1:
            level = level.groupBy("lang", _low_bytes(F.col("gram"), k - 1).alias("gram")).agg(F.count("*").alias("n"))
    below, out = None, None
    for k in range(1, order + 1):
        t = levels[k]
        seen = [F.coalesce(F.count_if(F.col("n") == c), F.lit(0)).cast("double").alias(f"n{c}") for c in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        ratio = lambda a, b: F.when(F.col(a) > 0, F.col(b) / F.col(a)).otherwise(0.0)
        part = lambda c, v: F.when(F.col("n1") > 0, F.greatest(F.lit(0.05), F.least(F.lit(c - 0.05), v))).otherwise(0.5)
        cuts = t.groupBy("lang").agg(*seen).select("lang", part(1, 1 - 2 * y * ratio("n1", "n2")).alias("d1"), part(2, 2 - 3 * y * ratio("n2", "n3")).alias("d2"), part(3, 3 - 4 * y * ratio("n3", "n4")).alias("d3"))
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.join(F.broadcast(cuts), "lang").withColumn("cut", cut).withColumn("behind", F.shiftright("gram", 8))
        context = Window.partitionBy("lang", "behind")
        t = t.withColumn("total", F.sum("n").over(context)).withColumn("free", F.sum("cut").over(context) / F.col("total"))
        t = t.withColumn("own", (F.col("n") - F.col("cut")) / F.col("total"))
        if below is None:
            t = t.withColumn("p", F.col("own") + F.col("free") / 256.0)
        else:
            lower = below.select("lang", F.col("gram").alias("short"), F.col("p").alias("low"))
            t = t.withColumn("short", _low_bytes(F.col("gram"), k - 1)).join(lower, ["lang", "short"]).withColumn("p", F.col("own") + F.col("free") * F.col("low"))
        below = written(t.select("lang", "gram", "p", "behind", "free"), f"order{k}")
        backs = below.groupBy("lang", F.col("behind").alias("gram")).agg(F.first("free").alias("back")).withColumn("size", F.lit(k - 1))
        here = below.select("lang", "gram", F.lit(k).alias("size"), F.log("p").alias("logp"), F.lit(None).cast("double").alias("back"))
        out = here if out is None else out.unionByName(here)
        out = out.unionByName(backs.select("lang", "gram", "size", F.lit(None).cast("double").alias("logp"), F.log("back").alias("back")))
    return out.groupBy("lang", "size", "gram").agg(F.max("logp").alias("logp"), F.max("back").alias("back"))


def other_fold(fold: Column) -> Column:
    """The fold whose model scores a fold's texts."""
    return F.when(fold == "0", "1").otherwise("0")


def scores(top: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, gram, logp): what the other fold's model says of each gram of the highest order that any text has.

    ``top`` has the counts, its ``lang`` a fold and a language's key. A gram
    is asked for once, not once for each text that has it, and is joined
    order by order, so that those which no longer order had are ever fewer. A
    score is that of the longest order that has the gram, and the weights of
    falling back to it.
    """
    single = lambda c: F.col(c).cast("float").cast("double").alias(c)
    known = model.select(F.col("lang").alias("key"), "size", F.col("gram").alias("short"), single("logp"), single("back"))
    todo = top.select(F.concat(other_fold(F.substring("lang", 1, 1)), F.expr("substring(lang, 2)")).alias("key"), "gram", F.lit(0.0).alias("so_far"))
    done = None
    for size in range(order, 0, -1):
        at = known.where((F.col("size") == size) & F.col("logp").isNotNull()).select("key", "short", "logp")
        met = written(todo.withColumn("short", _low_bytes(F.col("gram"), size)).join(at, ["key", "short"], "left"), f"backoff{size}")
        found = met.where("logp is not null").select("key", "gram", (F.col("logp") + F.col("so_far")).alias("logp"))
        done = found if done is None else done.unionByName(found)
        backs = known.where((F.col("size") == size - 1) & F.col("back").isNotNull()).select("key", F.col("short").alias("behind"), "back")
        rest = met.where("logp is null").withColumn("behind", F.shiftright("short", 8)).join(backs, ["key", "behind"], "left")
        todo = rest.select("key", "gram", (F.col("so_far") + F.coalesce("back", F.lit(0.0))).alias("so_far"))
    return done.unionByName(todo.select("key", "gram", (F.col("so_far") - F.log(F.lit(256.0))).alias("logp")))


def publish(known: DataFrame, block: int = BLOCK) -> tuple[str, ...]:
    """Rows (key, gram, logp) in order, as blocks of at most ``block`` rows of one key, in files that executors fetch once.

    Spark's tasks sort and pack ranges of rows and write them to the shared
    folder; the driver hands the files on and holds none of their rows.
    Returns the files' names, in order.
    """
    spark = known.sparkSession
    ship(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if size:
                grams, logp = (np.concatenate(x) for x in zip(*held))
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([grams.tobytes()], pa.binary()), pa.array([logp.tobytes()], pa.binary())], names=["key", "grams", "logp"])

        for batch in batches:
            keys, rest = batch.column(0), [batch.column(k).to_numpy() for k in (1, 2)]
            ends = np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(keys) else []
            for a, b in zip([0, *ends], [*ends, len(keys)]):
                while a < b:
                    if size and (size == block or key != keys[a].as_py()):
                        yield from flush()
                        held, size = [], 0
                    key, to = keys[a].as_py(), min(b, a + block - size)
                    held.append([x[a:to].copy() for x in rest])
                    size, a = size + to - a, to
        yield from flush()

    parts = max(1, -(-known.count() // PART))
    ordered = known.select("key", "gram", "logp").repartitionByRange(parts, "key", "gram").sortWithinPartitions("key", "gram")
    made = written(ordered.mapInArrow(pack, "key string, grams binary, logp binary"), "scores")
    paths = sorted(made.inputFiles())
    for path in paths:
        spark.sparkContext.addFile(path)
    return tuple(path.rsplit("/", 1)[1] for path in paths)


class Blocks:
    """Bits of texts from the files of ``publish``, of which a block is in memory at a time."""

    def __init__(self, names: tuple[str, ...], order: int = ORDER):
        self.names, self.order = names, order

    def _found(self, wanted: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """The scores of sorted grams, each of which the files have, by key."""
        out = {key: np.zeros(len(g)) for key, g in wanted.items()}
        for name in self.names:
            with pq.ParquetFile(os.path.join(SparkFiles.getRootDirectory(), name), memory_map=True) as file:
                for batch in file.iter_batches(batch_size=1):
                    key = batch.column(0)[0].as_py()
                    if key in wanted:
                        grams, logp = (np.frombuffer(batch.column(k)[0].as_buffer(), t) for k, t in ((1, np.int64), (2, np.float64)))
                        own = slice(*np.searchsorted(wanted[key], [grams[0], grams[-1] + 1]))
                        out[key][own] = logp[np.searchsorted(grams, wanted[key][own])]
        return out

    def log2_per_byte(self, texts: list[str | None], keys: list[str]) -> list[float | None]:
        """Bits that the model of a text's key needs for a byte of the whole text; None for a text without bytes."""
        by: dict[str, list] = {}
        for i, (text, key) in enumerate(zip(texts, keys)):
            if text:
                by.setdefault(key, []).append((i, *np.unique(grams(text, self.order), return_counts=True)))
        wanted = {key: np.unique(np.concatenate([g for _, g, _ in own])) for key, own in by.items()}
        found, out = self._found(wanted), [None] * len(texts)
        for key, own in by.items():
            for i, g, n in own:
                logp = found[key][np.searchsorted(wanted[key], g)]
                out[i] = float(-(logp * n).sum() / np.log(2) / n.sum())
        return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, known: DataFrame, order: int = ORDER, shipped: int = BLOCK) -> DataFrame:
    """(doc_id, lang, band, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits) of (doc_id, text, lang, band, key).

    ``key`` is the model's language that a text is scored by, ``known`` has
    the ``scores`` of all its grams; bits is null for texts without bytes.
    Scores of any number go to the executors as files of sorted blocks, of
    ``shipped`` rows each. A task goes through the blocks once for each 8 MB
    of texts, so texts and their grams are never shuffled.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, lang string, band string, {', '.join(f'{c} long' for c in _COUNTS)}, bits double"
    blocks = Blocks(publish(known, shipped), order)
    base = lambda x: {c: x[c] for c in ("doc_id", "lang", "band")} | dict(zip(_COUNTS, map(list, zip(*map(counted, x["text"])))))
    return by_row(docs, ["doc_id", "text", "lang", "band", "key"], schema, lambda x: base(x) | {"bits": blocks.log2_per_byte(x["text"], x["key"])}, 8 << 20)


def bands(rows: DataFrame, wide: float = WIDE, least: float = LEAST_SPREAD) -> DataFrame:
    """(band, low, high) of rows (band, bits): the median of a language's bits, and ``wide`` median deviations to each side.

    A deviation counts as ``least`` bits at least. Medians are to within 0.1 % of the rows.
    """
    own = rows.where("bits is not null").select("band", "bits")
    middle = own.groupBy("band").agg(F.percentile_approx("bits", F.lit(0.5), F.lit(1000)).alias("middle"))
    off = own.join(F.broadcast(middle), "band").groupBy("band").agg(F.first("middle").alias("middle"), F.percentile_approx(F.abs(F.col("bits") - F.col("middle")), F.lit(0.5), F.lit(1000)).alias("off"))
    span = F.greatest(F.lit(least), F.col("off")) * wide
    return off.select("band", (F.col("middle") - span).alias("low"), (F.col("middle") + span).alias("high"))


def judged(docs: DataFrame, order: int = ORDER, wide: float = WIDE, least: float = LEAST_SPREAD, shipped: int = BLOCK) -> DataFrame:
    """Each row of ``docs`` (doc_id, text, lang) with its counts, perplexity and verdicts.

    ``base_failed``: fewer than 20 words, or over 30 % of words in repeated
    windows. ``kept``: not failed, and bits per byte within the language's
    band. Texts are dealt to two folds by their digest, and each is scored by
    the model that counts all texts of the other fold, so that neither a text
    nor its copies speak for themselves; bands are set on the bits of rows
    that don't fail. A null lang is a language of its own, as are the empty
    text and each other value; languages are few (their bands are broadcast, a
    row each). A language with texts in one fold only is scored by nothing, 8
    bits a byte, all of it alike. Null texts fail; rows that repeat are judged
    alike; an empty table gives no rows; other columns are not looked at.
    """
    rows = dealt_to_folds(docs)
    own = lambda fold: F.concat(fold, F.col("band"))
    top = written(counts(rows.select("text", own(F.col("fold")).alias("lang")), order), "counts")
    known = written(scores(top, written(kneser_ney(top, order), "model"), order), "known")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = written(measured(rows.withColumn("key", own(other_fold(F.col("fold")))), known, order, shipped).withColumn("base_failed", failed), "measured")
    limits = bands(scored.where("not base_failed"), wide, least)
    inside = F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(True))
    out = scored.join(F.broadcast(limits), "band", "left")
    return out.withColumn("kept", ~F.col("base_failed") & inside).withColumn("perplexity", F.pow(F.lit(2.0), "bits")).drop("lang", "band", "low", "high")
