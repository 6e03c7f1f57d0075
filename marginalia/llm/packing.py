"""Packing documents into sequences of one length, each with every source's share of the tokens."""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..shipping import ship
from .shared import pieces as parts
from .shared import unused, written

WIDTH, END = 4096, 2
#: Words that a worker remembers the ids of; beyond that it forgets all and starts anew, which changes no result.
REMEMBERED = 1 << 20
#: Rows of the table of starts up to which it is broadcast; a longer one is left to Spark's own choice of join.
BROADCAST_ROWS = 1 << 17
#: Buckets in which sources of the common queue are put in line.
BUCKETS = 4096


class Vocabulary:
    """Token ids of texts by a tokenizer's file, word by word.

    The tokenizer drops white space and never joins what blanks, line ends, or
    a small letter or digit and the sign behind it part. (Other letters may
    become a letter and a mark, which goes with the sign.) So distinct words
    only meet it; the rest is array work. Texts are lower-cased by the
    tokenizer, so A to Z may be before. Where a text has ``<|``, which may begin a special
    token's string, the batch's words are left as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(names.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.last = np.zeros(size, bool)
        self.last[[i for w, i in names.items() if w.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.flat, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, self.dtype), 0

    def _add(self, words: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        n, m = len(self.known), len(words)
        while n + m > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.starts[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + m] = sizes
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known.update(zip(words, range(n, n + m)))

    def _learn(self, words: list[str]) -> None:
        """Words of letters alone are one unit each, which ends on a token that ends words: many are told apart in one text."""
        plain = [w for w in words if w.isalpha()]
        odd = [w for w in words if not w.isalpha()]
        for k in range(0, len(plain), 4096):
            own = plain[k : k + 4096]
            ids = np.array(self.tokenizer.encode(" ".join(own), add_special_tokens=False).ids, np.int64)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(own) and ends[-1] == len(ids):
                self._add(own, np.diff(ends, prepend=0), ids)
            else:
                odd += own
        for k in range(0, len(odd), 4096):
            own = odd[k : k + 4096]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
            self._add(own, np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids): tokens of each text, and all of them in line, with the end's id behind each text; null is empty."""
        texts = pc.fill_null(texts, "")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), r"([\p{Ll}\p{N}])([.,;:!?])", r"\1 \2")
        listed = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = listed.flatten().dictionary_encode()
        words, offsets = coded.dictionary.to_pylist(), listed.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self.known) + len(words) > REMEMBERED:
            self.forget()
        if fresh := [w for w in words if w not in self.known]:
            self._learn(fresh)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy(zero_copy_only=False)]
        sizes, firsts = self.sizes[at], self.starts[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        each = ends[offsets[1:] - offsets[0]] - ends[offsets[:-1] - offsets[0]] + 1
        ids = self.flat[np.repeat(firsts - ends[:-1], sizes) + np.arange(ends[-1])] if len(at) else np.zeros(0, self.dtype)
        out = np.full(ends[-1] + len(each), END, self.dtype)
        mine = np.ones(len(out), bool)
        mine[np.cumsum(each) - 1] = False
        out[mine] = ids
        return each, out


class Rounds:
    """Deficit round-robin over queues, whose state at any round is known without those before it.

    A queue's counter earns its share of each token that is sent; the queue
    with the earliest due token (the one whose counter reaches a half first,
    ties to the first queue) sends next, and what it is short or ahead of its
    share is carried on. Token j of a queue is due at (j - 1/2) / rate, so the
    number that each has sent among the first t of all is a function of t, and
    any task can go on from any window with exactly the deficits of a single
    run from the start. A queue that is empty earns no more; the others share.
    """

    def __init__(self, totals: np.ndarray, rates: np.ndarray | None = None):
        self.totals = np.asarray(totals, np.int64)
        self.rates = np.asarray(totals if rates is None else rates, np.float64)
        ends = np.sort(self.totals / self.rates)
        self.times = np.concatenate([[0.0], ends])
        self.sums = np.array([np.minimum(self.totals, t * self.rates).sum() for t in self.times])

    def rank(self, queue: int, token: int) -> int:
        """About how many tokens are sent before one of a queue; off by no more than the number of queues."""
        return int(np.minimum(self.totals, np.floor((token + 0.5) / self.rates[queue] * self.rates + 0.5)).sum())

    def sent(self, upto: np.ndarray) -> np.ndarray:
        """(times, queues): how many tokens each queue has sent when all have sent ``upto``."""
        step = max(1, (1 << 20) // len(self.totals))
        return np.concatenate([self._sent(upto[k : k + step]) for k in range(0, len(upto), step)])

    def _sent(self, upto: np.ndarray) -> np.ndarray:
        at = np.interp(upto, self.sums, self.times)
        a = np.clip(np.floor(at[:, None] * self.rates + 0.5), 0, self.totals).astype(np.int64)
        every, most = np.arange(len(upto)), len(self.totals) - 1
        while True:
            after = np.where(a < self.totals, (a + 0.5) / self.rates, np.inf)
            before = np.where(a > 0, (a - 0.5) / self.rates, -np.inf)
            low, high = after.argmin(1), most - before[:, ::-1].argmax(1)
            short = upto - a.sum(1)
            late, early = after[every, low], before[every, high]
            swap = (short == 0) & ((early > late) | ((early == late) & (high > low)))
            give, take = (short > 0) | swap, (short < 0) | swap
            if not (give | take).any():
                return a
            a[every[give], low[give]] += 1
            a[every[take], high[take]] -= 1


class Sequences:
    """Bounds of the sequences over all tokens: full ones, then the rest in powers of two, the largest first, so that none is padded."""

    def __init__(self, total: int, width: int):
        self.width, self.full = width, total // width
        rest = [1 << k for k in range(width.bit_length(), -1, -1) if total % width >> k & 1]
        self.tail = self.full * width + np.concatenate([[0], np.cumsum(rest)]).astype(np.int64)

    def starts(self, first: int, last: int) -> np.ndarray:
        """Tokens before each sequence from ``first`` to ``last``, that behind the last one included."""
        ks = np.arange(max(first, 0), min(last, self.full + len(self.tail) - 1) + 1)
        return np.where(ks <= self.full, ks * self.width, self.tail[np.maximum(ks - self.full, 0)])

    def of(self, token: int) -> int:
        return int(token // self.width if token < self.full * self.width else self.full + np.searchsorted(self.tail, token, "right") - 1)


def _key(source: Column) -> Column:
    """A source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def tokenized(docs: DataFrame, path: str, text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, src, block, before, n, ids): each document's ids as a task made them, where ``before`` is the sum of ``n`` so far of its source in its task.

    One pass over the scan, without a shuffle; a task run again makes the same rows.
    """
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, src string, block int, before long, n long, ids binary"
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    plain = docs.select("doc_id", _key(F.col(source)).alias("src"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        global _VOCABULARY
        if _VOCABULARY is None or _VOCABULARY[0] != path:
            _VOCABULARY = (path, Vocabulary(path))
        vocabulary, block, sums = _VOCABULARY[1], TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for part in parts(batch):
                sizes, ids = vocabulary.encode(part.column(2))
                before = []
                for s, n in zip(part.column(1).to_pylist(), sizes.tolist()):
                    before.append(sums[s])
                    sums[s] += n
                wide = ids.dtype.itemsize
                offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes * wide)]).astype(np.int32))
                held = pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets, pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([block] * len(sizes), pa.int32()), pa.array(before, pa.int64()), pa.array(sizes), held], schema=arrow)

    return plain.mapInArrow(run, schema)


_VOCABULARY: tuple[str, Vocabulary] | None = None


def queued(tokens: DataFrame, width: int = WIDTH, weights: Mapping[str | None, float] | None = None) -> tuple[DataFrame, list[int], list[float]]:
    """(src, block, queue, base) of ``tokenized`` rows, each queue's tokens, and their rates.

    A source that is due a token or more in each sequence has a queue of its
    own, so there are ``width`` of them at most; all others share the last
    one, source after source. With ``weights`` (by source, null too) the named
    sources have queues, and those without a weight share one with what is
    left of the weight 1, or their own number of tokens if nothing is left.
    Only the queues' totals come to the driver.
    """
    sums = written(tokens.groupBy("src", "block").agg(F.sum("n").alias("n")), "sums")
    totals = sums.groupBy("src").agg(F.sum("n").alias("total"))
    whole = totals.agg(F.sum("total")).first()[0] or 0
    if weights is None:
        own = [tuple(r) for r in totals.where(F.col("total") * width >= whole).orderBy("src").collect()]
        rates = [float(n) for _, n in own]
    else:
        if len(weights) > width:
            raise ValueError(f"at most {width} sources can have a weight")
        given = {"n" if s is None else f"s{s}": float(w) for s, w in weights.items() if w > 0}
        own = [tuple(r) for r in totals.where(F.col("src").isin(*given)).orderBy("src").collect()]
        rates = [given[s] for s, _ in own]
    names = [s for s, _ in own]
    left = whole - sum(n for _, n in own)
    sizes = [n for _, n in own] + [left] * (left > 0)
    rates += ([float(left) if weights is None else max(1.0 - sum(rates), 0.0) or float(left) / whole] if left else [])
    line = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(line), F.lit(0)))
    queue = F.array_position(F.array(*map(F.lit, names)).cast("array<string>"), F.col("src")) - 1 if names else F.lit(-1)
    mine = base.withColumn("queue", F.coalesce(queue, F.lit(-1)).cast("int"))
    if not left:
        return mine.select("src", "block", "queue", "base"), sizes, rates
    # sources of the common queue stand in line by bucket, then by name
    bucket = F.pmod(F.xxhash64("src"), F.lit(BUCKETS))
    rest = totals.where(~F.col("src").isin(*names) if names else F.lit(True)).withColumn("bucket", bucket)
    heads = rest.groupBy("bucket").agg(F.sum("total").alias("b")).withColumn("head", F.coalesce(F.sum("b").over(Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("total").over(Window.partitionBy("bucket").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rest.withColumn("inside", inside).join(heads, "bucket").select("src", (F.col("head") + F.col("inside")).alias("first"))
    both = mine.join(placed, "src", "left")
    common = F.col("queue") < 0
    return both.select("src", "block", F.when(common, F.lit(len(names))).otherwise(F.col("queue")).cast("int").alias("queue"), (F.col("base") + F.when(common, F.col("first")).otherwise(0)).alias("base")), sizes, rates


def packed(docs: DataFrame, path: str, width: int = WIDTH, weights: Mapping[str | None, float] | None = None, with_ids: bool = False, text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of a document in a sequence.

    A document is its ids by the tokenizer in ``path``, then the id 2; a null
    text is empty, so each document has a token at least. Documents wait in
    their source's queue in the order of the table's splits. Deficit
    round-robin sends each source's share of every sequence of ``width``
    tokens (a power of two); deficits are carried over sequences and tasks, so
    a source is never a token or more off its share. Documents are cut where a
    source's turn ends. Sequences are full; what is left at the end goes to
    sequences of a power of two each. By default shares are the sources'
    own, so all queues last to the end; with ``weights`` they are those, until
    a queue is empty. Rows that repeat are documents of their own; a null
    doc_id or source is a value like any other; an empty table gives no rows.
    ``with_ids`` adds ``ids``, little-endian unsigned 32-bit.

    A text is tokenized once and its ids are written to the shared folder. No
    text or id is shuffled: a small table of sums by source and task gives
    each document its place in line.
    """
    if width & (width - 1):
        raise ValueError("the width must be a power of two")
    spark = docs.sparkSession
    tokens = written(tokenized(docs, path, text, source), "tokens")
    starts, sizes, rates = queued(tokens, width, weights)
    starts = written(starts, "starts")
    placed = tokens.join(F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts, ["src", "block"])
    rows = placed.select("doc_id", F.when(F.col("src") != "n", F.substr("src", F.lit(2))).alias("source"), "queue", (F.col("base") + F.col("before")).alias("first"), "n", "ids")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    arrow, total = to_arrow_schema(spark.createDataFrame([], schema).schema), sum(sizes)
    rounds, sequences = (Rounds(np.array(sizes), np.array(rates)), Sequences(total, width)) if total else (None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                queue, first, n = (part.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
                order = np.lexsort((first, queue))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(queue[order]) != 0) | (first[order][1:] != (first + n)[order][:-1])
                for run_ in np.split(order, np.flatnonzero(new)[1:]):
                    yield cut(part, run_, int(queue[run_[0]]), first[run_], n[run_])

    def cut(part: pa.RecordBatch, rows_: np.ndarray, queue: int, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """Pieces of documents that follow each other in a queue."""
        low, high = int(first[0]), int(first[-1] + n[-1])
        slack = len(sizes) + 2
        k0 = sequences.of(max(0, rounds.rank(queue, low) - slack))
        bounds = sequences.starts(k0, sequences.of(min(total - 1, rounds.rank(queue, high - 1) + slack)) + 1)
        sent = rounds.sent(bounds)
        own = sent[:, queue]
        lead = np.diff(sent, axis=0)[:, :queue].sum(1)
        at = np.unique(np.concatenate([first, own[(own > low) & (own < high)]]))
        size = np.diff(at, append=high)
        doc, seq = np.searchsorted(first, at, "right") - 1, np.searchsorted(own, at, "right") - 1
        held = part.column(5).take(pa.array(rows_)).to_pylist()
        wide = len(held[0]) // int(n[0])
        ids = np.frombuffer(b"".join(held), f"<u{wide}").astype("<u4")
        views = [ids[a - low : a - low + m] for a, m in zip(at.tolist(), size.tolist())]
        whose = pa.array(rows_[doc])
        columns = [part.column(0).take(whose), part.column(1).take(whose), pa.array(at - first[doc]), pa.array(size), pa.array([zlib.crc32(v) for v in views], pa.int64()), pa.array(n[doc]), pa.array(k0 + seq), pa.array(lead[seq] + at - own[seq])]
        return pa.RecordBatch.from_arrays(columns + ([pa.array([v.tobytes() for v in views], pa.binary())] if with_ids else []), schema=arrow)

    return rows.mapInArrow(run, schema)


def sequences(pieces: DataFrame, width: int = WIDTH, pad: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, ids, starts) of ``packed`` rows with ids: a sequence's ids in order, padded to ``width`` unless they are a power of two, and where its pieces begin.

    A group is a sequence, so it holds ``width`` ids at most.
    """
    name = unused("part", pieces.columns)
    listed = pieces.select("sequence_id", F.struct("offset", "ids").alias(name)).groupBy("sequence_id").agg(F.array_sort(F.collect_list(name)).alias(name))
    hexed = F.array_join(F.transform(f"{name}.ids", F.hex), "")
    n = (F.length(hexed) / 8).cast("int")
    filled = F.when(F.bit_count(n) == 1, hexed).otherwise(F.concat(hexed, F.repeat(F.lit(pad.to_bytes(4, "little").hex().upper()), (width - n).cast("int"))))
    return listed.select("sequence_id", n.cast("long").alias("n_tokens"), F.unhex(filled).alias("ids"), F.col(f"{name}.offset").alias("starts"))
