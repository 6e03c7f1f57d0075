"""Benchmark decontamination with suffix arrays of the training text."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_row, unused, with_text_verdict, words, written


@dataclass
class Suite:
    """A block of test items: word numbers (from 1) of all items, 0 behind each, and their distinct windows.

    ``places``, ``rest`` and ``items`` are of all windows, repeats included:
    where each begins, how many words its item still has from there, and the item.
    """

    ids: list[int | None]
    numbers: dict[bytes, int]
    tokens: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    windows: np.ndarray
    lengths: np.ndarray
    owners: list[tuple[int, ...]]
    places: np.ndarray
    rest: np.ndarray
    items: np.ndarray
    depth: int

    @classmethod
    def of(cls, items: list[tuple[int | None, str | None]], window: int) -> Suite:
        parts = [(i, words(t)) for i, t in items]
        parts = [(i, w) for i, w in parts if w]
        numbers: dict[bytes, int] = {}
        tokens, starts, sizes, owners, places = [], [], [], {}, []
        for k, (_, w) in enumerate(parts):
            own = [numbers.setdefault(x, len(numbers) + 1) for x in w]
            at, n = len(tokens), min(window, len(own))
            starts.append(at), sizes.append(len(own))
            tokens += [*own, 0]
            for o in range(len(own) - n + 1):
                owners.setdefault(tuple(own[o : o + n]), (at + o, n, set()))[2].add(k)
                places.append((at + o, len(own) - o, k))
        found = list(owners.values())
        return cls([i for i, _ in parts], numbers, np.array(tokens, np.int64), np.array(starts, np.int64), np.array(sizes, np.int64), np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64), [tuple(sorted(f[2])) for f in found], *np.array(places, np.int64).reshape(-1, 3).T, max([1, *sizes]))


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Suite]:
    """The items (item_id, text) as suites of about ``block_words`` words, one block in the driver at a time."""
    held, n = [], 0
    for item, text in benchmark.select("item_id", "text").toLocalIterator():
        held.append((item, text))
        n += len(words(text))
        if n >= block_words:
            yield Suite.of(held, window)
            held, n = [], 0
    if held:
        yield Suite.of(held, window)


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Places in ``tokens``, by the order of the suffixes that start there, compared to ``depth`` tokens."""
    rank, order, done = tokens, np.argsort(tokens, kind="stable"), 1
    rank = np.zeros(len(tokens), np.int64)
    ordered = tokens[order]
    rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
    while done < depth and len(tokens) and rank[order[-1]] < len(tokens) - 1:
        after = np.zeros(len(tokens), np.int64)
        after[:-done or None] = rank[done:] + 1 if done < len(tokens) else 0
        if done >= len(tokens):
            break
        key = rank * (len(tokens) + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.zeros(len(tokens), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        done *= 2
    return order


def _compare(text: np.ndarray, at: np.ndarray, query: np.ndarray, q: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffixes of ``text`` at ``at`` and of ``query`` at ``q``: common tokens (to ``depth``), and the sign of their order."""
    same, sign, going = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.flatnonzero(depth > 0)
    while len(going):
        p = at[going] + same[going]
        x = np.where(p < len(text), text[np.minimum(p, len(text) - 1)], -1)
        y = query[q[going] + same[going]]
        differ = x != y
        sign[going[differ]] = np.sign(x - y)[differ]
        going = going[~differ]
        same[going] += 1
        going = going[same[going] < depth[going]]
    return same, sign


def bounds(text: np.ndarray, order: np.ndarray, query: np.ndarray, q: np.ndarray, depth: np.ndarray, above: bool) -> np.ndarray:
    """Binary search of all query suffixes at once: the first rank not below (with ``above``: beyond) each."""
    low, high = np.zeros(len(q), np.int64), np.full(len(q), len(order), np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) // 2
        _, sign = _compare(text, order[mid], query, q[open_], depth[open_])
        right = sign <= 0 if above else sign < 0
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]
    return low


class Shard:
    """Some whole documents as one text of word numbers with its suffix array.

    Only runs of words that some item has, and long enough for its shortest
    window, are kept: no other place can begin a match.
    """

    def __init__(self, texts: list[str | None], suite: Suite):
        get, tokens, sizes = suite.numbers.get, [], []
        for t in texts:
            w = words(t)
            sizes.append(len(w))
            tokens.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
            tokens.append(np.zeros(1, np.int64))
        self.sizes = sizes
        whole = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        self.first = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64) + 1)))
        live = np.concatenate(([0], (whole > 0).astype(np.int8), [0]))
        begins, ends = np.flatnonzero(np.diff(live) == 1), np.flatnonzero(np.diff(live) == -1)
        least = int(suite.lengths.min()) if len(suite.lengths) else 1 << 60
        keep = ends - begins >= least
        begins, ends = begins[keep], ends[keep]
        self.places = np.concatenate([np.arange(a, b + 1) for a, b in zip(begins, ends)]) if len(begins) else np.zeros(0, np.int64)
        self.text = whole[self.places]
        self.order = suffix_array(self.text, suite.depth)
        self.whole = len(whole)

    def occurrences(self, suite: Suite) -> Iterator[tuple[int, np.ndarray]]:
        """Each window that occurs, and where."""
        if len(self.text):
            args = (self.text, self.order, suite.tokens, suite.windows, suite.lengths)
            low, high = bounds(*args, above=False), bounds(*args, above=True)
            for k in np.flatnonzero(low < high):
                yield int(k), self.places[self.order[low[k] : high[k]]]

    def longest(self, suite: Suite) -> list[tuple[int, int, int, int, int]]:
        """For each test suffix with a match of a window or more: (item, start in it, words, document, start in it)."""
        out = []
        if not len(self.text):
            return out
        ends = np.repeat(suite.starts + suite.sizes, suite.sizes)
        q = np.concatenate([np.arange(a, a + n) for a, n in zip(suite.starts, suite.sizes)])
        item = np.repeat(np.arange(len(suite.sizes)), suite.sizes)
        depth = ends - q
        low = bounds(self.text, self.order, suite.tokens, q, depth, above=False)
        best, where = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for near in (low, low - 1):
            at = self.order[np.clip(near, 0, len(self.order) - 1)]
            same, _ = _compare(self.text, at, suite.tokens, q, depth)
            better = same > best
            best[better], where[better] = same[better], at[better]
        least = np.minimum(10**9, suite.lengths.min())
        for k in np.flatnonzero(best >= least):
            place = self.places[where[k]]
            doc = int(np.searchsorted(self.first, place, "right")) - 1
            out.append((int(item[k]), int(q[k] - suite.starts[item[k]]), int(best[k]), doc, int(place - self.first[doc])))
        return out

    def longest_of_each(self, suite: Suite) -> dict[int, tuple[int, int, int, int]]:
        """By document: (words, item, start in it, start in the document) of its longest match; ties go to the first place, then item.

        Each test suffix that begins a window is searched for; of the places
        where it occurs only those are compared on whose word before differs,
        since all others are inside a longer match.
        """
        best: dict[int, tuple[int, int, int, int]] = {}
        if not len(self.text) or not len(suite.places):
            return best
        n = np.minimum(suite.rest, suite.lengths.max())
        args = (self.text, self.order, suite.tokens, suite.places, n)
        low, high = bounds(*args, above=False), bounds(*args, above=True)
        for k in np.flatnonzero(low < high):
            q, at = suite.places[k], self.order[low[k] : high[k]]
            if q and suite.tokens[q - 1]:
                at = at[(at == 0) | (self.text[at - 1] != suite.tokens[q - 1])]
            if not len(at):
                continue
            same, _ = _compare(self.text, at, suite.tokens, np.full(len(at), q), np.full(len(at), suite.rest[k]))
            where = self.places[at]
            docs = np.searchsorted(self.first, where, "right") - 1
            item = int(suite.items[k])
            start = int(q - suite.starts[item])
            for d, m, w in zip(docs.tolist(), same.tolist(), (where - self.first[docs]).tolist()):
                now = (m, item, start, w)
                old = best.get(d)
                if old is None or (-m, w, item, start) < (-old[0], old[3], old[1], old[2]):
                    best[d] = now
        return best

    def hits(self, suite: Suite) -> list[tuple[list[tuple[int, int]], set[int]]]:
        """For each document the merged word spans inside windows that occur, and the items these come from."""
        cover, items = np.zeros(self.whole + 1, np.int64), [set() for _ in self.sizes]
        for k, at in self.occurrences(suite):
            np.add.at(cover, at, 1)
            np.add.at(cover, at + suite.lengths[k], -1)
            for d in np.unique(np.searchsorted(self.first, at, "right") - 1):
                items[d].update(suite.owners[k])
        spans = [[] for _ in self.sizes]
        if any(items):
            inside = np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8), [0]))
            for a, b in zip(np.flatnonzero(np.diff(inside) == 1).tolist(), np.flatnonzero(np.diff(inside) == -1).tolist()):
                d = int(np.searchsorted(self.first, a, "right")) - 1
                spans[d].append((a - int(self.first[d]), b - int(self.first[d])))
        return list(zip(spans, items))


#: What `marked` adds: word count, hit spans, ids of items, and the longest match; {} stands for the type of item_id.
_ADDED = {"n_words": "long", "spans": "array<struct<a:int,b:int>>", "items": "array<{0}>", "longest": "struct<n_words:int,item_id:{0},item_start:int,doc_start:int>"}


def _finder(shared: Broadcast) -> Callable[[list], dict[str, list]]:
    """Texts to the values of ``_ADDED``, against the suite that is broadcast."""

    def find(texts: list) -> dict[str, list]:
        suite = shared.value
        shard = Shard(texts, suite)
        got, best = shard.hits(suite), shard.longest_of_each(suite)
        one = lambda m: None if m is None else {"n_words": m[0], "item_id": suite.ids[m[1]], "item_start": m[2], "doc_start": m[3]}
        return {"n_words": shard.sizes, "spans": [[{"a": a, "b": b} for a, b in s] for s, _ in got], "items": [sorted({suite.ids[k] for k in i if suite.ids[k] is not None}) for _, i in got], "longest": [one(best.get(d)) for d in range(len(texts))]}

    return find


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, names: dict[str, str]) -> DataFrame:
    """``docs`` with the columns of ``_ADDED`` behind, called ``names``.

    One block of items is a pass in the scan's own tasks. More blocks are
    broadcast, searched for and let go of one by one: the digests of texts
    with hits, each once, and what was found are written; at the end they are
    put together and joined to the rows, so neither the plan nor what is held
    in memory grows with the benchmark.
    """
    spark, item = docs.sparkSession, dict(benchmark.dtypes)["item_id"]
    types = {k: v.format(item) for k, v in _ADDED.items()}
    schema = lambda own: ", ".join(f"{own[k]} {types[k]}" for k in types)
    rename = lambda f, own: lambda texts: {own[k]: v for k, v in f(texts).items()}
    suites = blocks(benchmark, window, block_words)
    first = next(suites, None)
    second = next(suites, None) if first is not None else None
    if second is None:
        shared = spark.sparkContext.broadcast(first or Suite.of([], window))
        return with_text_verdict(docs, schema(names), rename(_finder(shared), names))
    digest, parts = unused("digest", [*docs.columns, *names.values()]), []
    for k, suite in enumerate(chain((first, second), suites)):
        shared = spark.sparkContext.broadcast(suite)
        found = with_text_verdict(docs.select("text"), schema({k: k for k in types}), _finder(shared)).where(F.size("spans") > 0)
        parts.append(written(found.select(F.md5("text").alias(digest), F.lit(k).alias("block"), "spans", "items", "longest").dropDuplicates([digest]), "hits"))
        shared.unpersist()
    every = reduce(DataFrame.unionByName, parts).groupBy(digest).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.min(F.struct(-F.col("longest.n_words"), "longest.doc_start", "block", "longest")).alias("longest"))
    ready = every.select(digest, _merged(F.col("spans")).alias(names["spans"]), F.col("items").alias(names["items"]), F.col("longest.longest").alias(names["longest"]))
    counted = with_text_verdict(docs, f"{names['n_words']} long", lambda texts: {names["n_words"]: [len(words(t)) for t in texts]})
    out = counted.withColumn(digest, F.md5("text")).join(ready, digest, "left").drop(digest)
    empty = lambda c: F.coalesce(F.col(names[c]), F.array().cast(types[c]))
    return out.withColumns({names[c]: empty(c) for c in ("spans", "items")}).select(*docs.columns, *names.values())


def marked(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 500_000) -> DataFrame:
    """(doc_id, n_words, spans, items, longest) for each row of ``docs`` (doc_id, text), against ``benchmark`` (item_id, text).

    A window is ``window`` words of an item in a row, or all words of a
    shorter one; ``spans`` (words from 0, end exclusive) are what windows that
    occur cover, merged; ``items`` the ids of items found, sorted, each once.
    ``longest`` is the longest verbatim match of a test suffix that begins a
    window: its words, item, and where it begins in both; null without a hit,
    and ties go to the first place, then the first item. Null and empty texts
    have no words and no hits; an item without words has no windows; items
    with a null id hit words but are not listed. item_id may be of any type
    that sorts. Other columns, whatever their names, are not looked at; an
    empty table gives no rows.
    """
    return _marked(docs.select("doc_id", "text"), benchmark, window, block_words, {k: k for k in _ADDED}).drop("text")


def _merged(spans: Column) -> Column:
    """Sorted spans with those that touch put together, as a fold over the array."""
    kind = "array<struct<a:int,b:int>>"

    def put(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        touches = (F.size(done) > 0) & (s["a"] <= last["b"])
        wider = F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s))).cast(kind)

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), put)


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 500_000) -> DataFrame:
    """(item_id, item_start, n_words, doc_id, doc_start): for each shard and test suffix, its longest verbatim match.

    Only matches as long as the shortest window are given. A shard is what a
    task reads at once; the longest of all shards is a maximum over its rows.
    """
    kind, out = dict(docs.dtypes)["doc_id"], None
    schema = f"item_id {dict(benchmark.dtypes)['item_id']}, item_start int, n_words int, doc_id {kind}, doc_start int"
    for suite in blocks(benchmark, window, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(suite)

        def find(x: dict, shared=shared) -> dict:
            got = Shard(x["text"], shared.value).longest(shared.value)
            return {"item_id": [shared.value.ids[g[0]] for g in got], "item_start": [g[1] for g in got], "n_words": [g[2] for g in got], "doc_id": [x["doc_id"][g[3]] for g in got], "doc_start": [g[4] for g in got]}

        part = by_row(docs, ["doc_id", "text"], schema, find)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 500_000) -> DataFrame:
    """``docs``, all columns as they are, without the rows that hold a window of an item; null and empty texts stay."""
    names = {k: unused(k, docs.columns) for k in _ADDED}
    return _marked(docs, benchmark, window, block_words, names).where(F.size(names["spans"]) == 0).drop(*names.values())
