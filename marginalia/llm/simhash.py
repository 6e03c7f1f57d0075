"""Near-duplicate groups from SimHash fingerprints, joined in a space of bit counts."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import by_row, unused, with_text_verdict, written

#: Every other bit, to add up bits two by two.
PAIRS_OF_BITS = 0x5555555555555555
#: Segments of the embedding: 32 of two bits each.
SEGMENTS = 32


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The SimHash of a whole text as an unsigned integer.

    Words are what white space in ASCII parts, A to Z in lower case. A bit is 1
    if over half of the shingles, repeats included, have it in their XXH64.
    Fewer words than a shingle make one of them all; no words (and a null
    text) give 0.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined, n = b" ".join(parts), max(1, len(parts) - words + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        hashed = xxhash.xxh64_intdigest
        hashes = [hashed(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], ">u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for each row of ``docs`` (doc_id, text): ``fp`` is the fingerprint as a signed long."""
    kind = dict(docs.dtypes)["doc_id"]
    return by_row(docs, ["doc_id", "text"], f"doc_id {kind}, fp long", lambda x: {"doc_id": x["doc_id"], "fp": [_signed(fingerprint(t, words, seed)) for t in x["text"]]})


def _counts(fp: Column) -> Column:
    """The embedding: how many bits each two-bit segment has, packed in two bits each."""
    next_bit, every_other = F.shiftrightunsigned(fp, 1), F.lit(PAIRS_OF_BITS)
    two, one = fp.bitwiseAND(next_bit).bitwiseAND(every_other), fp.bitwiseXOR(next_bit).bitwiseAND(every_other)
    return F.shiftleft(two, 1).bitwiseOR(one)


def _manhattan(a: Column, b: Column) -> Column:
    """The distance of two packed embeddings, segment by segment.

    A segment's counts are 0, 1 or 2, and ``a ^ b`` of 0 and 2 is 2, of 1 and
    2 is 3: the high bit of the difference stands for one step when the counts'
    low bits differ, and for two when they don't.
    """
    x = a.bitwiseXOR(b)
    low, high = x.bitwiseAND(F.lit(PAIRS_OF_BITS)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(PAIRS_OF_BITS))
    return F.bit_count(low) + 2 * F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def groups_for(n: int, distance: int = 4) -> int:
    """Into how many groups the segments of ``n`` fingerprints are best cut.

    More groups are more rows, as each fingerprint has a cell for each choice
    of groups, and fewer chance meetings, as cells are finer: a pair of random
    fingerprints agrees on a segment's count with a chance of 3/8. The cut for
    which rows and meetings together are fewest.
    """
    def work(groups: int) -> float:
        same = (groups - distance) * SEGMENTS // groups
        return comb(groups, distance) * (n + n * n / 2 * 0.375**same)

    return min(range(distance + 1, SEGMENTS // 2 + 1), key=work)


def links(distinct: DataFrame, distance: int = 4, groups: int | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct ``fp`` that differ in at most ``distance`` bits; each pair once.

    Fingerprints become points whose coordinates are the bit counts of 32
    segments; the Manhattan distance of two points is never above the Hamming
    distance of the fingerprints. The coordinates are cut into ``groups``; as
    ``distance`` steps touch at most so many of them, near points share the
    grid cell of some ``groups - distance`` groups. Fingerprints meet in these
    cells, and a pair is kept in the first cell it shares, if the distance of
    the points, then that of the fingerprints, allows it. No pair is lost, and
    none is made outside the join's own condition: the range-join on the grid is
    an equality of cells. ``groups`` (default: ``groups_for`` the number of
    fingerprints) sets the fineness of cells.
    """
    groups = groups or groups_for(distinct.count(), distance)
    cuts = [round(i * SEGMENTS / groups) for i in range(groups + 1)]
    points = distinct.select("fp", _counts(F.col("fp")).alias("p"))

    def cell(p: Column, which: tuple[int, ...]) -> Column:
        mask = 0
        for g in which:
            for s in range(cuts[g], cuts[g + 1]):
                mask |= 3 << (2 * s)
        return p.bitwiseAND(F.lit(_signed(mask)))

    chosen = list(combinations(range(groups), groups - distance))
    cells = F.array(*(F.struct(F.lit(i).cast("short").alias("grid"), cell(F.col("p"), c).alias("cell")) for i, c in enumerate(chosen)))
    met = points.select("fp", "p", F.explode(cells).alias("c")).select("fp", "p", "c.grid", "c.cell")
    a, b = met.alias("a"), met.alias("b")
    x, y = F.col("a.p"), F.col("b.p")
    equal = [cell(x, (g,)) == cell(y, (g,)) for g in range(groups)]
    # the first cell shared: the combination of the lowest groups on which the two agree
    shares = F.array(*(F.when(e, F.lit(g)) for g, e in enumerate(equal)))
    lowest = F.slice(F.array_compact(shares), 1, groups - distance)
    own = F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in chosen)), F.col("a.grid").cast("int") + 1)
    near = (F.col("a.fp") < F.col("b.fp")) & (_manhattan(x, y) <= distance) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance) & (lowest == own)
    # Spark takes exploded rows to be as few as the points, and would send all cells through the driver's memory to broadcast them
    return a.hint("merge").join(b.hint("merge"), (F.col("a.grid") == F.col("b.grid")) & (F.col("a.cell") == F.col("b.cell")) & near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_groups(docs: DataFrame, words: int = 4, seed: int = 42, distance: int = 4, groups: int | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for each row: the smallest doc_id that links reach.

    Copies share a fingerprint and are one node, however many there are. Rows
    with a null doc_id have a group but lend it no id; a group of such rows
    only has a null component_id. An empty table gives no rows; other columns
    of ``docs`` are not looked at.
    """
    prints = written(fingerprints(docs, words, seed), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes, distance, groups))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(ids, "root").select("fp", "component_id"), "fp")


def keep_one(docs: DataFrame, words: int = 4, seed: int = 42, distance: int = 4, groups: int | None = None) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest doc_id (nulls last).

    Rows that agree in all columns count as one. All columns stay as they are.
    """
    whole, fp = unused("row_hash", docs.columns), unused("fp", docs.columns)
    marked = docs.withColumn(whole, F.xxhash64(*docs.columns))
    prints = with_text_verdict(marked.select("doc_id", "text", whole), f"{fp} long", lambda texts: {fp: [_signed(fingerprint(t, words, seed)) for t in texts]})
    prints = written(prints.select("doc_id", F.col(whole).alias("h"), F.col(fp).alias("fp")), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("least")), "nodes")
    found = components(links(nodes.select("fp"), distance, groups))
    stay = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    # ids as texts that are never null, so that the join and the removal of copies go by the same keys and texts move once
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))
    own = unused("kept_id", marked.columns)
    stay = stay.select(key(F.col("least.doc_id")).alias(own), F.col("least.h").alias(whole))
    # groups are nearly as many as texts, and take far more of the driver's memory than Spark's bound on broadcasts looks at
    return marked.withColumn(own, key(F.col("doc_id"))).hint("merge").join(stay.hint("merge"), [own, whole], "left_semi").dropDuplicates([own, whole]).select(*docs.columns)
