"""The prefix trie of conversations: a Cartesian tree over the common prefixes of neighbours in sorted order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..shipping import ship
from .shared import written

#: Bytes of a turn's digest, and turns that a block of sorted conversations holds about.
DIGEST, BLOCK_TURNS = 16, 1 << 19
#: What lies beyond all: larger than any conv_id, and the common prefix at both ends of the line.
NONE, OUTSIDE = np.iinfo(np.int64).max, -1


def turn_lists(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of rows (conv_id, turn, role, text): each conversation's turns in order, as (digest in hex, words).

    The order is that of turn, nulls first; rows of one turn go by role, then
    by the digest. A null role or text is empty. Rows without a conv_id belong
    to no conversation. Texts stay where they are: 16 bytes stand for a turn.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int")
    one = F.struct(F.col("turn").isNotNull().alias("there"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role"), digest.alias("digest"), words.alias("words"))
    listed = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def rebuilt(lists: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """``lists`` with each conversation's first turns taken from the first of its family, c - c % 20: crc32(c) % 4 of them, all if it has fewer, none if it isn't there."""
    heads = lists.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string")) % most
    both = lists.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(heads, "base", "left")
    none = F.array().cast(lists.schema["turns"].dataType)
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h.cast("int")), F.slice("turns", (h + 1).cast("int"), F.greatest(F.size("turns"), F.lit(1))))
    return both.select("conv_id", turns.alias("turns"))


def in_blocks(lists: DataFrame) -> DataFrame:
    """(block, pos, conv_id, key, words): conversations in the order of their turns, then of conv_id, cut into blocks.

    The key is all digests in line, so neighbours in the order of bytes share
    the longest prefixes. Ranges are cut by key and conv_id, so that very many
    copies of one conversation are spread over blocks as well.
    """
    spark = lists.sparkSession
    turns = lists.agg(F.sum(F.size("turns"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // BLOCK_TURNS))
    rows = lists.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("key"), F.col("turns.words").alias("words"))
    placed = rows.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    row = F.monotonically_increasing_id()
    return written(placed.select(F.shiftright(row, 33).cast("int").alias("block"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"), "conv_id", "key", "words"), "sorted")


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two keys share from the start."""
    n = min(len(a), len(b)) // DIGEST
    x = np.frombuffer(a, f"V{DIGEST}", n) == np.frombuffer(b, f"V{DIGEST}", n)
    return int(n if x.all() else x.argmin())


def neighbours(keys: pa.Array) -> np.ndarray:
    """For sorted keys, how many turns each but the first shares with the one before it."""
    data = np.frombuffer(keys.buffers()[2] or b"", f"V{DIGEST}")
    ends = keys.cast(pa.large_binary()).buffers()[1]
    at = np.frombuffer(ends, np.int64, len(keys) + 1 + keys.offset)[keys.offset :] // DIGEST
    a, n = at[:-1], np.diff(at)
    out, most = np.zeros(max(len(keys) - 1, 0), np.int64), np.minimum(n[:-1], n[1:])
    live = np.flatnonzero(most > 0)
    while len(live):
        d = out[live]
        live = live[data[a[live] + d] == data[a[live + 1] + d]]
        out[live] += 1
        live = live[out[live] < most[live]]
    return out


def smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the place of the nearest smaller one before it and behind it; -1 and the length where there is none."""
    line, stack = values.tolist(), []
    left, right = [-1] * len(line), [len(line)] * len(line)
    for i, v in enumerate(line):
        while stack and line[stack[-1]] > v:
            right[stack.pop()] = i
        if stack:
            left[i] = stack[-1] if line[stack[-1]] < v else left[stack[-1]]
        stack.append(i)
    return np.array(left, np.int64), np.array(right, np.int64)


class _Block:
    """A block's conversations as arrays; ``edge`` is what its first shares with the one before it, ``after`` what its last shares with the next."""

    def __init__(self, table: pa.Table, edge: int, after: int):
        table = table.sort_by("pos").combine_chunks()
        one = lambda c: table.column(c).chunk(0) if table.column(c).num_chunks else pa.array([], table.schema.field(c).type)
        self.ids, keys, words = one("conv_id").to_numpy(), one("key"), one("words")
        self.lcp = np.concatenate([[edge], neighbours(keys)])
        self.len = np.diff(words.offsets.to_numpy())
        flat = np.concatenate([[0], np.cumsum(words.flatten().to_numpy(zero_copy_only=False))]).astype(np.int64)
        self.at = words.offsets.to_numpy() - words.offsets[0].as_py()
        self.flat = flat
        following = np.append(self.lcp[1:], after)
        self.leaf = (following < self.len).astype(np.int64)
        self.next = following
        # words that a conversation shares with the one before it
        self.shared = np.where(self.lcp > 0, self.until(np.arange(len(self.ids)), np.maximum(self.lcp, 0)), 0)

    def until(self, i: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Words of the first ``depth`` turns of conversations."""
        return self.flat[self.at[i] + depth] - self.flat[self.at[i]]


_STAIRS = "array<struct<pos:long,lcp:long,leaves:long,shared:long,own:long,least:long>>"
#: What others see of a block: its sums, and its minima from its end (each smaller than all behind it) and from its start. A minimum has its
#: place, common prefix, the leaves and shared words before it, its own shared words, and the least conv_id between it and that end of the block.
SUMMARY = f"block int, n long, leaves long, shared long, least long, down {_STAIRS}, up {_STAIRS}"
#: A part of a chain: nodes with the same members, from depth top + 1 to bottom. Where its members begin and bottom name it.
CHAIN = "block int, left long, bottom long, top long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, lost array<long>, saved long, ends_sha256 string, ends_part string, alone boolean"


def summary(number: int, b: _Block) -> dict:
    """A block's row of ``SUMMARY``."""
    leaves, shared = np.cumsum(b.leaf) - b.leaf, np.cumsum(b.shared) - b.shared
    tail, head = np.minimum.accumulate(b.ids[::-1])[::-1], np.minimum.accumulate(b.ids)
    behind = np.append(np.minimum.accumulate(b.lcp[::-1])[::-1][1:], NONE)
    ahead = np.insert(np.minimum.accumulate(b.lcp)[:-1], 0, NONE)
    row = lambda i, least: {"pos": i, "lcp": int(b.lcp[i]), "leaves": int(leaves[i]), "shared": int(shared[i]), "own": int(b.shared[i]), "least": int(least)}
    down = [row(i, tail[i]) for i in np.flatnonzero(b.lcp < behind).tolist()]
    up = [row(i, head[i - 1] if i else NONE) for i in np.flatnonzero(b.lcp < ahead).tolist()]
    return {"block": number, "n": len(b.ids), "leaves": int(b.leaf.sum()), "shared": int(b.shared.sum()), "least": int(b.ids.min()), "down": down, "up": up}


def views(blocks: list) -> dict[int, tuple[list, list, tuple]]:
    """For each block the minima that it sees to its left and right, and the places, leaves and shared words before it.

    A minimum is hidden by one that is as low and nearer, so a block sees no
    more of them than there are depths.
    """
    def moved(stairs, base, leaves, shared):
        return [(s["pos"] + base, s["lcp"], s["leaves"] + leaves, s["shared"] + shared, s["own"], s["least"]) for s in stairs]

    seen: dict[int, list] = {}
    at, left = (0, 0, 0), []
    for b in blocks:
        seen[b["block"]] = [left, [], at]
        new = moved(b["down"], *at)
        lowest = min(s[1] for s in new)
        left = [(*s[:5], min(s[5], b["least"])) for s in left if s[1] < lowest] + new
        at = (at[0] + b["n"], at[1] + b["leaves"], at[2] + b["shared"])
    right = [(at[0], OUTSIDE, at[1], at[2], 0, NONE)]
    for b in reversed(blocks):
        seen[b["block"]][1] = right
        new = moved(b["up"], *seen[b["block"]][2])
        lowest = min(s[1] for s in new)
        right = new + [(*s[:5], min(s[5], b["least"])) for s in right if s[1] < lowest]
    return {k: tuple(v) for k, v in seen.items()}


def chains(number: int, b: _Block, left: list, right: list, before: tuple) -> dict[str, list]:
    """The parts of chains that a block knows of, in columns of ``CHAIN``.

    The line is the minima to the left, the block's own places and the minima
    to the right. The nearest smaller prefixes of a place, on both sides, are
    in the line, so they bound the conversations of the place's node; places
    of one node have one left bound and one length.
    """
    base, n, k0 = before[0], len(b.ids), len(left)
    line, pos, leaf, share, with_own = (np.concatenate([np.array([s[j] for s in left], np.int64), x, np.array([s[j] for s in right], np.int64)]) for j, x in (
        (1, b.lcp), (0, base + np.arange(n)), (2, before[1] + np.cumsum(b.leaf) - b.leaf), (3, before[2] + np.cumsum(b.shared) - b.shared), (4, b.shared),
    ))
    with_own = share + with_own
    low, high = smaller(line)
    # the least conv_id of any stretch of the block, from those of lengths of powers of two
    powers = [b.ids]
    while 2 ** len(powers) <= n:
        half = 2 ** (len(powers) - 1)
        powers.append(np.minimum(powers[-1][:-half], powers[-1][half:]))
    beyond_left, beyond_right = (np.array([s[5] for s in side] + [NONE], np.int64) for side in (left, right))

    def least(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least conv_id of the conversations from place lo of the line to before place hi."""
        i, j = np.clip(lo - k0, 0, n), np.clip(hi - k0, 0, n)
        out = np.minimum(np.where(lo < k0, beyond_left[np.minimum(lo, len(left))], NONE), np.where(hi >= k0 + n, beyond_right[np.clip(hi - k0 - n, 0, len(right))], NONE))
        for p, t in enumerate(powers):
            m = (j - i) >> p == 1
            out[m] = np.minimum(out[m], np.minimum(t[i[m]], t[j[m] - 2**p]))
        return out

    out: dict[str, list] = {x.split()[0]: [] for x in CHAIN.split(", ")}

    def put(left_: int, bottom: int, **of) -> None:
        of |= {"block": number, "left": left_, "bottom": bottom}
        for name, column in out.items():
            column.append(of.get(name))

    def lost(i: int, top: int, bottom: int) -> list[int]:
        """Words in front of the last turn of each node of a chain that conversation i goes through."""
        w = b.until(np.full(bottom - top, i), np.maximum(np.arange(top, bottom), 0))
        return w.tolist()

    # nodes where conversations part: each place is one's, those of one node in a block are told together
    inner = k0 + np.flatnonzero(b.lcp >= 0)
    lo, hi = low[inner], high[inner]
    up = np.where(line[lo] >= line[hi], lo, hi)
    top = line[up]
    conv, parent = least(lo, hi), np.where(top < 0, NONE, least(np.where(top < 0, lo, low[up]), np.where(top < 0, hi, high[up])))
    nodes: dict[tuple[int, int], list[int]] = {}
    for x, key in enumerate(zip(pos[lo].tolist(), line[inner].tolist())):
        i = int(inner[x]) - k0
        nodes.setdefault(key, [x, i, 0])[2] += int(b.len[i] > key[1])
    for (left_, bottom), (x, i, children) in nodes.items():
        above = int(top[x])
        put(left_, bottom, top=above, conv_id=int(conv[x]), parent_conv_id=int(parent[x]) if above >= 0 else None, n_convs=int(pos[hi[x]] - pos[lo[x]]), n_children=children, n_leaves=int(leaf[hi[x]] - leaf[lo[x]]), lost=lost(i, above, bottom), saved=int(share[hi[x]] - with_own[lo[x]]))
    # a node's first conversation is no place of its own there, but goes on to a child too, if it is longer
    for i in np.flatnonzero(b.next > b.lcp).tolist():
        p = k0 + i + 1
        while line[p] > b.lcp[i]:
            if b.len[i] > line[p]:
                put(base + i, int(line[p]), n_children=1)
            p = int(high[p])
    # where conversations end: copies together; one that shares less than its length is a chain of its own
    texts = b.ids.astype("U20")
    for r in np.split(np.arange(n), np.flatnonzero(b.lcp[1:] < b.len[1:]) + 1):
        i, j = int(r[0]), int(r[-1])
        depth, before_, after = int(b.len[i]), int(b.lcp[i]), int(b.next[j])
        told = ",".join(texts[i : j + 1])
        if i == j and depth > max(before_, after):
            p = np.array([k0 + i if before_ >= after else k0 + i + 1])
            above = int(line[p[0]])
            put(base + i, depth, top=above, conv_id=int(b.ids[i]), parent_conv_id=int(least(low[p], high[p])[0]) if above >= 0 else None, n_convs=1, n_children=0, n_leaves=1, lost=lost(i, above, depth), saved=0, ends_sha256=_digest(told), alone=True)
        elif i == 0 and before_ == depth or j == n - 1 and after == depth:
            put(int(pos[low[k0]]) if before_ == depth else base + i, depth, ends_part=told)
        else:
            put(base + i, depth, ends_sha256=_digest(told))
    return out


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _told(parts: DataFrame) -> DataFrame:
    """(left, bottom, ends_sha256) of conversations that end in more blocks than one: their ids run through the digest block by block, a piece in memory at a time."""
    schema = "left long, bottom long, ends_sha256 string"
    arrow = to_arrow_schema(parts.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for left, bottom, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (left, bottom) != now:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = (left, bottom), hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], f.type) for k, f in enumerate(arrow)], schema=arrow)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*now, state.hexdigest()), arrow)], schema=arrow)

    own = parts.where("ends_part is not null").select("left", "bottom", "ends_part", "block")
    return own.repartition("left", "bottom").sortWithinPartitions("left", "bottom", "block").select("left", "bottom", "ends_part").mapInArrow(run, schema)


def nodes(lists: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node of the trie of (conv_id, turns), ids unique.

    A node is a distinct sequence of first turns; its conversations are its
    members. ``conv_id`` is the least of them, ``parent_conv_id`` its parent's
    (null at the root), ``n_leaves`` its subtree's childless nodes,
    ``saved_tokens`` the words that need not be stored again in its subtree,
    and ``ends_sha256`` the digest of the ids, joined by commas, that end at
    it. No conversations give no rows, not even a root.

    Sorted conversations are cut into blocks. Each tells the minima of its
    common prefixes as seen from its two ends; with those of the others,
    chained once in the driver (for each block as many as there are depths
    at most), the nearest smaller prefix on both sides of any place is
    known, which are the Cartesian tree's nodes. Parts of a node from several
    places and blocks are merged, and depths at which no conversation parts
    from another are filled in. A conversation is one row of 16 bytes a turn.
    """
    spark = lists.sparkSession
    ship(spark)
    rows = in_blocks(lists)
    ends = sorted(rows.groupBy("block").agg(F.min_by("key", "pos"), F.max_by("key", "pos")).collect(), key=lambda r: r[0])
    met = [OUTSIDE, *(shared_turns(a[2], b[1]) for a, b in zip(ends, ends[1:])), OUTSIDE]
    edges = {r[0]: (met[k], met[k + 1]) for k, r in enumerate(ends)}
    told_schema, part_schema = (to_arrow_schema(spark.createDataFrame([], s).schema) for s in (SUMMARY, CHAIN))

    def tell(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        return pa.Table.from_pylist([summary(number, _Block(table, *edges[number]))], told_schema)

    def link(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        return pa.Table.from_pydict(chains(number, _Block(table, *edges[number]), *seen[number]), part_schema)

    seen = views(sorted(rows.groupBy("block").applyInArrow(tell, SUMMARY).collect(), key=lambda r: r["block"]))
    parts = written(rows.groupBy("block").applyInArrow(link, CHAIN), "chains")
    own = [c.split()[0] for c in CHAIN.split(", ") if c.split()[0] not in ("block", "ends_part", "alone")]
    told = _told(parts).select("left", "bottom", *(F.col(c) if c == "ends_sha256" else F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in own[2:]))
    merged = parts.where("alone is null").select(*own).unionByName(told).groupBy("left", "bottom").agg(*((F.sum if c == "n_children" else F.max)(c).alias(c) for c in own[2:]))
    every = merged.unionByName(parts.where("alone").select(*own))
    depth, first, last = F.col("depth"), F.col("depth") == F.col("top") + 1, F.col("depth") == F.col("bottom")
    filled = every.select("*", F.explode(F.sequence(F.col("top") + 1, F.col("bottom"))).alias("depth"))
    return filled.select(
        "conv_id", "depth", F.when(first, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs", F.when(last, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * F.element_at("lost", (depth - F.col("top")).cast("int"))).alias("saved_tokens"), F.coalesce(F.when(last, F.col("ends_sha256")), F.lit(_digest(""))).alias("ends_sha256"),
    )
