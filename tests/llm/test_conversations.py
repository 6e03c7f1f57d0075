"""The prefix trie, packing and repair against brute force and exact round trips, on odd rows too."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from marginalia.llm import packing, queries, repair, trie

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
WORD = r"[^\x20\x09-\x0D]+"
TOKENS = public_tokenizers.path("word_bpe_49k.json")


# ---- trie


def plain_trie(rows):
    """Nodes by dictionaries of whole prefixes."""
    listed = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            listed[c].append((t is not None, t or 0, r, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), x))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in listed.items()}
    full = {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        full[c] = own.get(base, [])[:h] + v[h:]
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c, v in full.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(re.findall(WORD, p[-1][1])) if p else 0
            leaves[p[:d]] += not kids[p]
    ends = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(full[c]) == len(p)))).encode()).hexdigest()
    return sorted((len(p), min(m), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], ends(p, m)) for p, m in members.items())


def trie_rows(spark, rows):
    found = trie.nodes(trie.rebuilt(trie.turn_lists(spark.createDataFrame(rows, TURNS))))
    return sorted((tuple(r) for r in found.select("depth", *(c for c in found.columns if c != "depth")).collect()), key=lambda r: r[:2])


def random_turns(seed):
    r = random.Random(seed)
    n = r.choice([3, 30, 120])
    said = ["a b", "c", "", None, "d e f"][: r.randint(1, 5)]
    return [(r.choice([c, c - n // 2]), r.choice([None, *range(6)]), r.choice(["user", "assistant", None, ""]), r.choice(said)) for c in range(n) for _ in range(r.randint(0, 6))]


@pytest.mark.parametrize("seed", range(4))
def test_trie_by_brute_force(spark, seed):
    rows = random_turns(seed)
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_of_copies_long_ones_and_those_without_a_conversation(spark):
    rows = [(c, t, "u", "same words") for c in range(90) for t in range(3)]  # copies that lie in several blocks
    rows += [(c, t, "u", "x" * (t % 3)) for c in (100, 107, 108) for t in range(1500)]
    rows += [(None, 0, "u", "lost"), (207, 0, None, None), (207, 0, None, None)]
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_trie_of_one_of_none_and_with_columns_of_clashing_names(spark):
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(5, None, None, None)]) == plain_trie([(5, None, None, None)])
    rows = [(1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "a", "b")]
    wide = spark.createDataFrame(rows, TURNS).select("*", *(F.lit("own").alias(c) for c in ("key", "block", "pos", "turns", "t", "base", "depth", "left")))
    got = sorted((r.depth, r.conv_id) for r in trie.nodes(trie.rebuilt(trie.turn_lists(wide))).collect())
    assert got == [r[:2] for r in plain_trie(rows)]


def test_nearest_smaller_values():
    for seed in range(300):
        r = random.Random(seed)
        v = [r.randint(0, 4) for _ in range(r.randint(1, 12))]
        left, right = trie.smaller(np.array(v))
        for i, x in enumerate(v):
            assert left[i] == max((j for j in range(i) if v[j] < x), default=-1)
            assert right[i] == min((j for j in range(i + 1, len(v)) if v[j] < x), default=len(v))


# ---- packing


def test_rounds_are_those_of_a_single_run():
    rng = random.Random(3)
    for totals in ([5, 7, 1000, 3], [100] * 3, [1], [37, 2000, 1, 1, 900], [rng.randint(1, 400) for _ in range(40)]):
        for rates in (None, [rng.randint(1, 9) for _ in totals]):
            rounds = packing.Rounds(np.array(totals), None if rates is None else np.array(rates))
            due = [(0.5 / rounds.rates[s], s) for s in range(len(totals))]
            heapq.heapify(due)
            sent, want = [0] * len(totals), [[0] * len(totals)]
            while due:
                _, s = heapq.heappop(due)
                sent[s] += 1
                want.append(list(sent))
                if sent[s] < totals[s]:
                    heapq.heappush(due, ((sent[s] + 0.5) / rounds.rates[s], s))
            assert (rounds.sent(np.arange(len(want))) == np.array(want)).all()


@pytest.fixture(scope="module")
def vocabulary():
    return packing.Vocabulary(TOKENS)


def test_words_have_the_ids_that_texts_have(vocabulary):
    import pyarrow as pa

    signs = list("aBé.,'!? \n\t\x0b\x1c\x85\xa0😀İſK1٣ﬁ́क़שּׁΣςǅⅷªm") + ["<|", "endoftext", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "n't", "'LL", "한국", "ß.", "A.b", "...", "  "]
    r = random.Random(5)
    for k in range(40):
        texts = [None, "", *("".join(r.choice(signs) for _ in range(r.randint(1, 40))) for _ in range(12))]
        if k % 2:
            texts = [t and t.replace("<|", "") for t in texts]
        sizes, ids = vocabulary.encode(pa.array(texts, pa.string()))
        want = [[*vocabulary.tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_forgotten_words_change_nothing(vocabulary, monkeypatch):
    import pyarrow as pa

    texts = pa.array(["one two three", "two, three four five"])
    want = vocabulary.encode(texts)[1].tolist()
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    assert vocabulary.encode(texts)[1].tolist() == want


def whole(pieces, docs, vocabulary):
    """Pieces give back each document's ids and fill each sequence; returns the tokens of sources by sequence."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert len(by_doc) == len(docs)
    for d in docs:
        ids = [*vocabulary.tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(by_doc[d.doc_id], key=lambda p: p.start):
            held = np.array(ids[at : at + p.length], "<u4").tobytes()
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0 and p.ids == held and p.ids_crc32 == zlib.crc32(held)
            at += p.length
        assert at == len(ids)
    sizes, shares = [], []
    for _, own in sorted(by_sequence.items()):
        at, share = 0, defaultdict(int)
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
            share[p.source] += p.length
        sizes.append(at)
        shares.append(share)
    return sizes, shares


@pytest.mark.parametrize("splits", [1, 7])
def test_packed_documents_by_brute_force(spark, vocabulary, splits):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(splits)
    rows = docs.collect()
    found = packing.packed(docs, TOKENS, 512, with_ids=True)
    pieces = found.collect()
    sizes, shares = whole(pieces, rows, vocabulary)
    total = sum(sizes)
    full = total // 512
    assert sizes[:full] == [512] * full and all(n < 512 and n & (n - 1) == 0 for n in sizes[full:]) and len(sizes) - full == (total % 512).bit_count()
    by_source = defaultdict(int)
    for p in pieces:
        by_source[p.source] += p.length
    for n, share in zip(sizes[:full], shares):
        assert all(abs(share[s] - n * t / total) < 2 for s, t in by_source.items())
    made = packing.sequences(found, 512).collect()
    assert all(len(r.ids) == (2048 if r.sequence_id < full else 4 * r.n_tokens) for r in made) and sum(r.n_tokens for r in made) == total


def test_given_weights_hold_until_a_queue_is_empty(spark, vocabulary):
    words = "one two three four five six seven eight"
    rows = [(k, f"{words} " * 20, "a" if k % 4 else "b") for k in range(40)] + [(99, f"{words} " * 30, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = packing.packed(docs, TOKENS, 256, weights={"a": 0.5, "b": 0.25}, with_ids=True).collect()
    sizes, shares = whole(found, docs.collect(), vocabulary)
    early = [s for n, s in zip(sizes, shares) if n == 256][:3]
    assert all(abs(s["a"] - 128) < 2 and abs(s["b"] - 64) < 2 and abs(s[None] - 64) < 2 for s in early)


def test_sources_beyond_number_share_a_queue(spark, vocabulary):
    docs = spark.createDataFrame([(k, "one two three " * (k % 5), f"s{k}" if k % 3 else "big") for k in range(400)], "doc_id long, text string, source string")
    _, sizes, rates = packing.queued(packing.tokenized(docs, TOKENS), 64)
    assert len(sizes) == len(rates) <= 64
    whole(packing.packed(docs, TOKENS, 64, with_ids=True).collect(), docs.collect(), vocabulary)


def test_packing_joined_is_packing_broadcast(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at_once = sorted(map(tuple, packing.packed(docs, TOKENS).collect()), key=str)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    monkeypatch.setitem(spark.conf.__dict__, "_none", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, packing.packed(docs, TOKENS).collect()), key=str) == at_once
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_packing_odd_rows(spark, vocabulary):
    schema = "doc_id long, text string, source string, src string, ids string, block long"
    rows = [(None, None, None, "x", "y", 1), (1, "", "a", None, None, None), (2, "word " * 30_000, "a", None, None, None), (3, "twin", "b", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    whole(packing.packed(docs, TOKENS, with_ids=True).collect(), docs.collect(), vocabulary)
    twins = packing.packed(docs.where("doc_id = 3").union(docs.where("doc_id = 3")), TOKENS, 4).collect()
    assert sum(p.length for p in twins) == 2 * twins[0].doc_tokens
    assert packing.packed(docs.where("false"), TOKENS).collect() == []
    with pytest.raises(ValueError):
        packing.packed(docs, TOKENS, 100)


# ---- repair


def cheapest(rows):
    """(cost, audit) by trying all edits."""
    found, best = repair.faults(rows), (3 * len(rows), "D" * len(rows))

    def go(i, out, cost, audit, put):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            best = min(best, (cost, audit))
        if put < 3:
            for r in "ua":
                go(i, out + r, cost + 2, audit + "I", put + 1)
        if i < len(rows):
            go(i + 1, out, cost + 3, audit + "D", 0)
            if found[i] not in ("blank", "duplicate"):
                more = found[i] == "truncated"
                go(i + 1, out + (rows[i][0][:1] or "?"), cost + more, audit + "K", 0)
                for r in "ua":
                    go(i + 1, out + r, cost + 2 + more, audit + "R", 0)

    go(0, "", 0, "", 0)
    return best


def test_cheapest_repairs_by_brute_force():
    for seed in range(1500):
        r = random.Random(seed)
        rows = [(r.choice(["user", "assistant", "system", "tool", "", "u"]), r.choice(["a.", "b", "", "c!", " \t", "e"])) for _ in range(r.randint(0, 5))]
        _, cost, audit, out = repair.repaired(rows)
        assert (cost, audit) == cheapest(rows)
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0][:1] or "?" for x in out))
        i, left = 0, iter(out)
        for letter in audit:
            if letter == "D":
                i += 1
            elif letter == "I":
                assert next(left)[1] == ""
            else:
                assert next(left) == rows[i] if letter == "K" else next(left)[1] == rows[i][1]
                i += 1
        assert i == len(rows) and next(left, None) is None


def test_a_long_conversation_is_repaired_in_linear_time():
    rows = [("user" if k % 3 else "assistant", f"turn {k}.") for k in range(30_000)]
    assert len(repair.repaired(rows)[2]) >= 30_000


def test_damage_and_gaps(spark):
    rows = [(c, t, r, x) for c in range(60) for t, r, x in [(None, None, None), (0, "user", "Is it? Yes."), (2, "assistant", "No."), (5, "user", "")]]
    got = {(r.conv_id, r.turn): [tuple(x) for x in r.rows] for r in repair.damaged(spark.createDataFrame(rows, TURNS)).collect()}
    for c, t, r, x in rows:
        k, r, x = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20, r if r is not None else " ", x if x is not None else " "
        want = [] if k == 0 else [(r, "")] if k == 1 else [(r, re.sub("[.!?]", "", x))] if k == 2 else [(r, x)] * 2 if k == 3 else [("user", x)] if k == 4 else [(r, x)]
        assert got[c, t] == want
    lists = {r.conv_id: r for r in repair.gathered(repair.damaged(spark.createDataFrame(rows, TURNS))).select("*", repair.gaps(F.col("turns")).alias("gaps")).collect()}
    for c, r in lists.items():
        there = sorted({t for (d, t), x in got.items() if d == c and t is not None and x})
        assert r.gaps == (there[-1] - there[0] + 1 - len(there) if there else 0)
        assert [tuple(x) for x in r.rows] == [x for t in (None, 0, 2, 5) for x in got[c, t]]


def test_repair_odd_rows(spark):
    dropped = next(c for c in range(999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(None, 0, "user", "nobody's"), (dropped, 0, "user", "gone"), (5000, None, None, None), (5001, 0, "user", "x" * 200_000)]
    wide = spark.createDataFrame(rows, TURNS).select("*", *(F.lit("own").alias(c) for c in ("kind", "rows", "r", "turns", "cost")))
    got = {r.conv_id: r for r in repair.repairs(repair.gathered(repair.damaged(wide))).collect()}
    assert set(got) == {dropped, 5000, 5001}
    assert (got[dropped].cost, got[dropped].audit, got[dropped].repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repairs(repair.gathered(repair.damaged(spark.createDataFrame([], TURNS)))).collect() == []


def test_the_queries_cover_their_tables(spark):
    n = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    assert queries.op13_repair(spark, SF).count() == n
    assert queries.op11_trie(spark, SF).where("depth = 0").first().n_convs == n
