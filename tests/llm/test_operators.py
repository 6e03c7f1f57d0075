"""Each operator against a brute-force version, an exact round trip, or held-out labels."""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import chat, decontaminate, langid, mixing, pii, queries, rules, simhash, urls
from marginalia.llm.components import components

SF = "/root/testdata/sf0.001"


def test_links_are_all_pairs_within_four_bits(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 6))) for b in base for _ in range(6)]
    fps = sorted({simhash._signed(x) for x in base + near + [0, 1, 15, 31, (1 << 64) - 1]})
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    d = spark.createDataFrame([(x,) for x in fps], "fp long")
    for groups in (5, 7, 8, None):
        got = [tuple(r) for r in simhash.links(d, 4, groups).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_cells_are_never_broadcast(spark):
    # two fingerprints are far below any bound on broadcasts, and their cells are still sorted and merged
    d = spark.createDataFrame([(0,), (1,)], "fp long").repartition(2)
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 1 << 20
    met = simhash.links(d, 4)
    assert [tuple(r) for r in met.collect()] == [(0, 1)]
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "isFinalPlan=true" in plan


def test_the_pipeline_broadcasts_no_cells(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(simhash, "components", lambda met: seen.append(met) or components(met))
    rows = [(k, f"{k} quick foxes run {k * 7} miles", "en", "web", 5) for k in range(20)] + [(90, "3 quick foxes run 21 miles", "en", "web", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert 90 not in {r["doc_id"] for r in kept} and len(kept) <= 20 and len(seen) == 1
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def _joins(df):
    """The joins of the plan that ran, once all of its rows are made."""
    df.collect()
    return [x for x in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines() if "Join" in x]


def test_the_rows_that_stay_are_never_broadcast(spark):
    d = spark.createDataFrame([(k, f"{k} quick foxes run {k * 7} miles") for k in range(20)], "doc_id long, text string")
    kept = [x for x in _joins(simhash.keep_one(d)) if "LeftSemi" in x]
    assert len(kept) == 1 and "SortMergeJoin" in kept[0]


def test_the_mix_broadcasts_no_turns_or_slots(spark):
    d = spark.range(3000).selectExpr("id as doc_id", "repeat('so many words ', cast(id % 50 as int)) as text", "concat('source ', id % 3) as source")
    joins = _joins(mixing.pieces(d, block_words=16, keep=("doc_id", "text", "source")))
    by_slot = [x for x in joins if "rank#" in x or "range#" in x]
    assert len(by_slot) == 2 and all("SortMergeJoin" in x for x in by_slot)
    # the numbers of slots, a row for each source, stand on the right
    by_source = [x for x in joins if re.search(r"Join \[src#\d+\], \[src#\d+\]", x)]
    assert len(by_source) == 1 and "BuildRight" in by_source[0]


def test_finer_cells_for_more_fingerprints():
    chosen = [simhash.groups_for(10**k) for k in range(2, 11)]
    assert chosen == sorted(chosen) and chosen[0] <= 7 < chosen[-1]
    for n in (10**5, 10**9):
        g = simhash.groups_for(n)
        met = math.comb(g, 4) * n / 2 * 0.375 ** ((g - 4) * 32 // g)
        assert met < 40 * math.comb(g, 4)  # chance meetings of one fingerprint, against its cells


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}


def _plain_fingerprint(text):
    import xxhash

    w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << k for k in range(64) if hs and 2 * sum(h >> k & 1 for h in hs) > len(hs))


def test_near_groups_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], _plain_fingerprint(r["text"])) for r in docs.collect()]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if (x ^ y).bit_count() <= 4:
                r, s = sorted((root(a), root(b)))
                parent[s] = r
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, SF).collect()}
    assert got == {i: (f"{x:016x}", root(i)) for i, x in rows}


def test_decontamination_by_brute_force(spark):
    rng = random.Random(2)
    vocab = ["ab", "cd", "é9", "xy", "zz"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.randint(1, 9))) for k in range(8)]
    docs = [(k, text(rng.randint(0, 60)).upper().replace(" ", ", ")) for k in range(40)]
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (500_000, 3):
        got = {r["doc_id"]: (r["n_words"], [(s["a"], s["b"]) for s in r["spans"]], sorted(r["items"]), r["longest"]) for r in decontaminate.marked(d, b, 4, block).collect()}
        for k, t in docs:
            own, hit, found = w(t), set(), set()
            for i, it in items:
                x = w(it)
                n = min(4, len(x))
                for o in range(len(x) - n + 1):
                    for p in range(len(own) - n + 1):
                        if own[p : p + n] == x[o : o + n]:
                            hit.update(range(p, p + n))
                            found.add(i)
            assert got[k][0] == len(own) and got[k][2] == sorted(found)
            assert {p for a, z in got[k][1] for p in range(a, z)} == hit
            runs = []
            for i, it in items:
                x = w(it)
                for o in range(len(x) - min(4, len(x)) + 1):
                    for p in range(len(own)):
                        n = 0
                        while o + n < len(x) and p + n < len(own) and x[o + n] == own[p + n]:
                            n += 1
                        if n >= min(4, len(x)):
                            runs.append((-n, p))
            want = min(runs, default=None)
            assert (want is None) == (got[k][3] is None) and (want is None or (-want[0], want[1]) == (got[k][3]["n_words"], got[k][3]["doc_start"]))
            if want:
                i, o, n, p = (got[k][3][c] for c in ("item_id", "item_start", "n_words", "doc_start"))
                assert w(dict(items)[i])[o : o + n] == own[p : p + n]


def test_longest_matches(spark):
    d = spark.createDataFrame([(1, "x a b c d e y"), (2, "a b c q")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "z a b c d e f")], "item_id long, text string")
    got = {(r["item_start"], r["n_words"], r["doc_id"], r["doc_start"]) for r in decontaminate.longest_matches(d.coalesce(1), b, 3).collect()}
    assert got == {(1, 5, 1, 1), (2, 4, 1, 2), (3, 3, 1, 3)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 50))
def test_suffix_arrays_sort_suffixes(tokens, depth):
    order = decontaminate.suffix_array(np.array(tokens, np.int64), depth).tolist()
    assert sorted(order) == list(range(len(tokens)))
    assert [tokens[i : i + depth] for i in order] == sorted(tokens[i : i + depth] for i in range(len(tokens)))


PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _fine(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        odd = [int(c) for c in digits[::-1]]
        return 13 <= len(digits) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(odd)) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab.@-+_%01259 ()\né", max_size=40))
def test_base_spans_are_those_of_the_patterns(text):
    want = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in p.finditer(text) if _fine(k, m.group())]
    assert pii.base_spans(text) == want


def test_long_runs_take_little_time():
    import time

    t = time.time()
    for s in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1" * 100_000, "@" * 200_000):
        pii.base_spans(s)
    assert time.time() - t < 10


def test_private_spans(spark):
    rows = [(k, f"filler words here {k}. call +1 (555) 555-01{k % 90 + 10} now or x{k}@mail.example.com, token = \"{'%032x' % (k * 7919 + 12345)}\" end") for k in range(200)]
    rows.append((999, "see +1 (208) 555-1177 4284896609045836 and password=7602ad27cf5550de1c there"))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_private(d, pii.fit(d)).collect()}
    text = dict(rows)
    base = sum(len(r["base"]) for r in got.values())
    assert base >= 390
    secrets = sum(any(s["kind"] == "secret" for s in r["spans"]) for r in got.values())
    assert secrets >= 190
    for i, r in got.items():
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}
        assert [s[0] for s in pii.base_spans(text[i])] == [s["kind"] for s in r["base"]]


def _all_segmentations(n):
    if n == 0:
        yield []
        return
    for k in range(min(pii.LONGEST, n)):
        for rest in _all_segmentations(n - k - 1):
            for y in range(len(pii.STATES)):
                yield [*rest, (n - 1, k, y)]


def test_decoding_and_chances_by_brute_force():
    rng = np.random.default_rng(3)
    text = "call me at 555 0100 now, password: horse and x=1"
    for cut in (text[:27], text[25:], "a 1 2"):
        for units in pii.windows(cut):
            model, noted, every = pii.SemiMarkov({}), pii.of_note(cut, units), []
            for j in range(len(units)):
                for k in range(min(pii.LONGEST, j + 1)):
                    for f in pii.features(cut, units, j - k, j):
                        model.weights.setdefault(f, rng.normal(0, 1, len(pii.STATES)))
            ending = [model.ending(cut, units, j, noted) for j in range(len(units))]
            for way in _all_segmentations(len(units)):
                parts = [ending[j][k][y] if ending[j][k] is not None else -1e9 for j, k, y in way]
                if min(parts) > -1e8:
                    every.append((float(sum(parts)), way))
            total, chances = pii.expected(model, cut, units)
            assert total == pytest.approx(float(np.logaddexp.reduce([v for v, _ in every])))
            for (j, k), got in chances.items():
                for y in range(len(pii.STATES)):
                    want = sum(math.exp(v - total) for v, way in every if (j, k, y) in way)
                    assert got[y] == pytest.approx(want, abs=1e-9)
            best = max(every)[1]
            shown = [(pii.STATES[y], *(pii.valued if pii.STATES[y] == "secret" else pii.trimmed)(cut, units[j - k][0], units[j][1])) for j, k, y in best if y]
            assert len(list(pii.windows(cut))) > 1 or [s for s in model.decode(cut)][::-1] == [s for s in shown if s[1] < s[2]]


def test_windows_have_no_bound_and_names_give_secrets():
    text = " ".join(f"{k}" for k in range(5000))
    assert [len(u) for u in pii.windows(text)] == [5000]
    for said in ("the password: correcthorse is", 'token: "abcdefghij" is', "api_key = abcdefghij is"):
        (units,) = pii.windows(said)
        assert any(n and said[a:b].strip('"').startswith(("correct", "abcdef")) for n, (a, b) in zip(pii.of_note(said, units), units))
    assert list(pii.windows("a secret of the token ring, and the password to it")) == []


def test_secrets_on_other_templates(spark):
    """Learned on one way to say it, looked for in others; plain prose is left alone."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    token = lambda: "".join(rng.choice("abcdef0123456789") for _ in range(32))
    learn = [(k, f"{word()} {word()} {word()} token = \"{token()}\" {word()} {word()} password={token()[:18]} and {rng.randint(1, 99)} {word()} in {rng.randint(1900, 2030)}, {word()} =") for k in range(400)]
    model = pii.fit(spark.createDataFrame(learn, "doc_id long, text string"))
    told = [f"{word()} {word()} secret: {(t := token())} {word()}, {rng.randint(2, 40)} {word()}" for _ in range(100)]
    found = sum(any(k == "secret" for k, _, _ in pii.spans_of(t, model)[1]) for t in told)
    plain = [f"{word()} {word()} {rng.randint(1, 500)} {word()} in {rng.randint(1900, 2030)}. {word()} @ {word()} {rng.randint(2, 40)} {word()}" for _ in range(300)]
    wrong = sum(bool(pii.spans_of(t, model)[1]) for t in plain)
    assert found >= 90 and wrong <= 3


def _mixed(rows, weights=(3, 1, 2)):
    import hashlib

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    total = {n: sum(size(t) for _, t, s in rows if s == n) for n in names}
    w = {n: weights[k % 3] for k, n in enumerate(names)}
    left, target, free = 1.5 * sum(total.values()), {}, set(names)
    while free:
        level = left / sum(w[n] for n in free)
        over = {n for n in free if w[n] * level > 2 * total[n]}
        if not over:
            target |= {n: w[n] * level for n in free}
            break
        for n in over:
            target[n] = 2.0 * total[n]
            left -= target[n]
        free -= over
    out = []
    for n in names:
        at, stop = 0, math.floor(target[n] + 1e-9)
        for i, t, _ in sorted((r for r in rows if r[2] == n), key=lambda r: (hashlib.md5(f"mix:{r[0]}".encode()).hexdigest(), r[0])):
            k = size(t)
            out.append((i, k, total[n], round(target[n], 6), sum(max(0, min(b + k, stop) - b) for b in (at, at + total[n]))))
            at += k
    return sorted(out)


@pytest.mark.parametrize("block", [8, 100, 8192])
def test_mix_by_brute_force(spark, block):
    rng = random.Random(block)
    rows = [(k, " ".join(["w"] * rng.randint(0, 50)), rng.choice(["a", "a", "a", "b", "ü", "", None])) for k in range(300)] + [(1000, "one", "tiny"), (1001, "", "empty")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mixing.mix(d, block_words=block).collect())
    assert got == _mixed(rows)


@pytest.mark.parametrize("block", [8, 8192])
def test_pieces_of_the_mix(spark, block):
    rng = random.Random(block)
    rows = [(k, " " * (k % 3) + "\n ".join(f"{k}w{i}" for i in range(rng.randint(0, 50))) + " " * (k % 2), rng.choice(["a", "a", "a", "b", "ü", "", None])) for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.pieces(d, block_words=block, keep=("doc_id", "text", "source"))
    out = out.select("*", F.explode(mixing.with_texts(F.col("text"), F.col("size"), F.col("pieces"))).alias("p"))
    out = out.select("doc_id", "text", "source", "size", "target", "taken", "p.slot", "p.place", "p.turn", "p.first", "p.last", F.col("p.text").alias("piece"))
    got = sorted(out.collect(), key=lambda r: (r["slot"], r["place"]))
    own, lines = defaultdict(list), defaultdict(list)
    for r in got:
        assert r["piece"].split() == r["text"].split()[r["first"] : r["last"]]
        own[r["doc_id"], r["turn"]].append(r)
        lines[r["source"]].append(r)
    assert {(i, n) for i, _, _, _, n in _mixed(rows) if n} == {(r["doc_id"], r["taken"]) for r in got}
    for i, _, _, _, n in _mixed(rows):
        assert sum(r["last"] - r["first"] for t in (0, 1) for r in own[i, t]) == n
    for p in own.values():
        whole = p and p[-1]["last"] == p[0]["size"]
        assert not whole or "".join(r["piece"] for r in p) == p[0]["text"]
    # slots go along each source's line without gaps, up to its target, so the rows' words are the target's
    for p in lines.values():
        assert p[0]["place"] == 0 and all(x["place"] + x["last"] - x["first"] == y["place"] for x, y in zip(p, p[1:]))
        assert p[-1]["place"] + p[-1]["last"] - p[-1]["first"] == math.floor(p[0]["target"] + 1e-9)
    # and the sources alternate instead of standing one behind the other
    names = [r["source"] for r in got]
    assert block > 8 or sum(x != y for x, y in zip(names, names[1:])) > len(lines) * 5


def test_schedule_is_low_in_discrepancy(spark):
    aims = spark.createDataFrame([("sa", 60_000, 90_000.0), ("sb", 30_000, 30_000.0), ("sc", 10, 3.0)], "src string, source_size long, target double")
    rows = sorted(mixing.schedule(aims, 16).collect(), key=lambda r: r["slot"])
    assert len({r["slot"] for r in rows}) == len(rows)
    for n in (64, 500, 3000):
        assert abs(sum(r["src"] == "sa" for r in rows[:n]) - 0.75 * n) <= 2 + math.log2(n)
    for s, target in (("sa", 90_000), ("sb", 30_000), ("sc", 3)):
        own = [r for r in rows if r["src"] == s]
        assert [r["rank"] for r in own] == list(range(len(own)))
        assert own[0]["first"] == 0 and own[-1]["last"] == target and all(x["last"] == y["first"] for x, y in zip(own, own[1:]))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="<[/\\|s]>INTSYimend_%0A\n", max_size=30), min_size=1, max_size=12))
def test_chat_round_trip(spark, texts):
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts + ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "<<SYS>>x<</SYS>><\\s>"])]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    r = chat.read_back(out).first()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3]) for x in rows]
    assert r["loss_texts"] == [x[3] for x in rows if x[2] == "assistant"]
    assert r["formatted"].count("<|im_end|>\n") == len(rows) and "</s>" not in r["formatted"] and "[INST]" not in r["formatted"]


def test_layouts(spark):
    a = spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, response string").withColumn("score", F.lit(1))
    assert [(r["role"], r["text"]) for r in chat.turn_rows(a).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    b = spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<`from`:string,value:string>>")
    assert [(r["role"], r["text"]) for r in chat.turn_rows(b).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat.turn_rows(spark.createDataFrame([(1, "x")], "conv_id long, body string"))
    records = [{"instruction": "do", "input": "this", "output": "ok"}, {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, {"question": "q", "answer": "a"}, {"other": 1}]
    rows = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(9, "no json")], "conv_id long, record string")
    got = defaultdict(list)
    for r in chat.json_turn_rows(rows).orderBy("conv_id", "turn").collect():
        got[r["conv_id"]].append((r["layout"], r["role"], r["text"]))
    assert got[0] == [("instruction-input-output", "user", "do\n\nthis"), ("instruction-input-output", "assistant", "ok")]
    assert got[1] == [("messages", "system", "s"), ("messages", "user", "u")]
    assert got[2][0][0] == "question-answer" and got[3] == got[9] == [(None, None, None)]


def test_rule_counts_by_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 40))]
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {p for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
        assert rules.counted(" ".join(w))[4] == len(hit)
    assert rules.counted("a #b\n\n \na #b\nç|") == (5, 8, 3, 1, 0)


def _kneser_ney(texts, order):
    """Modified Kneser-Ney by dictionaries, for one language."""
    grams = [b"\n" * (order - 1) + t.encode() for t in texts]
    top = Counter(g[i : i + order] for g in grams for i in range(len(g) - order + 1))
    level, levels = top, {order: top}
    for k in range(order - 1, 0, -1):
        level = Counter(g[1:] for g in level)
        levels[k] = level
    prob, back = {}, {}
    for k in range(1, order + 1):
        c = levels[k]
        n = [sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        part = lambda j, v: max(0.05, min(j - 0.05, v)) if n[0] else 0.5
        ratio = lambda a, b: n[b] / n[a] if n[a] else 0.0
        d = [part(1, 1 - 2 * y * ratio(0, 1)), part(2, 2 - 3 * y * ratio(1, 2)), part(3, 3 - 4 * y * ratio(2, 3))]
        cut = lambda v: d[min(v, 3) - 1]
        total, free = Counter(), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            free[g[:-1]] += cut(v)
        for g, v in c.items():
            low = 1 / 256 if k == 1 else prob[g[1:]]
            prob[g] = (v - cut(v)) / total[g[:-1]] + free[g[:-1]] / total[g[:-1]] * low
        back.update({c: free[c] / total[c] for c in total})

    def chance(g):
        """The last byte's probability, by the longest order that has the gram."""
        p = 1.0
        for k in range(order, 0, -1):
            if g[-k:] in prob:
                return p * prob[g[-k:]]
            p *= back.get(g[-k:-1], 1.0)
        return p / 256

    return lambda t: -sum(math.log2(chance(g[i : i + order])) for g in [b"\n" * (order - 1) + t.encode()] for i in range(len(g) - order + 1)) / len(t.encode())


def _odd_texts(spark):
    rng = random.Random(6)
    rows = [(k, "".join(rng.choice("abcé ") for _ in range(rng.randint(5, 60))), ("xx", "xx", "xx", "", "und", None)[k % 6]) for k in range(60)]
    rows += [(98, "zzz qqq", "xx"), (99, "", "xx"), (100, None, None), (101, rows[0][1], "xx"), (102, "alone", "once")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("shipped", [10**6, 1])
def test_perplexity_by_brute_force(spark, shipped):
    d = _odd_texts(spark)
    rows = rules.dealt_to_folds(d).collect()
    assert len({r["band"] for r in rows}) == 5 and {r["fold"] for r in rows} == {"0", "1"}
    got = {r["doc_id"]: r["bits"] for r in rules.judged(d, order=3, shipped=shipped).collect()}
    for r in rows:
        others = [x["text"] for x in rows if x["band"] == r["band"] and x["fold"] != r["fold"] and x["text"]]
        if not r["text"]:
            assert got[r["doc_id"]] is None
        else:
            assert got[r["doc_id"]] == pytest.approx(_kneser_ney(others, 3)(r["text"]), rel=1e-4)
    assert got[101] == got[0] and got[102] == pytest.approx(8.0)


def test_both_ways_of_scoring_agree(spark):
    a, b = ({r["doc_id"]: (r["bits"], r["kept"], r["base_failed"]) for r in rules.judged(_odd_texts(spark), order=4, shipped=n).collect()} for n in (10**6, 1))
    assert a.keys() == b.keys()
    for i, (bits, *verdicts) in a.items():
        assert b[i][1:] == tuple(verdicts) and (bits is None and b[i][0] is None or b[i][0] == pytest.approx(bits, rel=1e-12))


def test_scores_are_asked_for_once_a_gram_and_texts_stay_in_their_tasks(spark):
    texts = [(k, " ".join(random.Random(k).choices(["abc", "bd", "cab", "dé"], k=40)), "xx") for k in range(200)]
    rows = rules.dealt_to_folds(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    top = rules.counts(rows.select("text", F.concat("fold", "band").alias("lang"))).persist()
    known = rules.scores(top, rules.kneser_ney(top))
    assert known.count() == known.select("key", "gram").distinct().count() == top.count()
    plan = rules.measured(rows.withColumn("key", F.concat(rules.other_fold(F.col("fold")), F.col("band"))), known, shipped=7)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Join", "Generate"))


def test_bands_reject_what_is_no_language(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("aeiou" if k % 2 else "bdlmnrst") for k in range(rng.randint(2, 7))) for _ in range(300)]
    rows = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(30, 120))), "xx") for k in range(400)]
    keys = "qwxzjkpvyQWXZ#0123456789%="
    junk = [(1000 + k, " ".join("".join(rng.choice(keys) for _ in range(6)) for _ in range(50)), "xx") for k in range(5)]
    flat = [(2000 + k, " ".join([vocab[k]] * 5 + [vocab[k + 1]] * 5 + [vocab[k + 2]] * 6 + [vocab[k + 3]] * 6), "xx") for k in range(3)]
    d = spark.createDataFrame(rows + junk + flat, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["kept"], r["base_failed"]) for r in rules.judged(d).collect()}
    assert all(got[1000 + k] == (False, False) for k in range(5))
    assert sum(got[k][0] for k in range(400)) >= 398


def test_digests_confirm_strings(tmp_path):
    names = urls.Digests.write(urls.Digests.arrays([("a.com", "", "block"), ("b.com", "/x", "allow"), ("a.com", "", "allow")]), str(tmp_path), "t")
    assert len(names) == 5
    d = urls.Digests(str(tmp_path), "t")
    assert d.longest([("www.a.com", "/q"), ("b.com", "/y"), ("x.b.com", "/xy"), ("", "")]) == [("a.com", "allow"), (None, None), ("b.com/x", "allow"), (None, None)]


def test_a_list_is_packed_by_spark(spark):
    n = 30_000
    listed = spark.range(n).select(F.format_string("h%s.example", "id").alias("host"), F.when(F.col("id") % 5 == 0, "/p").alias("path"), F.when(F.col("id") % 7 == 0, "allow").otherwise("block").alias("verdict"))
    listed = listed.unionByName(listed.where("host in ('h7.example', 'h1.example')").withColumn("verdict", F.lit("block"))).unionByName(spark.createDataFrame([(None, "/x", "block")], "host string, path string, verdict string"))
    pages = spark.range(0, 2 * n, 3).select(F.col("id").alias("page_id"), F.format_string("http://www.h%s.example/p/q", "id").alias("url"))
    got = {r["page_id"]: (r["listed"], r["verdict"]) for r in urls.judge(pages, [], listed, block_entries=8_000).collect()}
    for k in range(0, 2 * n, 3):
        known = k < n
        assert got[k] == ((f"h{k}.example" + "/p" * (k % 5 == 0), "allow" if k % 7 == 0 and k != 7 else "block") if known else (None, "allow"))


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9, 40])
def test_codewords_are_apart(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and len({tuple(r) for r in code.tolist()}) == n


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op5_language(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert rows.where("lang_pred = lang").count() >= 0.98 * rows.count()
    for f, y in ((queries.op1_quality, "quality"), (queries.op2_toxicity, "toxic")):
        rows = f(spark, sf).join(labels, "doc_id").where("held_out")
        assert rows.where(f"predicted = {y}").count() >= 0.9 * rows.count()


def test_pipeline_by_brute_force(spark):
    """The stages one by one in Python over the small tables, with the models that the stages fit."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    coder = langid.fit(docs)
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if not coder.decide(r["text"])[2]]
    prints = {r["doc_id"]: _plain_fingerprint(r["text"]) for r in rows}
    groups: list[set] = []
    for i, x in sorted(prints.items()):
        touching = [g for g in groups if any((x ^ prints[j]).bit_count() <= 4 for j in g)]
        groups = [g for g in groups if g not in touching] + [set().union({i}, *touching)]
    stay = {min(g) for g in groups}
    rows = [r for r in rows if r["doc_id"] in stay]
    w = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    wins = {tuple(x[o : o + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for x in [w(r["text"])] for o in range(max(1, len(x) - 9)) if x}
    rows = [r for r in rows if not any(tuple(x[p : p + n]) in wins for x in [w(r["text"])] for n in {len(t) for t in wins} for p in range(len(x) - n + 1))]
    kept = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    model = pii.fit(kept)
    rows = [r | {"text": pii.redacted(r["text"], pii.spans_of(r["text"], model)[1])} for r in rows]
    want = {i: taken for i, size, _, _, taken in _mixed([(r["doc_id"], r["text"], r["source"]) for r in rows]) if taken or not size}
    got = {r["doc_id"]: r["taken"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_the_mix_agrees_however_rows_are_dealt(spark):
    # one id and one size, texts apart, besides whole copies: what is kept decides the order
    rows = [(7, f"a{i % 3} b c", "s") for i in range(9)] + [(i, "x y " * i, "t") for i in range(1, 6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [sorted(map(str, mixing.pieces(d.repartition(n), block_words=4, keep=("doc_id", "text", "source")).collect())) for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == len(rows)


def test_rows_of_the_mix_follow_the_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = corpus_pipeline.in_pieces(corpus_pipeline.mixture(spark, docs, SF)).where("slot is not null").select("source", "target", F.length("text").alias("n"), "n_chars", mixing.word_count(F.col("text")).alias("words")).collect()
    words, target = Counter(), {}
    for r in rows:
        words[r["source"]] += r["words"]
        target[r["source"]] = math.floor(r["target"] + 1e-9)
        assert r["n"] == r["n_chars"]
    assert words == target


def test_queries_have_a_row_for_each_row(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op6_rules", "op7_mix", "op8_private"):
        assert queries.queries()[name](spark, SF).count() == n
