"""Literals that patterns require, and catalogues of one's own gated by them."""

from __future__ import annotations

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from marginalia.operators import gates
from marginalia.operators.rules import METRICS, RULES, Rule, tell_matches
from marginalia.plans import gauge as plan
from marginalia.seeds import seeded
from marginalia.sources import readers


def pattern(r, depth=0):
    k, word = r.random(), lambda: "".join(r.choice("abcdeABC") for _ in range(r.randint(1, 5)))
    more = lambda: pattern(r, depth + 1)
    if depth > 2 or k < 0.35:
        return word()
    if k < 0.5:
        return more() + more()
    if k < 0.65:
        return "(" + "|".join(more() for _ in range(r.randint(2, 3))) + ")"
    if k < 0.8:
        return "(?:" + more() + ")" + r.choice(["?", "*", "+", "{0,2}", "{1,2}", "{2}"])
    if k < 0.86:
        return r"\b" + more()
    if k < 0.92:
        return "[" + word() + "]" + more()
    return more() + r.choice([".", r"\w+?", r"\s?", "(?=a)", "(?!zz)", "é"]) + more()


def test_each_match_passes_its_gate():
    gated = matched = 0
    for seed in range(10_000):
        r = random.Random(seed)
        p = pattern(r)
        literals = gates.required(p)
        gated += literals is not None
        for _ in range(4):
            text = [r.choice("abcdeAB .-é") for _ in range(30)]
            for x in sorted(literals or ()):
                text.insert(r.randrange(len(text)), x.upper())
            for m in re.finditer(p, "".join(text), re.I | re.M):
                matched += 1
                assert not m[0] or literals is None or any(x in m[0].lower() for x in literals), (p, literals, m[0])
    assert gated > 4_000 and matched > 20_000


def test_what_is_required():
    assert gates.required(r"\bleverag(e|es|ed)\b") == {"leverage"}
    assert gates.required(r"\b(is|are) (just|merely)\b") == {"just", "merely"}
    assert gates.required(r"it.s (important|worth) noting") == {"noting"}
    assert gates.required(r"a|bcd") is gates.required(r"(abc)?") is gates.required(r"[abc]+") is gates.required(r"ab\d") is gates.required(r"\p{L}foo") is gates.required("(") is None


def test_matches_of_many_rules_by_brute_force(spark):
    r = random.Random(8)
    rules = []
    while len(rules) < 60:
        p = pattern(r)
        # Python and Java agree on what these match, if no match is empty
        if all(m[0] for m in re.finditer(p, "ab cd, e", re.I)) and "é" not in p and "(?=" not in p and not re.search(r"(?<=\w)\.(?=\w)", p):
            rules.append(Rule(f"r{len(rules)}", "W", "x", (p,)))
    texts = ["", None, "ſtrange İ", *(" ".join("".join(r.choice("abcdeAB") for _ in range(r.randint(1, 8))) for _ in range(25)) for _ in range(40))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", F.explode(tell_matches(F.col("text"), rules)).alias("m")).select("doc_id", "m.rule", "m.start", "m.end", "m.matched")
    want = [(d, x.id, m.start(), m.end(), m[0]) for d, t in enumerate(texts) if t for x in rules for m in re.finditer(x.patterns[0], t, re.I | re.M) if m[0]]
    assert sorted(map(tuple, rows.collect())) == sorted(want) and len(want) > 300


def test_letters_that_fold_pass_every_gate(spark):
    rows = spark.createDataFrame([(1, "a ſtrange Kelvin word"), (2, "a strange kelvin word")], "doc_id long, text string")
    own = [Rule("s", "W", "x", ("strange",)), Rule("k", "W", "x", ("kelvin",))]
    found = rows.select("doc_id", F.explode(tell_matches(F.col("text"), own)).alias("m")).select("doc_id", "m.rule").collect()
    assert sorted(map(tuple, found)) == [(1, "k"), (1, "s"), (2, "k"), (2, "s")]


def test_five_hundred_rules_cost_less_than_three_times_the_built_in_ones(spark):
    r = random.Random(2)
    docs = seeded(spark, "/root/testdata/sf0.01").select("text").repartition(4).cache()
    words = sorted({w for t in docs.limit(200).collect() for w in re.findall("[a-z]{6,}", t["text"])})
    rules = [Rule(f"own{k}", "W", "x", (rf"\b{w}(s|ed|ing)?\b",)) for k, w in enumerate(r.sample(words, 500))]
    docs.count()

    def seconds(own):
        plan = docs.select(F.size(tell_matches(F.col("text"), own)).alias("n"))
        took = []
        for _ in range(3):
            began = time.perf_counter()
            plan.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    built_in, many = seconds(RULES), seconds(rules)
    print("seconds:", built_in, many)
    assert many < 3 * built_in + 0.5


def test_a_catalogue_of_ones_own_from_a_file(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    own = {"metrics": {"min_sentences_for_rhythm": 2}, "rules": [{"id": "fox", "tier": "W", "message": "a fox", "patterns": [r"\bfox(es)?\b"]}, {"id": "ox", "tier": "Q", "message": "an ox", "patterns": [r"\box\b"], "weight": 1}]}
    (tmp_path / "own.yaml").write_text(yaml.safe_dump(own))
    (tmp_path / "own.json").write_text(json.dumps(own))
    docs = spark.createDataFrame([(1, "The fox and the ox are here. The fox went on to the other side now. Yes it did so.")], "doc_id long, text string")
    for name in ("own.yaml", "own.json"):
        path = str(tmp_path / name)
        assert readers.metrics_from(path) == {**METRICS, "min_sentences_for_rhythm": 2}
        verdict = plan.verdicts(docs, "document", readers.detectors_from(path)).first()
        assert verdict["detectors"] == "tells,forensic,rhetoric,rhythm"
        rows = plan.signals(plan.detected(docs, "document", readers.detectors_from(path))).collect()
        assert [(r["name"], r["weight"]) for r in rows if r["detector"] == "tells"] == [("fox", 0.3), ("ox", 1.0), ("fox", 0.3)]
        assert any(r["detector"] == "rhythm" for r in rows)
    assert readers.metrics_from() == METRICS
