"""The evidence engine: segments, detectors, scores, readers, evaluation, reports, streams."""

from __future__ import annotations

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions.text import matches, running, utf16_offset
from marginalia.operators import edits, evaluate, outliers, placement, readers
from marginalia.operators.detectors import DETECTORS, detectors, detectors_of
from marginalia.operators.rules import RULES, Rule, catalogue, tell_matches
from marginalia.operators.scoring import by_direction, density
from marginalia.operators.segments import segmented, segmenter_of, segmenters
from marginalia.plans import gauge as plan
from marginalia.plans import report
from marginalia.sources import readers as sources
from marginalia.streaming import readings

SF = "/root/testdata/sf0.001"


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def spans(spark, segmenter, *rows):
    out: dict = {i: [] for i in range(len(rows))}
    for r in segmented(texts(spark, *rows), segmenter).orderBy("doc_id", "seg_idx").collect():
        out[r["doc_id"]].append((r["start"], r["end"], r["quote"]))
    return [out[i] for i in range(len(rows))]


def found(spark, text, detector=None, **args):
    segs = plan.detected(texts(spark, text), "document", [detector] if detector else None)
    return [(r["name"], r["direction"], r["start"], r["end"]) for r in plan.signals(segs).orderBy("nth").collect()]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=700), min_size=1, max_size=4))
def test_running_sums(spark, lists):
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, x array<int>")
    for r in d.select("x", running(F.col("x")).alias("s")).collect():
        assert r["s"] == [sum(r["x"][:k]) for k in range(len(r["x"]))]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="ab😀 é", max_size=30), min_size=1, max_size=6))
def test_matches_have_their_places(spark, rows):
    d = texts(spark, *rows).select("text", matches(F.col("text"), "a+|😀b").alias("m"))
    for r in d.collect():
        assert [(m["start"], m["end"], m["matched"]) for m in r["m"]] == [(m.start(), m.end(), m.group()) for m in re.finditer("a+|😀b", r["text"])]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab.! \n\n\t", max_size=25), min_size=1, max_size=8))
def test_paragraphs_and_sentences_lose_nothing(spark, rows):
    p = spans(spark, "paragraph", *rows)
    s = spans(spark, "sentence", *rows)
    for text, paras, sents in zip(rows, p, s):
        for own in (paras, sents):
            assert all(text[a:b] == q for a, b, q in own) and all(x[1] <= y[0] for x, y in zip(own, own[1:]))
        assert all(c in " \n\t" for c in re.sub(r"\S", "", "".join(text[a:b] for a, b in _gaps(text, sents))))
        assert not re.search(r"\S", "".join(text[a:b] for a, b in _gaps(text, sents)))
        assert set("".join(text[a:b] for a, b in _gaps(text, paras))) <= {"\n"}


def _gaps(text, own):
    edges = [0, *(x for a, b, _ in own for x in (a, b)), len(text)]
    return list(zip(edges[::2], edges[1::2]))


def test_where_paragraphs_begin(spark):
    got = spans(spark, "paragraph", "ab\n   \ncd", "ab\n  ", "ab\n\ncd", "\n\n", "", "a\u0001\nb\n\n\u0001\u0002c")
    assert [[q for *_, q in x] for x in got] == [["ab", "   \ncd"], ["ab\n  "], ["ab", "cd"], [], [], ["a\u0001\nb", "\u0001\u0002c"]]
    assert spans(spark, "sentence", ". Foo. a.b c! d")[0] == [(0, 6, ". Foo."), (7, 13, "a.b c!"), (14, 15, "d")]
    assert [len(x) for x in spans(spark, "document", "", "x")] == [1, 1]
    with pytest.raises(KeyError):
        segmenter_of("word")
    assert segmenters(spark).count() == 3


def test_context_and_custom_segmenters(spark):
    text = "x" * 50 + "\n\nmid\n\n" + "y" * 50
    r = segmented(texts(spark, text)).where("seg_idx = 1").first()
    assert (r["prefix"], r["quote"], r["suffix"]) == (text[12:52], "mid", text[55:95])
    halves = lambda t: F.array(F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.substring(t, 1, 2).alias("quote"), F.lit("own").alias("level")))
    out = plan.verdicts(texts(spark, "abcd"), halves).first()
    assert out["segmenter"] == "custom" and out["n_segments"] == 1


HITS = {
    "chat-leftover": ("Certainly! Here it is.", "It is certainly so."),
    "unfilled-placeholder": ("Dear [your name], hi", "Dear [friend], hi"),
    "cutoff-disclaimer": ("as of my last update", "as of last update"),
    "throat-clearing": ("it’s worth noting", "it worth noting"),
    "summary-closer": ("In summary, no.", "in summary no"),
    "ai-vocabulary": ("we delve in", "we dive in"),
    "filler-adverb": ("So. Notably, yes", "So notably, yes"),
    "empty-transition": ("Moreover, yes", "and moreover, yes"),
    "copula-avoidance": ("serves as a", "serves a"),
    "contrastive-negation": ("it isn't just fast, it's good", "it isn't fast, it's good"),
    "ing-trailer": ("done, showcasing it all.", "done showcasing it all."),
    "significance-inflation": ("a new era", "a new area"),
    "vague-attribution": ("Studies show it", "My studies showed it"),
    "sycophancy": ("What a great day", "What great day"),
    "stock-pleasantry": ("happy to help", "glad to help"),
    "rhetorical-opener": ("What if we did?", "So what if we did?"),
    "hedge-stack": ("might possibly", "might be"),
    "triad": ("red, green, and blue", "red, green or blue"),
    "exclamation": ("yes! no", "yes!no"),
}


def test_each_rule_hits_and_misses(spark):
    assert {r.id for r in RULES} == set(HITS)
    names = list(HITS)
    rows = texts(spark, *(t for n in names for t in HITS[n])).select("doc_id", F.transform(tell_matches(F.col("text")), lambda m: m["rule"]).alias("r"))
    got = {r["doc_id"]: r["r"] for r in rows.collect()}
    for k, n in enumerate(names):
        assert n in got[2 * k] and n not in got[2 * k + 1], n


def test_rules_of_ones_own(spark):
    own = (Rule("own", "?", "mine", ("a.b|zz",)), Rule("two", "E", "mine", ("zz",), 0.1))
    r = texts(spark, "zz a'b").select(tell_matches(F.col("text"), own).alias("m")).first()["m"]
    assert [(m["rule"], m["weight"], m["start"]) for m in r] == [("own", 0.15, 0), ("two", 0.1, 0), ("own", 0.15, 3)]
    assert [m["rule"] for m in texts(spark, "zz").select(tell_matches(F.col("text"), own, "E").alias("m")).first()["m"]] == ["two"]
    assert catalogue(spark, "E").count() == 5 and catalogue(spark).count() == 19


def test_quoted_phrases_are_not_the_authors(spark):
    assert found(spark, 'Say "delve" or `delve`, or delve.', "tells") == [("ai-vocabulary", "machine", 27, 32)]


def test_places_survive_letters_that_grow(spark):
    text = "İİ 😀 I value it. However, delve"
    assert [(n, text[a:b]) for n, _, a, b in found(spark, text) if a is not None] == [("concede-pivot", "I value it. However"), ("ai-vocabulary", "delve")]


def test_forensic_and_rhetoric(spark):
    names = lambda t, d=None: sorted(x[0] for x in found(spark, t, d))
    assert names("he said\nand then left", "forensic") == ["mid-sentence-newline", "no-terminal-punctuation"]
    assert names("- he said\nand then left", "forensic") == []
    assert names("a — b don't don’t  → end.  ", "forensic") == ["em-dash", "mixed-apostrophes", "trailing-whitespace", "unicode-artifact", "unicode-artifact"]
    assert names("Four words end here  ", "forensic") == ["no-terminal-punctuation"]
    assert names("Overall it is not merely good enough but great.", "rhetoric") == ["discourse-opener", "not-x-but-y"]
    assert names("One two three four. " * 7, "rhythm") == ["low-burstiness"]
    assert names("One two three. " * 5 + "w " * 60 + ".", "rhythm") == ["high-burstiness"]
    with pytest.raises(KeyError):
        detectors_of(["nope"])
    assert detectors_of(None)[1] == tuple(DETECTORS) and detectors(spark).count() == 6


def _score(spark, weights, n, score=density):
    sig = lambda d, w: F.struct(F.lit(d).alias("direction"), F.lit(float(w)).alias("weight"))
    signals = F.array(*(sig(d, w) for d, w in weights)) if weights else F.array().cast("array<struct<direction:string,weight:double>>")
    r = spark.range(1).select(score(signals, F.lit(n)).alias("v")).first()["v"]
    return r["lean"], r["strength"], r["label"]


def test_scores_at_their_edges(spark):
    assert _score(spark, [], 10) == (0.0, 0.0, "no-evidence")
    assert _score(spark, [("human", 0.6)], 10) == (-1.0, 0.4, "leans-human")
    assert _score(spark, [("neutral", 0.9)], 10) == (0.0, 0.6, "uncertain")
    assert _score(spark, [("machine", 0.4)], 500) == (1.0, 0.267, "leans-machine")
    assert _score(spark, [("machine", 0.4)], 4000) == (1.0, 0.067, "no-evidence")
    assert _score(spark, [("machine", 0.3)], 1001) == (1.0, 0.2, "leans-machine")
    assert _score(spark, [("machine", 0.12)] * 3 + [("machine", 0.15), ("human", 0.45)], 10)[0] == 0.062
    assert _score(spark, [("machine", 0.5), ("human", 0.5)], 10)[2] == "mixed-signals"


def test_documents_are_judged_by_their_segments(spark):
    segs = [(1, "leans-machine" if k == 0 else "no-evidence", 5000 if k == 0 else 0, 0, 0, 1) for k in range(20)]
    segs += [(2, "leans-machine" if k < 8 else "no-evidence", 5000 if k < 8 else 0, 0, 0, 1) for k in range(20)]
    segs += [(3, "uncertain", 5000, 0, 0, 1)]
    from marginalia.operators.scoring import roll_up

    s = spark.createDataFrame(segs, "doc_id long, label string, machine long, human long, neutral long, n_signals long")
    d = spark.createDataFrame([(1, 100), (2, 100), (3, 100), (4, 0)], "doc_id long, n_chars int")
    got = {r["doc_id"]: (r["lean"], r["strength"], r["label"]) for r in roll_up(s, d).collect()}
    assert got == {1: (1.0, 0.143, "no-evidence"), 2: (1.0, 1.0, "leans-machine"), 3: (0.0, 0.0, "no-evidence"), 4: (0.0, 0.0, "no-evidence")}


@pytest.fixture(scope="module")
def read(spark):
    docs = texts(spark, "One here. Two here. Three here.")
    j = [("a", "machine", "Two", None, None, "x", 0.5), ("a", "machine", "Two here", None, None, "y", 0.9), ("b", "machine", "here. Two", None, None, "z", None), ("b", "human", None, 20, 25, None, None), ("c", "neutral", "One", None, None, None, None), ("c", "human", "absent", None, None, None, None)]
    rows = [(0, *r, None, None, None) for r in j]
    return docs, spark.createDataFrame(rows, "doc_id long, reader string, direction string, quote string, start int, end int, name string, weight double, note string, detector string, value string")


def test_consensus(spark, read):
    docs, j = read
    counts = {r["reader"]: (r["machine"], r["human"], r["dropped"]) for r in readers.reader_counts(docs, j).collect()}
    assert counts == {"a": (1, 0, 0), "b": (2, 1, 0), "c": (0, 0, 1)}
    (u,) = readers.consensus_units(docs, j, 2).collect()
    assert (u["unit"], u["quote"], u["readers"], u["shapes"], u["weight"]) == (1, "Two here.", ["a", "b"], ["x", "y", "z"], 0.62)
    r = readers.consensus(docs, j, 2).first()
    assert (r["n_readers"], r["n_units"], r["n_words"], r["machine"], r["machine_per_1000"]) == (3, 3, 6, 1, 166.67)
    with pytest.raises(ValueError):
        readers.check_k(0, 3)
    with pytest.raises(Exception, match="needs at least 4"):
        readers.consensus(docs, j, 4).collect()
    base = readers.pooled(readers.consensus(docs, j, 2))
    assert (base.first()["machine"], base.first()["machine_low"]) == (1, 166.67)
    assert len(readers.compared(readers.consensus(docs, j, 1), base).first()["caveats"]) == 1
    with pytest.raises(Exception, match="pooling needs"):
        readers.pooled(readers.consensus(docs, j, 2).where("false")).collect()
    n = readers.consensus(docs, j, 2).select("doc_id", "n_readers")
    segs = plan.gauge(docs, "sentence", [], extra=readers.consensus_signals(readers.consensus_units(docs, j, 2), n))
    assert [r["n_signals"] for r in segs.orderBy("seg_idx").collect()] == [0, 1, 0]
    section = report.readers_section(readers.compared(readers.consensus(docs, j, 2), base), readers.reader_counts(docs, j), True).first()["readers"]
    assert "| b | 2 | 1 | 0 |" in section and "166.7 per 1,000" in section


def test_a_judgment_over_a_border_is_in_no_sentence(spark, read):
    docs, j = read
    extra = readers.judgment_signals(docs, j)
    segs = plan.gauge(docs, "sentence", [], extra=extra).orderBy("seg_idx").collect()
    assert [[s["name"] for s in r["signals"]] for r in segs] == [["judgment"], ["x", "y"], ["judgment"]]
    whole = spark.createDataFrame([(0, "all", "neutral", 0.3, "me", None, "", None, None)], "doc_id long, name string, direction string, weight double, detector string, value string, note string, start int, end int")
    assert [r["n_signals"] for r in plan.gauge(docs, "sentence", [], extra=whole).collect()] == [1, 1, 1]


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "draft.md").write_text("One. Two.")
    (tmp_path / "t" / "draft.a.json").write_text('[{"quote": "One", "direction": "human"}]')
    (tmp_path / "t" / "draft.b.json").write_text('{"findings": [{"start": 0, "end": 3, "direction": "machine", "value": {"k": 1}}]}')
    (tmp_path / "t" / "draft").mkdir()
    (tmp_path / "t" / "draft" / "c.json").write_text('{"judgments": []}')
    got = sorted(((r["document"], r["reader"], r["direction"]) for r in sources.judgment_files(spark, f"file://{tmp_path}/t").collect()), key=str)
    assert got == [("draft", "a", "human"), ("draft", "b", "machine"), ("draft", "c", None)]
    (tmp_path / "u").mkdir()
    (tmp_path / "u" / "draft.a.json").write_text("[]")
    both = sources.judgment_files(spark, [f"file://{tmp_path}/t", f"file://{tmp_path}/u"]).select("folder", "document", "reader").distinct().collect()
    assert len(both) == 4 and len({r["folder"] for r in both}) == 2
    (tmp_path / "t" / "draft.d.json").write_text('{"k": 2, "texts": []}')
    with pytest.raises(Exception, match="not a reader"):
        sources.judgment_files(spark, f"file://{tmp_path}/t").collect()
    assert sources.texts(spark, f"file://{tmp_path}/t", "*.md").first()["text"] == "One. Two."
    assert [n for n, _ in sources.readers_of('[[], {"judgments": []}]')] == ["reader 1", "reader 2"] and sources.readers_of(None) == []
    with pytest.raises(ValueError, match="mixes"):
        sources.readers_of([{"direction": "human"}, []])
    assert sources.judgment_rows(spark, [{"quote": "x", "direction": "human"}], 1).first()["direction"] == "human"
    up = tmp_path / "up"
    up.mkdir()
    (up / "a.txt").write_bytes("a\r\nb\rc".encode())
    (up / "b.txt").write_bytes(b"\xff\xfe")
    (up / "c.pdf").write_bytes(b"x")
    rows = {r["doc_id"][-5:]: (r["text"], r["refused"]) for r in sources.uploads(spark, f"file://{up}").collect()}
    assert rows == {"a.txt": ("a\nb\nc", None), "b.txt": (None, "encoding"), "c.pdf": (None, "name")}
    (tmp_path / "rules.json").write_text(json.dumps({"rules": [{"id": "r", "tier": "W", "message": "m", "patterns": ["x"]}]}))
    assert sources.rules_from(str(tmp_path / "rules.json"))[0].weight == 0.30
    (tmp_path / "fix.json").write_text(json.dumps({"documents": [{"id": "d", "text": "abc", "ai_char_intervals": [[0, 2]]}]}))
    docs, truth = sources.annotated(spark, f"file://{tmp_path}/fix.json")
    assert docs.first()["text"] == "abc" and tuple(truth.first()) == ("d", 0, 2)


def test_silent_readers_count(spark):
    docs = texts(spark, "One here. Two here.")
    own = sources.judgment_rows(spark, [[{"quote": "One", "direction": "machine"}], [], [{"quote": "One here", "direction": "machine"}]], 0)
    assert {r["reader"]: (r["machine"], r["dropped"]) for r in readers.reader_counts(docs, own).collect()} == {"reader 1": (1, 0), "reader 2": (0, 0), "reader 3": (1, 0)}
    r = readers.consensus(docs, own, 2).first()
    assert (r["n_readers"], r["machine"]) == (3, 1) and readers.consensus(docs, own, 3).first()["machine"] == 0
    many = sources.judgment_rows(spark, [[{"quote": "One", "direction": "human"}]] * 11, 0)
    assert readers.consensus_units(docs, many, 2).first()["readers"] == [f"reader {k + 1}" for k in range(11)]
    assert readers.judgment_signals(docs, own).count() == 2


def test_one_row_to_compare_with(spark, read):
    docs, j = read
    base = readers.pooled(readers.consensus(docs, j, 2))
    with pytest.raises(ValueError, match="several"):
        readers.compared(readers.consensus(docs, j, 2), base.unionByName(base))
    with pytest.raises(ValueError, match="none"):
        readers.compared(readers.consensus(docs, j, 2), base.where("false"))


def test_metrics_of_a_catalogue(spark, tmp_path):
    from marginalia.operators.detectors import rhythm

    (tmp_path / "own.json").write_text(json.dumps({"rules": [], "metrics": {"min_sentences_for_rhythm": 3}}))
    metrics = sources.metrics_from(str(tmp_path / "own.json"))
    assert metrics == {**sources.metrics_from(), "min_sentences_for_rhythm": 3}
    count = lambda m: texts(spark, "One two three. " * 4).select(F.size(rhythm(F.col("text"), F.lit(0), m)).alias("n")).first()["n"]
    assert (count(sources.metrics_from()), count(metrics)) == (0, 1)


def test_verbs(spark, tmp_path):
    from marginalia.__main__ import run

    (tmp_path / "old.md").write_text("Let's delve into it. It rained. We went home.")
    for name, found in (("a", [{"quote": "delve", "direction": "machine"}]), ("b", [{"quote": "delve into", "direction": "machine"}]), ("c", [])):
        (tmp_path / f"old.{name}.json").write_text(json.dumps(found))
    text, files = str(tmp_path / "old.md"), [str(tmp_path / f"old.{n}.json") for n in "abc"]
    flags = [x for f in files for x in ("--judgments", f)]
    assert run(spark, ["gauge", text]).startswith("# Reading\n") and json.loads(run(spark, ["gauge", "Sent it on Friday.", "--format", "json"]))["label"] == "no-evidence"
    base = str(tmp_path / "base.json")
    told = run(spark, ["baseline", str(tmp_path), "--out", base])
    assert "1 text(s), 111.11 per 1,000" in told and json.loads((tmp_path / "base.json").read_text())["n_readers"] == [3]
    assert "| old | 9 | 3 | 111.1 | 0.0 |" in run(spark, ["baseline", str(tmp_path), "--format", "markdown"])
    page = run(spark, ["gauge", text, *flags, "--baseline", base, "--segmenter", "sentence"])
    assert "Beside the baseline: 111.1" in page and "reader-consensus" in page and "| reader 3 | 0 | 0 | 0 |" in page
    assert "wrote" in run(spark, ["gauge", text, "--format", "html", "--out", str(tmp_path / "page.html")]) and "<html" in (tmp_path / "page.html").read_text()
    with pytest.raises(ValueError, match="at least twice"):
        run(spark, ["gauge", text, "--judgments", files[0], "--baseline", base])
    with pytest.raises(Exception, match="needs at least 4"):
        run(spark, ["baseline", str(tmp_path), "--k", "4"])
    with pytest.raises(Exception, match="no readers for"):
        (tmp_path / "new.md").write_text("x")
        run(spark, ["baseline", str(tmp_path)])
    assert len(run(spark, ["tells", "--tier", "E"]).splitlines()) == 5 and "rhythm" in run(spark, ["detectors"]) and "sentence" in run(spark, ["segmenters"])


def test_rows_are_dealt_to_all_cores(spark, tmp_path):
    d = spark.range(10).coalesce(1)
    assert sources.dealt(d).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(10).repartition(64)
    assert sources.dealt(wide) is wide


def test_outliers(spark):
    one = lambda x, xs: spark.range(1).select(outliers.robust_z(F.lit(x), F.array(*map(F.lit, xs))).alias("z")).first()["z"]
    assert one(3.0, [1.0, 2.0, 3.0, 4.0, 5.0]) == 0.0 and one(1.0, [1.0] * 3) == 0.0
    assert one(6.0, [1.0, 2.0, 3.0, 4.0]) == pytest.approx((6 - 2.5) / 1.4826)
    bands = spark.createDataFrame([(1.49,), (1.5,), (2.5,), (-9.0,)], "z double").select(outliers.band_of(F.col("z")).alias("w"))
    assert [r["w"] for r in bands.collect()] == [None, 0.3, 0.45, 0.45]
    chunks = spark.range(1).select(outliers.chunks(F.lit(20), 8).alias("c")).first()["c"]
    assert [tuple(c) for c in chunks] == [(0, 8, 1), (4, 12, 8), (8, 16, 12), (12, 20, 16)]
    rows = spark.range(1).select(outliers.scored_rows(F.struct(F.lit(4).alias("start"), F.lit(12).alias("end"), F.lit(8).alias("first"))).alias("r")).first()["r"]
    assert tuple(rows) == (3, 7)
    # sizes without a period, as windows that are all alike have no deviation and nothing stands out of them
    plain = ["x" * (2 + k * k % 7 + k % 4) for k in range(180)]
    before = " ".join(plain[:80])
    text = " ".join([before, *["abcdefghijklmnop"] * 20, *plain[80:]])
    at = len(before) + 1
    stats = outliers.word_length_statistics(texts(spark, text))
    segs = spark.createDataFrame([(0, 0, at, at + 20 * 17 - 1), (0, 1, 0, 30)], "doc_id long, seg_idx int, start int, end int")
    (r,) = outliers.outlier_signals(segs, stats, "fast-detect-gpt").collect()
    assert (r["direction"], r["weight"], r["start"]) == ("machine", 0.45, at)


def test_edits(spark):
    segs = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 12, 20)], "doc_id long, seg_idx int, start int, end int")
    sigs = spark.createDataFrame([(1, 0, 0, 2, 4), (1, 1, 0, 12, 14)], "doc_id long, seg_idx int, nth int, start int, end int")
    changes = spark.createDataFrame([(1, 1, 0, 0, 3), (1, 2, 30, 31, 0)], "doc_id long, seq int, start int, end int, inserted int")
    a, b = edits.invalidated(segs, sigs, changes)
    assert sorted((r["start"], r["end"], r["unverified"]) for r in a.collect()) == [(3, 13, True), (15, 23, False)]
    assert sorted((r["start"], r["end"], r["unverified"]) for r in b.collect()) == [(5, 7, True), (15, 17, False)]
    docs = texts(spark, "now")
    results = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.explode(F.array(F.lit(1), F.lit(3))).alias("ticket")).unionByName(spark.createDataFrame([(0, "old", 9)], "doc_id long, text_sha256 string, ticket int"))
    assert [r["ticket"] for r in edits.current(results, docs).collect()] == [3]


def test_evaluation(spark):
    docs = texts(spark, "We delve in. It was fine — certainly! great question", "He went home. Then he slept.")
    segs = plan.gauge(docs, "sentence")
    truth = spark.createDataFrame([(0, 13, 60)], "doc_id long, start int, end int")
    c = evaluate.score_card(segs, truth).first()
    assert (c["machine_total"], c["human_total"], c["machine_hits"], c["machine_flagged"]) == (2, 3, 2, 3)
    assert c["machine_precision"] == pytest.approx(2 / 3)
    rows = evaluate.band_rates(plan.judged(docs.withColumn("band", F.lit("A")), "sentence", keep=("band",)), "band").collect()
    assert {r["band"] for r in rows} == {"A", None} and all(r["documents"] == 2 for r in rows)
    acc = {r["name"]: r for r in evaluate.rule_accounting(plan.signals(segs), plan.signals(segs), truth).collect()}
    assert (acc["em-dash"]["true_positive"], acc["ai-vocabulary"]["true_positive"], acc["ai-vocabulary"]["human_docs"]) == (1, 0, 1)
    sweep = evaluate.reference_sweep(segs, docs.withColumns({"n_chars": F.length("text"), "b": F.lit(1)}), "b")
    assert sweep.count() == 7


def test_reports(spark):
    docs = texts(spark, "Let's delve <in> & on.\n\nSent it on Friday.", "Nothing at all.")
    r = plan.reports(docs)
    md = {x["doc_id"]: x["markdown"] for x in report.to_markdown(r).collect()}
    assert md[0].startswith("# Reading\n\n**") and "**ai-vocabulary** (machine, 0.30, via tells) — `delve`" in md[0]
    assert report.NOTHING in md[1] and "%" not in md[0]
    page = {x["doc_id"]: x["html"] for x in report.to_html(r).collect()}
    assert page[0].count("<mark") == page[0].count("</mark>") == 1 and "&lt;in&gt; &amp; on." in page[0] and "<mark" not in page[1]
    whole = {x["doc_id"]: json.loads(x["json"]) for x in report.to_json(r).collect()}
    seg = whole[0]["segments"][0]
    assert seg["signals"][0]["name"] == "ai-vocabulary" and whole[0]["calibration"] == "uncalibrated (density_aggregate)"
    assert "Pooled" not in md[0]


def test_placement(spark):
    segs = plan.gauge(texts(spark, "It's not just a thing of use, but more!"))
    rows = segs.select(F.explode(placement.placed(F.col("signals"), F.col("start"))).alias("s")).select("s.*").collect()
    assert all(x["end"] <= y["start"] for x, y in zip(rows, rows[1:])) and len(rows) == 2
    assert segs.select(by_direction(F.col("signals"), "machine").alias("m")).first()["m"] == 10500  # 0.30 by each of two patterns and a sentence shape, 0.15 for the mark
    ranks = placement.ranked(plan.signals(segs)).orderBy("rank").collect()
    assert [r["weight"] for r in ranks] == sorted((r["weight"] for r in ranks), reverse=True)


def test_utf16(spark):
    assert texts(spark, "a😀b").select(utf16_offset(F.col("text"), F.lit(2)).alias("o")).first()["o"] == 3


def test_streams(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(20)
    docs.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = readings.segment_stream(readings.document_stream(spark, f"{tmp_path}/in")).select("doc_id", "seg_idx", "lean", "strength", "label")
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = plan.gauge(docs).select("doc_id", "seg_idx", "lean", "strength", "label")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, batch.collect()))


def test_edit_streams(spark, tmp_path):
    rows = [(1, "finding", 0, 0, 0, 10, None), (1, "finding", 0, 1, 12, 20, None), (1, "edit", 1, None, 0, 0, 3), (1, "edit", 2, None, 30, 31, 0)]
    spark.createDataFrame(rows, readings.EVENTS).write.parquet(f"{tmp_path}/in")
    out = readings.edit_stream(spark.readStream.schema(readings.EVENTS).parquet(f"{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("followed").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r["seq"], r["seg_idx"], r["start"], r["end"], r["unverified"]) for r in spark.sql("select * from followed").collect())
    assert got == [(1, 0, 3, 13, True), (1, 1, 15, 23, False), (2, 0, 3, 13, True), (2, 1, 15, 23, False)]
