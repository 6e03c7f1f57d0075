"""Every operator and pipeline stage on nulls, empty, long and repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import chat, decontaminate, langid, mixing, pii, quality, queries, rules, simhash, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the cat sat on the mat and ate " * 20_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, mail me at a.b@c.example.com now.", "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, None, 0),
    (4, "x", "de", "b", 1),
    (4, "x", "de", "b", 1),
    (None, "Der schnelle braune Fuchs springt über den faulen Hund und bleibt dann stehen.", "de", None, 5),
    (None, None, None, None, None),
    (5, LONG, "en", "a", len(LONG)),
    (6, "12345 67890 ... !!! ", "en", "c", 3),
    (7, "Le renard brun saute par-dessus le chien paresseux et puis il dort 😀 bien.", "fr", "", 7),
]
CLASHES = ["longest", "digest", "score", "fp", "row_hash", "spans", "items", "n_words", "taken", "size", "src", "ambiguous", "clean_text_", "bits", "kept", "component_id", "h", "range", "id"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def wide(docs):
    return docs.select("*", *(F.lit("own").alias(c) for c in CLASHES))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 1, 0), (6, 0, None), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps"), (2, None), (3, ""), (None, "the lazy dog"), (1, "quick brown fox jumps")], "item_id long, text string")


def operators(labels, benchmark):
    return {
        "quality": lambda d: quality.scored(d, quality.fit(d, labels)),
        "toxicity": lambda d: toxicity.scored(d, toxicity.fit(d, labels)),
        "decontaminate": lambda d: decontaminate.marked(d, benchmark),
        "language": lambda d: langid.identify(d, langid.fit(d)),
        "rules": rules.judged,
        "mixing": mixing.mix,
        "private": lambda d: pii.find_private(d, pii.fit(d)),
        "simhash": simhash.near_groups,
    }


@pytest.mark.parametrize("name", ["quality", "toxicity", "decontaminate", "language", "rules", "mixing", "private", "simhash"])
def test_a_row_for_each_row(name, docs, wide, none, labels, benchmark):
    f = operators(labels, benchmark)[name]
    ids = sorted((r[0] for r in ROWS), key=str)
    for d in (docs, wide):
        assert sorted((r["doc_id"] for r in f(d).collect()), key=str) == ids
    assert f(none).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_take_odd_rows(k, spark, docs, wide, none, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = corpus_pipeline.STAGES[k][1]
    for d in (docs, wide):
        out = stage(spark, d, str(tmp_path))
        assert out.columns[:5] == corpus_pipeline.COLUMNS and (k == 4 or len(out.columns) == 5)
        assert out.count() <= len(ROWS)
    assert stage(spark, none, str(tmp_path)).count() == 0


def test_what_stages_keep(spark, docs, benchmark, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = lambda k: sorted((r["doc_id"] for r in corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)).collect()), key=str)
    assert 6 not in kept(0) and 2 not in kept(0) and 1 in kept(0)
    # one of the two copies of 4; null and empty texts share a fingerprint, and 2 is the least of their ids
    assert kept(1) == [1, 2, 4, 5, 6, 7, None]
    # "the lazy dog" hits row 1 too, though its item has no id
    assert kept(2) == sorted((r[0] for r in ROWS if r[0] != 1), key=str)
    red = {r["doc_id"]: r for r in corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).collect()}
    assert "[email]" in red[1]["text"] and "@" not in red[1]["text"] and red[1]["n_chars"] == len(red[1]["text"])
    assert red[2]["text"] is None and red[5]["text"] == LONG


def test_rules_of_the_url_query_are_those_of_its_contract(spark, tmp_path):
    # each rule alone, beside a longer one, on a listed site, and missed by a letter
    wanted = [
        ("http://a.com/en/1", "com/en/", "block"), ("http://www.example.com/en/70", "example.com/en/7", "allow"), ("http://example.com/en/8", "com/en/", "block"),
        ("http://a.net/de/1", "net/de/", "allow"), ("http://spam-farm.example.net/de/1", "net/de/", "allow"), ("http://example.net/de/80", "example.net/de/8", "block"), ("http://example.net/de/7", "net/de/", "allow"),
        ("http://b.a.org/es/", "org/es/", "block"), ("http://spam-farm.example.net/d", None, "block"), ("http://a.net/es/", None, "allow"),
    ]
    spark.createDataFrame([(k, u) for k, (u, _, _) in enumerate(wanted)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op4_urls(spark, str(tmp_path)).collect()}
    assert got == {k: (r, v) for k, (_, r, v) in enumerate(wanted)}


def test_urls_edges(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.COM/en/7?x"), (3, "http://A.Example.COM/en/7?x"), (4, "http://"), (5, "x://h" + "/a" * 50_000), (None, "https://spam.org#f")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("own"))
    out = {r["page_id"]: r for r in urls.judge(pages, [("com", "/en/", "block"), ("example.com", "/en/7", "allow")], [("spam.org", "", "block")]).collect()}
    assert (out[1]["host"], out[1]["path"], out[1]["verdict"], out[1]["rule"]) == ("", "", "allow", None)
    assert (out[3]["host"], out[3]["path"], out[3]["rule"], out[3]["verdict"]) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert (out[None]["verdict"], out[None]["listed"], out[None]["rule"]) == ("block", "spam.org", None)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), [], []).count() == 0


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "a"), (1, 1, None, "a"), (None, None, "assistant", "z"), (None, 1, "user", "q"), (2, 0, "assistant", "y" * 200_000), (3, 0, "odd\nrole%0A", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"formatted": F.lit("own"), "prompt": F.lit("own"), "messages": F.array(F.lit(1))})
    rows = chat.read_back(chat.formatted(chat.turn_rows(turns))).collect()
    out = {r["conv_id"]: r for r in rows if r["conv_id"] is not None}
    # rows without an id are conversations of their own
    assert sorted((r["turns"][0]["role"], r["loss_texts"]) for r in rows if r["conv_id"] is None) == [("assistant", ["z"]), ("user", [])]
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("user", ""), ("", "a"), ("", "a")]
    assert out[2]["loss_texts"] == ["y" * 200_000]
    assert out[3]["turns"][0]["role"] == "odd\nrole%0A"
    assert chat.formatted(turns.where("false").select("conv_id", "turn", "role", "text")).count() == 0


def test_layouts_are_told_by_nested_paths(spark, monkeypatch):
    import json

    records = [
        {"messages": [{"from": "human", "value": "q"}]},
        {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}]},
        {"messages": [{"role": "user", "content": "q", "name": "x"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}], "id": 3, "source": "s"},
        {"messages": []},
        {"prompt": 5, "response": "a"},
        {"prompt": "p", "response": "a", "system": None},
        [1],
    ]
    d = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(8, None), (9, "")], "conv_id long, record string")
    got: dict = {}
    for r in chat.json_turn_rows(d).orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["layout"], r["role"], r["text"]))
    assert [k for k in range(10) if got[k] == [(None, None, None)]] == [0, 1, 2, 5, 7, 8, 9]
    assert got[3] == [("shared", "user", "q"), ("shared", "assistant", None)] and got[4] == [("messages", None, None)]
    assert got[6] == [("prompt-response", "user", "p"), ("prompt-response", "assistant", "a")]
    with pytest.raises(ValueError):
        chat.turn_rows(spark.createDataFrame([(1, [("human", "q")])], "conv_id long, messages array<struct<`from`:string,value:string>>"))
    # no layout is chosen but by its fingerprint
    turns = spark.createDataFrame([(1, 0, "user", "q")], "conv_id long, turn long, role string, text string")
    assert chat.layout_of(turns) == "turn-rows"
    monkeypatch.setattr(chat, "BY_FINGERPRINT", {})
    with pytest.raises(ValueError):
        chat.turn_rows(turns)


def test_each_row_of_a_table_has_its_own_layout(spark):
    kind = "conv_id long, prompt string, response string, question string, answer string, system string, messages array<struct<role:string,content:string>>"
    said = [("user", "hi"), ("gpt", "yo")]
    rows = [(1, "p", "r", None, None, None, None), (2, None, None, "q", "a", None, None), (3, None, None, None, None, "s", said), (4, None, None, None, None, None, said), (5, "p", "r", None, None, "s", None), (6, "p", "r", "q", "a", None, None), (7, "p", None, None, None, None, None), (8, None, None, None, None, None, None), (9, None, None, None, None, None, []), (4, None, None, None, None, None, said)]
    df = spark.createDataFrame(rows, kind)
    got = {}
    for r in chat.turn_rows(df, with_layout=True).orderBy("conv_id", "turn").collect():
        got.setdefault((r["conv_id"], r["layout"]), []).append((r["turn"], r["role"], r["text"]))
    assert got == {
        (1, "prompt-response"): [(0, "user", "p"), (1, "assistant", "r")], (2, "question-answer"): [(0, "user", "q"), (1, "assistant", "a")], (3, "system-messages"): [(0, "system", "s"), (1, "user", "hi"), (2, "assistant", "yo")],
        (4, "messages"): [(0, "user", "hi"), (0, "user", "hi"), (1, "assistant", "yo"), (1, "assistant", "yo")], (5, "system-prompt-response"): [(0, "system", "s"), (1, "user", "p"), (2, "assistant", "r")],
        (6, None): [(None, None, None)], (7, "prompt-response"): [(0, "user", "p"), (1, "assistant", None)],
    }
    assert chat.turn_rows(df.where("false")).collect() == []
    record = spark.createDataFrame([(1, '{"system": "s", "messages": [{"role": "user", "content": "hi"}]}')], "conv_id long, record string")
    assert [tuple(r) for r in chat.json_turn_rows(record).orderBy("turn").collect()] == [(1, "system-messages", 0, "system", "s"), (1, "system-messages", 1, "user", "hi")]


def test_a_host_of_a_megabyte_is_judged_in_linear_time(spark):
    import time

    hosts = ["a." * 500_000 + "x.net", "b" * 1_000_000 + ".net", "." * 1_000_000 + "x.net", "net", ".net", "anet", "a.net."]
    pages_ = spark.createDataFrame([(k, f"http://{h}/de/1") for k, h in enumerate(hosts)], "page_id long, url string")
    began = time.perf_counter()
    got = {r["page_id"]: r["rule"] for r in urls.judge(pages_, [("net", "/de/", "block"), ("x.net", "", "block")], [("y.example.org", "", "block")]).collect()}
    assert got == {0: "net/de/", 1: "net/de/", 2: "net/de/", 3: "net/de/", 4: "net/de/", 5: None, 6: None}
    assert time.perf_counter() - began < 30


def test_a_column_of_any_case_may_be_called_like_one_of_ours(spark):
    docs = spark.createDataFrame([(1, "mail me at a.b@c.example.com", "kept")], "doc_id long, text string, CLEAN_TEXT_ string")
    assert [tuple(r) for r in pii.redact(docs, pii.fit(docs)).collect()] == [(1, "mail me at [email]", "kept")]


def test_what_has_no_letter_has_no_language(spark):
    coder = langid.fit(spark.createDataFrame([(k, "the cat", "en") for k in range(5)] + [(9, "die Katze", "de")], "doc_id long, text string, lang string"))
    assert [coder.decide(t)[0] for t in ("\u00bd \u00b2 12", "\u2160 \u0660", "", None)] == ["und"] * 4
    assert coder.decide("\u00bd a")[0] != "und" and coder.decide(None) == ("und", 0.0, True)
    many = spark.createDataFrame([(k, "abc def", f"l{k % 40:02d}") for k in range(200)], "doc_id long, text string, lang string")
    assert langid.fit(many, most_languages=3).languages == ["l00", "l01", "l02"]
    unknown = many.withColumn("lang", F.lit(None).cast("string"))
    assert langid.keep_identified(unknown, langid.fit(unknown)).count() == 200


def test_items_of_any_type(spark, wide):
    items = spark.createDataFrame([("b", "quick brown fox jumps"), ("a", "the lazy dog"), ("a", "the lazy dog")], "item_id string, text string")
    for block in (500_000, 1):
        got = {r["doc_id"]: r for r in decontaminate.marked(wide, items, 4, block).collect()}
        assert got[1]["items"] == ["a", "b"] and tuple(got[1]["longest"]) == (4, "b", 0, 1) and got[2]["items"] == []
        assert 1 not in {r["doc_id"] for r in decontaminate.remove_contaminated(wide, items, 4, block).collect()}


def test_the_pipeline_on_no_rows_and_what_it_leaves(spark, docs, none, benchmark, tmp_path):
    from pathlib import Path

    root = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    for name, rows in (("full", docs), ("none", none)):
        benchmark.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    there = {p.name for p in root.glob("*")}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    out = corpus_pipeline.run(spark, f"{tmp_path}/full")
    left = [p for p in root.glob("*") if p.name not in there]
    assert len(left) == 2 and all(p.name.startswith("pipeline-") and {x.name for x in p.glob("[0-9]*")} == {"4"} for p in left)
    # 1 holds a benchmark item, 2 and 3 have no text, 6 no letter, and 4 stands twice
    assert {r["doc_id"] for r in out.collect()} == {4, 5, 7, None}
