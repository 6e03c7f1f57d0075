"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import table
from . import chat, decontaminate, langid, mixing, packing, pii, quality, repair, rules, simhash, toxicity, trie, urls
from .shared import in_fold, written

RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Sites blocked whole, each under three endings.
LISTED = tuple((f"{site}.example.{end}", "", "block") for site in ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned outside fold 0 of 5; ``above_cut`` is the quantile threshold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = in_fold(F.col("doc_id"), 5, 0)
    model = quality.fit(docs, labels.where(~held))
    scores = written(quality.scored(docs, model), "quality")
    cut = quality.quantile_cut(scores, model.low_share)
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), (F.col("score") >= cut).alias("above_cut"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned outside fold 2 of 4."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = in_fold(F.col("doc_id"), 4, 2)
    model = toxicity.fit(docs, labels.where(~held))
    return toxicity.scored(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is in windows of benchmark items, of which items, and the longest match."""
    out = decontaminate.marked(table(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])
    ids = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), F.coalesce("longest.n_words", F.lit(0)).cast("long").alias("longest_words"), F.col("longest.doc_start").cast("long").alias("longest_at"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then listed sites, for each page's url."""
    listed = spark.createDataFrame(LISTED, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), RULES, listed)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    held = in_fold(F.col("doc_id"), 5, 0)
    coder = langid.fit(docs.where(~held))
    return langid.identify(docs, coder).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each document, and whether repetition, length and perplexity keep it."""
    return rules.judged(table(spark, sf_dir, "documents"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, and where in its schedule."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the exact spans of each document, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find_private(docs, pii.fit(docs))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and near-duplicate group."""
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings in its texts, formatted and read back."""
    turns = chat.turn_rows(table(spark, sf_dir, "conversations"))
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = chat.formatted(turns.unionByName(more))
    back = chat.read_back(out.select("conv_id", "formatted", "loss", F.length("formatted").cast("long").alias("formatted_chars")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    shown = F.array_join("loss_texts", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length(shown).cast("long").alias("loss_chars"), F.sha2(shown, 256).alias("loss_sha256"), "formatted_chars")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of conversations that begin like the first of their family."""
    return trie.nodes(trie.rebuilt(trie.turn_lists(table(spark, sf_dir, "conversations"))))


def op12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4,096 tokens that each have every source's share."""
    import public_tokenizers

    out = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of damaged conversations, and their cheapest repairs."""
    return repair.repairs(repair.gathered(repair.damaged(table(spark, sf_dir, "conversations")))).drop("repaired")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_toxicity, op3_decontaminate, op4_urls, op5_language, op6_rules, op7_mix, op8_private, op9_simhash, op10_chat, op11_trie, op12_pack, op13_repair)}
