"""The training-data pipeline: language, near-duplicates, benchmark passages, personal data, mix."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, langid, mixing, pii, simhash
from marginalia.llm.shared import made, removed, shared_folder, swept

#: Columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without a letter (null and empty texts too), or between two languages, go.

    If no document has a lang, nothing can be learned and all with a letter stay. Rows that repeat are judged alike.
    """
    return langid.keep_identified(docs, langid.fit(docs)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id, nulls last; of rows that repeat, one.

    Near is what the operator's digest says: fingerprints of four words at most four bits apart, far closer than a similarity of 0.8 asks for.
    Null and empty texts are copies of each other.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; null and empty texts stay, and so does all if no item has words."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts named instead of shown; null texts stay null, n_chars is counted anew where there is one."""
    return pii.redact(docs, pii.fit(docs)).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with its figures and the texts of all pieces that it takes behind their own columns.

    Documents without words stay, without pieces; rows that repeat are rows of their own; a null source is one more source.
    """
    mixed = mixing.pieces(docs, keep=COLUMNS).where("taken > 0 or size = 0")
    return mixed.withColumn("pieces", mixing.with_texts(F.col("text"), F.col("size"), F.col("pieces")))


def in_pieces(mixed: DataFrame) -> DataFrame:
    """A row for each piece of the mix, its text as ``text``, so that the rows' words follow the targets; (slot, place) is the order.

    A document without words has one row, without a slot.
    """
    rows = mixed.select(*mixed.columns[:-1], F.explode_outer("pieces").alias("p")).select(*mixed.columns[:-1], "p.slot", "p.place", "p.turn", "p.first", "p.last", F.col("p.text").alias("piece"))
    text = F.when(F.col("slot").isNull(), F.col("text")).otherwise(F.col("piece"))
    n_chars = F.when(F.col("slot").isNull(), F.col("n_chars")).otherwise(F.length("piece")).cast(mixed.schema["n_chars"].dataType)
    return rows.withColumn("text", text).withColumn("n_chars", n_chars).drop("piece")


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark_passages), ("PII", personal_data), ("mixing sources", mixture)]
#: Classifiers and fingerprints have no SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; the result is the mix, piece by piece.

    A stage's own tables, and its predecessor's rows, are deleted once it is written; only the last stage's rows stay. An empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        before = made()
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        # what only this stage has read is not needed any more
        swept(spark, before)
        if k:
            removed(spark, f"{folder}/{k - 1}")
    return in_pieces(docs)
