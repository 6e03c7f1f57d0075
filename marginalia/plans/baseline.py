"""The verb that pools reference texts: how readers find an author's earlier texts, to read a new one beside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.readers import check_k, consensus, pooled
from ..operators.segments import Segmenter
from ..sources.readers import judgment_files, texts

TABLE = "\n| Text | Words | Readers | Machine-leaning per 1,000 | Human-leaning per 1,000 |\n|---|---|---|---|---|\n"
CLOSING = "\nHow these texts read to these readers, so that another can be set beside them: no threshold, and nothing about who wrote what.\n"


def baseline(docs: DataFrame, judgments: DataFrame, k: int = 2, segmenter: str | Segmenter = "sentence") -> tuple[DataFrame, DataFrame]:
    """(pooled, readings): one row over all of ``docs``, and one for each of them, without any quote.

    Every text needs at least ``k`` readers, those who flag nothing included;
    one with fewer, or none, stops the job with an error, as do no texts.
    """
    check_k(k, k)
    readings = docs.select("doc_id").join(consensus(docs, judgments, k, segmenter), "doc_id", "left")
    none = F.raise_error(F.concat(F.lit("no readers for "), F.col("doc_id").cast("string"))).cast("long")
    readings = readings.withColumn("n_readers", F.when(F.col("n_readers").isNull(), none).otherwise(F.col("n_readers")))
    return pooled(readings), readings


def reference_files(spark: SparkSession, path: str, glob: str = "*.md", judgments: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(docs, judgments) of text files and their readers' files, beside them or under ``judgments``; doc_id is the document's name without its ending."""
    named = texts(spark, path, glob).select(F.regexp_extract("doc_id", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), "text")
    return named, judgment_files(spark, judgments or path, named.withColumnRenamed("doc_id", "document")).withColumnRenamed("document", "doc_id").drop("folder")
