"""Passages of our own that give each detector something to find, put behind the documents by their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.readers import table

#: The document whose id leaves n when divided by the number of passages gets passage n.
SEEDS = (
    "",
    "Let's delve into a robust tapestry — it's important to note that this plays a key role.\n\nNotably, this serves as a test.",
    "However, studies show that it is not just a game-changing tool, but a new era! In conclusion, we did it.",
    'He said "delve" and `robust` there.\n \nstill going on here and\nthen more of it',
    "I appreciate the work. However, it might potentially fail. 😀 Certainly! Great question, friend.",
    "This is a plan: you map it, you build it, and you ship it. Don't say don’t again. ",
    "- a list item that has no end\n\n# Heading of some kind here\n\n[insert name here] {{slot}} as of my last update.",
    "Check ✅ and arrow → here, in today's digital world, showcasing what is possible.\n\nImagine a place?\nno",
    "What a great idea, you’re absolutely right. I hope this email finds you well; feel free to reach out.",
    "One two three four five. One two three four five. One two three four five. One two three four five. One two three four five. One two three four six.",
    "\tlead text with trailing   \nand tabs\t\nend now; moreover, red, green and blue.\n\n  \nlast",
    "Many believe this isn't merely about speed, it's a revolutionary realm. It seems that it might help, highlighting the beauty of it.",
)


def seeded(spark: SparkSession, sf_dir: str, keep_plain: bool = False) -> DataFrame:
    """documents with a passage behind each text, after a blank line; on demand with the text as it was, as ``plain``."""
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("plain", F.col("text")) if keep_plain else docs
    passage = F.element_at(F.array(*map(F.lit, SEEDS)), (F.pmod("doc_id", F.lit(len(SEEDS))) + 1).cast("int"))
    return docs.withColumn("text", F.when(F.length(passage) > 0, F.concat("text", F.lit("\n\n"), passage)).otherwise(F.col("text")))


def seeded_sql() -> str:
    """The same as a DuckDB table expression."""
    case = " ".join("WHEN {} THEN chr(10) || chr(10) || '{}'".format(i, s.replace("'", "''")) for i, s in enumerate(SEEDS) if s)
    return f"SELECT doc_id, lang, source, text || (CASE doc_id % {len(SEEDS)} {case} ELSE '' END) AS text FROM documents"
