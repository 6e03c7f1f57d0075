"""What edits do to findings: places move along, and whatever an edit touches is no longer verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a place at an insertion goes: a finding's start behind it, its end before it.
FROM_BIAS, TO_BIAS = 1, -1
EDIT = "struct<seq:int,start:int,end:int,inserted:int>"


def mapped(pos: Column, e: Column, bias: int) -> Column:
    """A place after the edit that puts ``inserted`` code points for [start, end)."""
    behind = F.lit(bias > 0)
    side = F.when(e["start"] == e["end"], behind).when(pos == e["start"], F.lit(False)).when(pos == e["end"], F.lit(True)).otherwise(behind)
    return F.when(pos < e["start"], pos).when(pos > e["end"], pos + e["inserted"] - (e["end"] - e["start"])).otherwise(e["start"] + F.when(side, e["inserted"]).otherwise(0)).cast("int")


def touched(start: Column, end: Column, e: Column) -> Column:
    """Whether the changed range, ends included, meets [start, end] as they are after the edit."""
    return (e["start"] <= end) & (e["start"] + e["inserted"] >= start)


def invalidated(segments: DataFrame, signals: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments and signals after a document's edits (doc_id, seq, start, end, inserted), in the order of seq.

    ``start`` and ``end`` move, ``unverified`` says whether an edit touched the
    row, or for a signal its segment. Nothing is anchored anew. A row follows
    its document's edits by itself.
    """
    one = F.struct(*(F.col(c).cast("int").alias(c) for c in ("seq", "start", "end", "inserted")))
    lists = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("edits"))

    def followed(rows: DataFrame) -> DataFrame:
        state = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(False).alias("unverified"))

        def step(s: Column, e: Column) -> Column:
            a, b = mapped(s["start"], e, FROM_BIAS), mapped(s["end"], e, TO_BIAS)
            return F.struct(a.alias("start"), b.alias("end"), (s["unverified"] | touched(a, b, e)).alias("unverified"))

        joined = rows.join(lists, "doc_id", "left").withColumn("s", F.aggregate(F.coalesce("edits", F.array().cast(f"array<{EDIT}>")), state, step))
        return joined.withColumns({"start": F.col("s.start"), "end": F.col("s.end"), "unverified": F.coalesce("s.unverified", F.lit(False))}).drop("s", "edits")

    segs = followed(segments)
    dirty = segs.where("unverified").select("doc_id", "seg_idx", F.lit(True).alias("dirty"))
    sigs = followed(signals).join(dirty, ["doc_id", "seg_idx"], "left").withColumn("unverified", F.col("unverified") | F.coalesce("dirty", F.lit(False))).drop("dirty")
    return segs, sigs


def current(results: DataFrame, docs: DataFrame) -> DataFrame:
    """Of results (doc_id, text_sha256, ticket, ...), the last asked for that is of the text as it is now."""
    now = docs.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    own = results.join(now, ["doc_id", "text_sha256"])
    last = own.groupBy("doc_id").agg(F.max("ticket").alias("ticket"))
    return own.join(last, ["doc_id", "ticket"])
