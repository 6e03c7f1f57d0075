"""Which signals are drawn where, and in what order they are listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SIGNALS


def placed(signals: Column, start: Column) -> Column:
    """Signals with a place, by start and then weight, each kept if it begins behind the last one kept."""
    some = F.filter(signals, lambda s: (s["level"] == "token") & s["start"].isNotNull())
    order = lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).when(x["weight"] != y["weight"], F.when(x["weight"] > y["weight"], -1).otherwise(1)).otherwise(0)
    first = F.struct(start.cast("int").alias("last"), F.array().cast(SIGNALS).alias("kept"))
    step = lambda acc, s: F.when(s["start"] >= acc["last"], F.struct(s["end"].alias("last"), F.array_append(acc["kept"], s).alias("kept"))).otherwise(acc)
    return F.aggregate(F.array_sort(some, order), first, step, lambda acc: acc["kept"])


def ranked(signals: DataFrame) -> DataFrame:
    """Rows of signals with ``rank`` in their document: by weight, the heaviest first, then place."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("weight"), F.coalesce("start", F.lit(0)), "seg_idx", "nth")
    return signals.withColumn("rank", F.row_number().over(w))


def listed(signals: DataFrame) -> DataFrame:
    """Rows of signals with ``rank``: what speaks for a person first, then for a machine, then neutral; by weight within."""
    order = F.when(F.col("direction") == "human", 0).when(F.col("direction") == "machine", 1).otherwise(2)
    w = Window.partitionBy("doc_id").orderBy(order, F.desc("weight"), F.coalesce("start", F.lit(0)), "seg_idx", "nth")
    return signals.withColumn("rank", F.row_number().over(w))


def shade(weight: Column, direction: Column) -> Column:
    """How strong a mark's colour is, in percent of the way; null for neutral, which has none."""
    return F.when(direction != "neutral", F.bround(F.least(F.greatest(weight, F.lit(0.10)), F.lit(0.60)) / 0.60 * 100, 0).cast("int"))


def border(lean: Column) -> Column:
    """Which side a paragraph's border takes."""
    return F.when(lean > 0.15, "m").when(lean < -0.15, "h").otherwise("n")


def bar_width(weight: Column) -> Column:
    """Pixels of a signal's bar."""
    return F.bround(F.greatest(F.lit(12.0), weight * 80), 0).cast("int")
