"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import unused, written

#: Slots that one row of the schedule's seed grows to.
CHUNK = 4096


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(src, source_size, target) from (src, source, source_size): weighted shares that stop at ``most`` times a size.

    Sources in the order of their code points, null last, take ``weights`` in
    turn. What a source can't take goes to the others by weight: sorted by the
    level at which each is full, the first level that the next one bears is
    the answer, with running sums over one row for each source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    # src only parts ties of the level; a level and src together are unique
    by_level = Window.orderBy("full", "src")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    return (
        sizes.withColumn("w", w)
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("full", F.col("cap") / F.col("w"))
        .withColumn("level", (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "src", "level"))).over(whole)["level"])
        .select("src", "source_size", F.when(F.col("level").isNull() | (F.col("w") * F.col("level") > F.col("cap")), F.col("cap")).otherwise(F.col("w") * F.col("level")).alias("target"))
    )


def schedule(aims: DataFrame, block_words: int) -> DataFrame:
    """(slot, src, rank, first, last): which words of its source each slot takes, slots in the order of the mix.

    The slots are the 2^m van der Corput points, m by the targets' sum over
    ``block_words``. A point lies in the share of one source of the line of
    cumulative targets; the points of a share are consecutive fractions with
    their bits reversed, so each source makes its own, in rows of at most
    ``CHUNK``. The rank is a slot's place among those of its source, counted
    by ranges of slots, then within them, so that a large source is spread
    over tasks. A source takes its words in ``target / slots`` at a time, all
    but equal for all sources; one whose share holds no point gets one slot
    behind all others. ``last`` is exclusive; words past a source's size are
    those of its second turn.
    """
    line = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    shares = (
        aims.where("target >= 1")
        .withColumn("total", F.sum("target").over(whole))
        .withColumn("m", F.greatest(F.lit(4), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("total") / block_words)))).cast("int"))
        .withColumn("points", F.pow(F.lit(2.0), "m").cast("long"))
        .withColumn("high", F.sum("target").over(line))
        .withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("src")), F.lit(0.0)))
        .withColumn("nth", F.row_number().over(Window.orderBy("src")))
        .withColumn("a", F.ceil(F.col("low") / F.col("total") * F.col("points")))
        .withColumn("b", F.least(F.ceil(F.col("high") / F.col("total") * F.col("points")), F.col("points")))
        .withColumn("b", F.when(F.lead("src").over(Window.orderBy("src")).isNull(), F.col("points")).otherwise(F.col("b")))
        .withColumn("slots", F.greatest(F.col("b") - F.col("a"), F.lit(1)))
    )
    def bits(x: Column) -> Column:
        """The number whose m bits are those of ``x`` in reverse."""
        return F.conv(F.reverse(F.lpad(F.bin(x), F.col("m"), "0")), 2, 10).cast("long")

    chunks = shares.select("src", "target", "slots", "m", "points", "nth", "a", "b", F.explode(F.when(F.col("b") > F.col("a"), F.sequence(F.floor(F.col("a") / CHUNK), F.floor((F.col("b") - 1) / CHUNK))).otherwise(F.array(F.lit(-1).cast("long")))).alias("chunk"))
    inside = F.sequence(F.greatest(F.col("a"), F.col("chunk") * CHUNK), F.least(F.col("b"), (F.col("chunk") + 1) * CHUNK) - 1)
    slots = (
        chunks.repartition("src", "chunk")
        .select("src", "target", "slots", "m", F.when(F.col("chunk") >= 0, inside).otherwise(F.array(F.lit(-1).cast("long"))).alias("js"), (F.col("points") + F.col("nth")).alias("behind"))
        .select("src", "target", "slots", "m", "behind", F.explode("js").alias("j"))
        .select("src", "target", "slots", F.when(F.col("j") < 0, F.col("behind")).otherwise(bits(F.col("j"))).alias("slot"))
        .withColumn("range", F.floor(F.col("slot") / CHUNK))
    )
    counts = slots.groupBy("src", "range").agg(F.count("*").alias("n"))
    earlier = counts.select("src", "range", F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    # Spark takes exploded rows to be few, and would send all slots through the driver; the ranks need them by range anyway
    ranked = slots.hint("merge").join(earlier.hint("merge"), ["src", "range"]).withColumn("rank", F.col("earlier") + F.row_number().over(Window.partitionBy("src", "range").orderBy("slot")) - 1)
    edge = lambda r: F.when(r == F.col("slots"), F.floor("target")).otherwise(F.floor(r * F.col("target") / F.col("slots")))
    return ranked.select("slot", "src", "rank", edge(F.col("rank")).alias("first"), edge(F.col("rank") + 1).alias("last"))


def _taken(docs: DataFrame, weights: Sequence[float], share: float, most: float, block_words: int, seed: str, keep: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame, list[str]]:
    """Rows with a number each (``row``), their places on their lines, the pieces of them that slots take, and the names that ``keep`` has in the rows.

    Kept columns stay with the rows: places and pieces go by the numbers, which
    are the rows' own once these are written. Rows with all the same values may
    change places, as nothing then tells which is which.
    """
    kept = [unused(f"kept_{i}", keep) for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, kept)), F.col("doc_id").alias("id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    rows = rows.withColumn("src", _key(F.col("source"))).withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))))
    # two hashes of what is kept order the rows of one id and size
    rows = rows.withColumn("mark", F.struct(*(F.xxhash64(F.lit(i), *kept).alias(f"m{i}") for i in range(2))))
    rows = written(rows.withColumn("range", F.substring("h", 1, 3)).withColumn("row", F.monotonically_increasing_id()), "sizes")
    per_range = rows.groupBy("src", "range").agg(F.sum("size").alias("words"), F.first("source", True).alias("source"))
    sizes = per_range.groupBy("src").agg(F.first("source", True).alias("source"), F.sum("words").alias("source_size"))
    aims = written(targets(sizes, weights, share, most), "targets")
    earlier = per_range.select("src", "range", F.coalesce(F.sum("words").over(Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    before = Window.partitionBy("src", "range").orderBy("h", "id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select("row", "src", "range", "h", "id", "size", "mark").join(earlier, ["src", "range"]).withColumn("start", F.col("earlier") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = written(placed.join(aims, "src").select("row", "src", "size", "source_size", "target", "start"), "placed")
    plan = schedule(aims, block_words)
    # written, so that its size is known: Spark took these few rows for more than the turns, and sent all turns through the driver instead
    blocks = written(plan.groupBy("src").agg(F.count("*").alias("slots")), "slots")
    starts = F.array(F.col("start"), F.col("start") + F.col("source_size"))
    turns = placed.where("size > 0").select("row", "src", "size", "target", F.posexplode(starts).alias("turn", "start")).withColumn("stop", F.least(F.col("start") + F.col("size"), F.floor("target"))).where("stop > start")
    # the first and last rank that a turn may touch, one more on each side for the rounding of edges
    rank = lambda x: F.floor(x * F.col("slots") / F.col("target"))
    touched = turns.join(blocks, "src").select("row", "src", "turn", "start", "stop", F.explode(F.sequence(F.greatest(F.lit(0), rank(F.col("start")) - 1), F.least(F.col("slots") - 1, rank(F.col("stop")) + 1))).alias("rank"))
    # both sides grow with the table and are more than Spark takes them for
    took = touched.hint("merge").join(plan.hint("merge"), ["src", "rank"]).withColumn("place", F.greatest("start", "first")).withColumn("end", F.least("stop", "last")).where("end > place")
    took = took.select("row", "slot", "place", "turn", (F.col("place") - F.col("start")).alias("first"), (F.col("end") - F.col("start")).alias("last"))
    return rows.select("row", *kept), placed.select("row", "size", "source_size", "target"), took, kept


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = 8192, seed: str = "mix", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source): ``keep`` and size, source_size, target, taken, first_slot, n_pieces.

    A source's rows lie on a line in the order of an md5 of seed and doc_id;
    running sums by ranges of that hash, then within a range, give each its
    words on the line, at the same cost for a source of any size. The line is
    gone along at most ``most`` (up to 2) times. Each slot of the schedule
    takes a block of its source's line; a row's ``taken`` are the words of its
    own that slots took (``pieces`` lists them), never more than twice its size;
    ``first_slot`` is where in the mix it first comes, null for one that no slot
    takes, and ``n_pieces`` in how many pieces. DataFrame operations only; the same
    rows give the same result. Null texts have size 0, null sources are one
    source, an empty table gives no rows. Columns of ``docs`` not in ``keep``
    are not looked at; ``keep`` may not name one of the added ones.
    """
    rows, placed, took, kept = _taken(docs, weights, share, most, block_words, seed, keep)
    sums = took.groupBy("row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_pieces"))
    out = rows.join(placed.join(sums, "row", "left"), "row")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, kept)), "size", "source_size", "target", zero("taken"), F.col("first_slot").cast("long").alias("first_slot"), zero("n_pieces"))


def pieces(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block_words: int = 8192, seed: str = "mix", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(keep, size, source_size, target, taken) as ``mix``, which takes the same arguments, with ``pieces`` behind: (slot, place, turn, first, last) of all that slots take of a row.

    The order of the mix is that of (slot, place), place being where a piece
    begins on its source's line of two turns. A piece is the row's words from
    ``first`` up to ``last``, exclusive, in the first (0) or second (1) turn.
    ``taken`` is the sum of the pieces; a row that no slot takes has none.
    Kept columns, texts too, meet the pieces in one join and are moved by no other step.
    """
    rows, placed, took, kept = _taken(docs, weights, share, most, block_words, seed, keep)
    one = F.struct(*(F.col(c).cast("long").alias(c) for c in ("slot", "place", "turn", "first", "last")))
    took = took.select("row", one.alias("p")).groupBy("row").agg(F.array_sort(F.collect_list("p")).alias("pieces"))
    out = rows.join(placed.join(took, "row", "left"), "row").withColumn("pieces", F.coalesce("pieces", F.array().cast(took.schema["pieces"].dataType)))
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, p: n + p["last"] - p["first"])
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, kept)), "size", "source_size", "target", taken.alias("taken"), "pieces")


def with_texts(text: Column, size: Column, pieces: Column) -> Column:
    """``pieces`` with the text of each: its words, the white space behind each, and that before the text's first word."""
    words = F.regexp_extract_all(text, F.lit(r"(?:^[\x20\x09-\x0D]+)?[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    part = lambda w, p: F.when((p["first"] == 0) & (p["last"] == size), text).otherwise(F.array_join(F.slice(w, (p["first"] + 1).cast("int"), (p["last"] - p["first"]).cast("int")), ""))
    # an array of one, so that a text is cut into words once for all of its pieces
    once = F.array(F.when(F.exists(pieces, lambda p: (p["first"] > 0) | (p["last"] < size)), words))
    return F.transform(once, lambda w: F.transform(pieces, lambda p: F.struct(*(p[c].alias(c) for c in ("slot", "place", "turn", "first", "last")), part(w, p).alias("text"))))[0]
