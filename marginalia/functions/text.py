"""Places in text: all matches of a pattern with offsets, running sums, context, words."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CONTEXT

#: Line ends are \n only, and \w, \s, \b know all of Unicode.
FLAGS = "(?dU)"
#: White space of any kind, to be taken off a text's ends.
BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Items that one fold of a running sum goes over.
FOLD = 256
MATCH = "array<struct<start:int,end:int,matched:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(sizes: Column) -> Column:
    """For an array of sizes, the sum of those before each.

    Folds over parts of ``FOLD`` sizes, then over the parts' sums: a fold
    copies what it has gathered at each step, so one fold over a long array
    would take the square of its length.
    """
    def spread(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x))
        inner = lambda p, s: F.slice(F.aggregate(p, F.array(s), lambda a, x: F.array_append(a, F.element_at(a, -1) + x)), 1, F.size(p))
        return F.flatten(F.zip_with(parts, F.slice(starts, 1, F.size(parts)), inner))

    def cut(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / FOLD).cast("int")), lambda k: F.slice(all_, k * FOLD + 1, FOLD))

    return let(sizes, lambda s: F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(let(cut(s), spread)))


def first_where(n: Column, passes: Callable[[Column], Column]) -> Column:
    """The least of 0 to n - 1 that passes, else n, by halving; ``passes`` must not fail again behind one that passes."""
    def step(at: Column, _: Column) -> Column:
        mid = F.floor((at["low"] + at["high"]) / 2).cast("int")
        open_ = at["low"] < at["high"]
        yes = open_ & passes(F.least(mid, n - 1))
        return F.struct(F.when(open_ & ~yes, mid + 1).otherwise(at["low"]).cast("int").alias("low"), F.when(yes, mid).otherwise(at["high"]).cast("int").alias("high"))

    start = F.struct(F.lit(0).alias("low"), n.cast("int").alias("high"))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + F.lit(1))).cast("int"))
    return F.when(n > 0, F.aggregate(steps, start, step, lambda at: at["low"])).otherwise(0)


def _placed(x: Column) -> Column:
    """Places of what was found, by what lies between; lengths alternate, so a running sum gives them."""
    sizes = F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), x["found"], lambda g, m: F.struct(F.length(g).alias("gap"), (F.length(g) + F.length(m)).alias("both"), m.alias("m")))
    return let(sizes, lambda s: F.zip_with(running(F.transform(s, lambda y: y["both"])), s, lambda at, y: F.struct((at + y["gap"]).alias("start"), (at + y["both"]).alias("end"), y["m"].alias("matched"))))


def matches(text: Column, pattern: str, flags: str = FLAGS) -> Column:
    """All matches of a pattern, none of them empty, as (start, end, matched); code points, end exclusive.

    Two scans with the same engine give the matches and what lies between
    them. A text without a match is scanned once.
    """
    p = flags + pattern
    both = F.struct(F.split(text, p, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("found"))
    return F.when(text.rlike(p), let(both, _placed)).otherwise(F.array()).cast(MATCH)


def hits(text: Column, patterns: Sequence[tuple[int, str, Column | None]], when: Column | None = None) -> Column:
    """What each pattern that occurs finds, as (ord, gaps, found), for ``placed_hits``.

    A pattern has a number and perhaps a cheap test that a text with a match
    passes; with ``when`` none is looked for in a text that fails it.
    """
    def one(ord_: int, p: str, test: Column | None) -> Column:
        there = text.rlike(p) if test is None else test & text.rlike(p)
        return F.when(there, F.struct(F.lit(ord_).alias("ord"), F.split(text, p, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("found")))

    found = F.array_compact(F.array(*(one(*x) for x in patterns)))
    return found if when is None else F.when(when, found).otherwise(F.array().cast("array<struct<ord:int,gaps:array<string>,found:array<string>>>"))


def placed_hits(found: Column) -> Column:
    """All matches of ``hits`` as (ord, start, end, matched), pattern by pattern."""
    return F.flatten(F.transform(found, lambda x: F.transform(_placed(x), lambda m: F.struct(x["ord"].alias("ord"), m["start"].alias("start"), m["end"].alias("end"), m["matched"].alias("matched")))))


def before(text: Column, start: Column) -> Column:
    """Up to ``CONTEXT`` code points in front of a place."""
    return F.substring(text, F.greatest(start - (CONTEXT - 1), F.lit(1)), F.least(start, F.lit(CONTEXT)))


def after(text: Column, end: Column) -> Column:
    """Up to ``CONTEXT`` code points from a place on."""
    return F.substring(text, end + 1, F.lit(CONTEXT))


def whitespace_words(text: Column) -> Column:
    """Words between white space of any kind."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def plain_words(text: Column) -> Column:
    """Runs of ASCII letters, digits and apostrophes, straight or curly."""
    return F.regexp_count(text, F.lit("[A-Za-z0-9’']+"))


def utf16_offset(text: Column, at: Column) -> Column:
    """Where a place in code points lies when a text is counted in UTF-16 units."""
    return (F.length(F.encode(F.substring(text, F.lit(1), at), "UTF-16BE")) / 2).cast("int")


def json_value(value: Column) -> Column:
    """A value as JSON text."""
    whole = F.to_json(F.array(value))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)
