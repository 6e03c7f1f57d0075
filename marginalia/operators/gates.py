"""Which of very many patterns a text can match at all: literals that each match must have, met in one pass over the text."""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Sequence
from re import _constants as sre
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import let

#: Letters of a piece by which literals are looked up, and buckets of the table of pieces.
PIECE, BUCKETS = 3, 1024
#: Letters that fold to ASCII ones in a match, but not in lower case.
FOLDING = "[ſKİı]"
_REPEATS = (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT)


def _parts(nodes) -> list:
    """A sequence of nodes with its groups opened up."""
    out = []
    for op, arg in nodes:
        if op is sre.SUBPATTERN:
            out += _parts(arg[3])
        elif op is sre.ATOMIC_GROUP:
            out += _parts(arg)
        else:
            out.append((op, arg))
    return out


def _required(nodes) -> frozenset[str] | None:
    sets, run = [], ""

    def ended() -> str:
        if len(run) >= PIECE:
            sets.append(frozenset([run]))
        return ""

    for op, arg in _parts(nodes):
        if op is sre.LITERAL and arg < 128 and chr(arg).isalnum():
            run += chr(arg).lower()
            continue
        if op is sre.AT:  # a place takes no room
            continue
        run = ended()
        if op in _REPEATS and arg[0] > 0:
            sets.append(_required(arg[2]))
        elif op is sre.BRANCH:
            each = [_required(x) for x in arg[1]]
            sets.append(frozenset().union(*each) if all(each) else None)
    ended()
    known = [s for s in sets if s]
    return max(known, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def required(pattern: str) -> frozenset[str] | None:
    """Literals of ASCII letters and digits in lower case, of which each match of a pattern, in any case, has at least one; None if no such set is found.

    They are read from the pattern's syntax tree: a run of literals is
    required, so is what a part that occurs at least once requires, and
    alternatives require one of what each does. The set whose shortest literal
    is the longest counts. What Python's parser doesn't know has none.
    """
    try:
        return _required(_parser.parse(pattern))
    except (re.error, ValueError, RecursionError, OverflowError):
        return None


class Gate:
    """A table of the literals of numbered patterns, by one piece of each: the one that the fewest literals have."""

    def __init__(self, literals: Sequence[tuple[int, frozenset[str]]]):
        self.numbers = [k for k, _ in literals]
        by_literal: dict[str, list[int]] = {}
        for k, own in literals:
            for x in sorted(own):
                by_literal.setdefault(x, []).append(k)
        pieces = lambda x: [x[i : i + PIECE] for i in range(len(x) - PIECE + 1)]
        often = Counter(p for x in by_literal for p in set(pieces(x)))
        self.table: list[list[dict]] = [[] for _ in range(BUCKETS)]
        for x, ks in by_literal.items():
            piece = min(pieces(x), key=lambda p: (often[p], p))
            self.table[zlib.crc32(piece.encode()) % BUCKETS].append({"p": piece, "l": x, "k": ks})

    def passing(self, text: Column) -> Column:
        """The numbers of patterns that have a literal in the text, as an array."""
        table = F.from_json(F.lit(json.dumps(self.table)), "array<array<struct<p:string,l:string,k:array<int>>>>")
        cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - (PIECE - 1)), lambda i: F.substring(w, i, F.lit(PIECE)))

        def found(low: Column) -> Column:
            words = F.filter(F.array_distinct(F.split(low, "[^a-z0-9]+")), lambda w: F.length(w) >= PIECE)
            met = lambda p: F.filter(F.get(table, (F.crc32(p) % BUCKETS).cast("int")), lambda e: (e["p"] == p) & low.contains(e["l"]))
            return F.flatten(F.transform(F.array_distinct(F.flatten(F.transform(words, cut))), met))

        some = F.array_distinct(F.flatten(F.transform(let(F.lower(text), found), lambda e: e["k"])))
        return F.when(text.rlike(FOLDING), F.from_json(F.lit(json.dumps(self.numbers)), "array<int>")).otherwise(some)


def gated_hits(text: Column, patterns: Sequence[tuple[int, str, frozenset[str]]]) -> Column:
    """What numbered patterns find, as ``functions.text.hits`` says it; a pattern meets only texts that pass its gate.

    The patterns are data of one expression, so a plan with a thousand rules is as small as one with ten.
    """
    numbers = sorted(k for k, _, _ in patterns)
    place = {k: i for i, k in enumerate(numbers)}
    own = {k: p for k, p, _ in patterns}
    listed = F.from_json(F.lit(json.dumps([own[k] for k in numbers])), "array<string>")
    order = F.from_json(F.lit(json.dumps(numbers)), "array<int>")
    gate = Gate([(place[k], literals) for k, _, literals in patterns])

    def tried(i: Column) -> Column:
        return let(F.get(listed, i), lambda p: F.when(F.rlike(text, p), F.struct(F.get(order, i).alias("ord"), F.split(text, p, -1).alias("gaps"), F.regexp_extract_all(text, p, F.lit(0)).alias("found"))))

    return F.array_compact(F.transform(gate.passing(text), tried))
