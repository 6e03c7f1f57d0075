"""Repair of conversations whose turns are out of order, missing, repeated or cut: an error-correcting Earley parser of roles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..shipping import ship
from .shared import pieces

#: What the edits cost, and a kept or reroled row that is truncated.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
BLANKS, CLOSERS = "\t\n\x0b\x0c\r ", ".!?"


class Rule(NamedTuple):
    """head -> body role: what ``body`` covers, then a turn of ``role``; no body begins, no role stands for a row that goes."""

    head: str
    body: str | None
    role: str | None


#: A system turn or none, then pairs of a user's and an assistant's; nothing at all is a dialog too. Each production's turn may be
#: a row as it is, a row with another role, or put in; and each head may be followed by rows that go.
GRAMMAR = (
    Rule("Empty", None, None),
    Rule("System", "Empty", "system"),
    Rule("Asked", "Empty", "user"),
    Rule("Asked", "System", "user"),
    Rule("Asked", "Answered", "user"),
    Rule("Answered", "Asked", "assistant"),
    *(Rule(head, head, None) for head in ("Empty", "System", "Asked", "Answered")),
)
WHOLE = ("Empty", "Answered")
#: Roles that rows may be given and that may be put in.
GIVEN = ("user", "assistant")


class Item(NamedTuple):
    """A completed head over the rows so far: its cost, the place of its audit among those of its set, and how it came about."""

    cost: int
    rank: int
    before: Item | None
    edits: str
    roles: tuple[str, ...]


def closure(chart: dict[str, Item], grammar: Sequence[Rule] = GRAMMAR) -> list[tuple[str, Item, str, tuple[str, ...], int]]:
    """All that a set's items predict without a further row, as (head, item, letters, roles, cost): the items, and turns put in behind them."""
    out = [(head, item, "", (), item.cost) for head, item in chart.items()]
    best = {head: item.cost for head, item in chart.items()}
    todo = list(out)
    while todo:
        head, item, letters, roles, cost = todo.pop(0)
        for rule in grammar:
            # more than one turn in a row pays only if it opens a new head for less
            if rule.body == head and rule.role in GIVEN and cost + INSERT <= best.get(rule.head, cost + INSERT):
                best[rule.head] = cost + INSERT
                new = (rule.head, item, letters + "I", (*roles, rule.role), cost + INSERT)
                out.append(new)
                todo.append(new)
    return out


def scanned(states: list, initial: str, must_go: bool, truncated: bool, grammar: Sequence[Rule] = GRAMMAR) -> dict[str, Item]:
    """The next set: each head's least (cost, audit) once a row is kept, given another role, or gone.

    Audits of items of one set each end on a row, so none is the beginning of
    another: they compare by the rank of what they continue, then by letters.
    """
    least: dict[str, tuple] = {}
    for head, item, letters, roles, cost in states:
        for rule in grammar:
            if rule.body != head:
                continue
            if rule.role is None:
                moves = (("D", DELETE, ()),)
            elif must_go:
                continue
            else:
                kept = (("K", TRUNCATED * truncated, ("",)),) if rule.role[0] == initial else ()
                moves = (*kept, *((("R", REROLE + TRUNCATED * truncated, (rule.role,)),) if rule.role in GIVEN else ()))
            for letter, price, role in moves:
                found = (cost + price, item.rank, letters + letter, item, (*roles, *role))
                if rule.head not in least or found[:3] < least[rule.head][:3]:
                    least[rule.head] = found
    order = {at: k for k, at in enumerate(sorted({x[1:3] for x in least.values()}))}
    return {head: Item(c, order[rank, edits], item, edits, roles) for head, (c, rank, edits, item, roles) in least.items()}


def parsed(rows: Iterable[tuple[str, bool, bool]]) -> tuple[int, str, list[tuple[str, ...]]]:
    """(cost, audit, plan) of the cheapest repair of rows (initial of the role, whether it must go, whether it is truncated).

    Ties go to the audit that is least in ASCII. The plan has, for each row
    and for the end, what is put in before it, then "" if the row stays, its
    new role, or nothing if it goes. Heads are left-recursive, so all items
    begin at the first row and a set has one for each head: time and memory
    are linear in the rows.
    """
    chart = {rule.head: Item(0, 0, None, "", ()) for rule in GRAMMAR if rule.body is None and rule.role is None}
    for initial, must_go, truncated in rows:
        chart = scanned(closure(chart), initial, must_go, truncated)
    cost, _, letters, item, roles = min(((c, item.rank, letters, item, roles) for head, item, letters, roles, c in closure(chart) if head in WHOLE), key=lambda x: x[:3])
    audit, plan = [letters], [roles]
    while item.before is not None:
        audit.append(item.edits)
        plan.append(item.roles)
        item = item.before
    return cost, "".join(reversed(audit)), plan[::-1]


def faults(rows: Sequence[tuple[str, str]]) -> list[str]:
    """The first fault of each row (role, text): blank, duplicate, truncated, or none."""
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(BLANKS)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in CLOSERS else "")
        seen.add((role, text))
    return out


def repaired(rows: Sequence[tuple[str, str]]) -> tuple[list[str], int, str, list[tuple[str, str]]]:
    """(faults, cost, audit, rows): a conversation's rows (role, text) as they should be."""
    found = faults(rows)
    cost, audit, plan = parsed((role[:1], f in ("blank", "duplicate"), f == "truncated") for (role, _), f in zip(rows, found))
    out, step = [], iter(audit)
    for k, roles in enumerate(plan):
        for role in roles:
            letter = next(step)
            while letter == "D":
                letter = next(step)
            out.append((role, "") if letter == "I" else (role or rows[k][0], rows[k][1]))
    return found, cost, audit, out


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, rows) of (conv_id, turn, role, text): an array of what is left of each row, by crc32 of ``conv_id:turn`` modulo 20.

    0 drops it, 1 empties the text, 2 takes the marks [.!?] out, 3 has it
    twice, 4 makes its role user. Nulls are one space, in the hash too.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    role, text = F.when(F.col("kind") == 4, "user").otherwise(plain("role")), F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    one = F.struct(role.alias("role"), text.alias("text"))
    left = F.when(F.col("kind") == 0, F.array()).when(F.col("kind") == 3, F.array(one, one)).otherwise(F.array(one))
    return rows.withColumn("kind", kind).select("conv_id", "turn", left.alias("rows"))


def gathered(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, rows): each conversation's rows in the order of turn (nulls first), role and text, and the turns of those that are left.

    A conversation of which nothing is left stays, with empty arrays. A row
    without a conv_id belongs to no conversation.
    """
    one = F.transform("rows", lambda r: F.struct(F.col("turn").isNotNull().alias("there"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), r["role"].alias("role"), r["text"].alias("text")))
    lists = rows.where("conv_id is not null").select("conv_id", one.alias("r")).groupBy("conv_id").agg(F.array_sort(F.flatten(F.collect_list("r"))).alias("r"))
    turn = lambda r: F.when(r["there"], r["turn"])
    return lists.select("conv_id", F.transform("r", turn).alias("turns"), F.transform("r", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("rows"))


def gaps(turns: Column) -> Column:
    """Numbers that are missing between the least and the greatest turn; nulls don't count."""
    own = F.array_distinct(F.array_compact(turns))
    return F.coalesce(F.array_max(own) - F.array_min(own) + 1 - F.size(own), F.lit(0)).cast("long")


REPAIR = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


def repairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired, repaired_sha256) of ``gathered`` conversations.

    ``illegal`` counts neighbours whose roles' initials are none of su, ua and
    au; ``repaired`` has the rows of the cheapest repair, ``repaired_sha256``
    the digest of their ``role:text`` lines. A conversation is one row, and
    a task holds a few at a time; the parser's work is linear in its rows.
    """
    ship(conversations.sparkSession)
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {id_type}, gaps long, {REPAIR}"
    arrow = to_arrow_schema(conversations.sparkSession.createDataFrame([], schema).schema)

    def one(rows: list[dict]) -> tuple:
        said = [(r["role"], r["text"]) for r in rows]
        found, cost, audit, out = repaired(said)
        illegal = sum(a[0][:1] + b[0][:1] not in LEGAL for a, b in zip(said, said[1:]))
        digest = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in out).encode()).hexdigest()
        return found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, [{"role": r, "text": t} for r, t in out], digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                made = list(zip(*map(one, part.column(2).to_pylist()))) or [()] * 8
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, f.type) for x, f in zip(made, list(arrow)[2:]))], schema=arrow)

    return conversations.select("conv_id", gaps(F.col("turns")).alias("gaps"), "rows").mapInArrow(run, schema)
