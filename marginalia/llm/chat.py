"""Chat formatting: layouts told apart by a hash of their field paths, one template for all."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, STOP = "<|im_start|>", "<|im_end|>\n"
#: What a control string goes on with behind its first character: <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>, <|name|>.
_REST = r"(?=/?s>|/?INST\]|</?SYS>>|\|[A-Za-z0-9_]+\|>)"


def escaped(text: Column) -> Column:
    """A backslash more behind the first character of each control string, so that none is left as it was."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _REST, r"$1\\$2")


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given: a backslash less in each place where it put one."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _REST, "$1$2")


def _role_in(role: Column) -> Column:
    return escaped(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of all leaves of a type, ``[]`` for the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}".lstrip("."))]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    return [at]


def fingerprint(paths: Iterable[str]) -> str:
    """The hash of a set of field paths; their order and letter case don't matter."""
    return hashlib.sha256("\n".join(sorted({p.lower() for p in paths})).encode()).hexdigest()


def _turn(role: str | Column, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).cast("string").alias("role"), text.cast("string").alias("text"))


def _said(*turns: tuple[str, str]) -> Callable[[Callable[[str], Column]], Column]:
    return lambda of: F.array(*(_turn(role, of(field)) for role, field in turns))


def _listed(field: str, role: str, text: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda of: F.transform(of(field), lambda m: _turn(F.coalesce(F.try_element_at(_names(), F.lower(m[role])), m[role]), m[text]))


def _led(field: str, role: str, text: str) -> Callable[[Callable[[str], Column]], Column]:
    """What a list says, behind the system's own field."""
    return lambda of: F.concat(F.array(_turn("system", of("system"))), _listed(field, role, text)(of))


def _with_input(of: Callable[[str], Column]) -> Column:
    asked = F.when(F.coalesce(F.length(of("input")), F.lit(0)) > 0, F.concat(F.coalesce(of("instruction"), F.lit("")), F.lit("\n\n"), of("input"))).otherwise(of("instruction"))
    return F.array(_turn("user", asked), _turn("assistant", of("output")))


#: Names that layouts have for the roles.
_ROLES = {"human": "user", "user": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "assistant": "assistant", "system": "system"}
#: Layouts: the field paths of each, and how they become turns.
LAYOUTS: dict[str, tuple[tuple[str, ...], Callable]] = {
    "turn-rows": (("turn", "role", "text"), lambda of: F.array(_turn(of("role"), of("text")))),
    "messages": (("messages[].role", "messages[].content"), _listed("messages", "role", "content")),
    "shared": (("conversations[].from", "conversations[].value"), _listed("conversations", "from", "value")),
    "system-messages": (("system", "messages[].role", "messages[].content"), _led("messages", "role", "content")),
    "system-shared": (("system", "conversations[].from", "conversations[].value"), _led("conversations", "from", "value")),
    "prompt-response": (("prompt", "response"), _said(("user", "prompt"), ("assistant", "response"))),
    "prompt-completion": (("prompt", "completion"), _said(("user", "prompt"), ("assistant", "completion"))),
    "system-prompt-response": (("system", "prompt", "response"), _said(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    "question-answer": (("question", "answer"), _said(("user", "question"), ("assistant", "answer"))),
    "instruction-output": (("instruction", "output"), _said(("user", "instruction"), ("assistant", "output"))),
    "instruction-input-output": (("instruction", "input", "output"), _with_input),
}
TURN_ROWS = ("conv_id", "turn", "role", "text")
BY_FINGERPRINT = {fingerprint(paths): name for name, (paths, _) in LAYOUTS.items()}
#: All fields that some layout has, for records in JSON.
RECORD = "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, system string, prompt string, response string, completion string, question string, answer string, instruction string, input string, output string"


def _names() -> Column:
    return F.create_map(*(F.lit(x) for kv in _ROLES.items() for x in kv))


def _top(path: str) -> str:
    return path.split("[")[0].split(".")[0].lower()


def layout_of(df: DataFrame) -> str:
    """The layout that the nested fields of ``df`` have, told by fingerprint; else an error.

    The paths below the columns that a layout names are hashed; the hash must
    be a layout's, so a list of other fields than the layout's is none. Other
    columns may stand beside them. Of layouts that fit, that of most paths
    counts, then the first.
    """
    paths = field_paths(df.schema)
    marks = (fingerprint(p for p in paths if _top(p) in {_top(x) for x in own}) for own, _ in sorted(LAYOUTS.values(), key=lambda x: -len(x[0])))
    try:
        return next(BY_FINGERPRINT[m] for m in marks if m in BY_FINGERPRINT)
    except StopIteration:
        raise ValueError(f"no layout has the fields {sorted(paths)}") from None


def _turns(name: str, of: Callable[[str], Column]) -> Column:
    return LAYOUTS[name][1](of)


def layouts_in(df: DataFrame) -> list[str]:
    """All layouts whose fields a table has, as ``layout_of`` tells one, the smallest first."""
    paths = field_paths(df.schema)
    fits = lambda own: fingerprint(p for p in paths if _top(p) in {_top(x) for x in own}) == fingerprint(own)
    return sorted((n for n, (own, _) in LAYOUTS.items() if n != "turn-rows" and fits(own)), key=lambda n: len(LAYOUTS[n][0]))


def turn_rows(df: DataFrame, conv_id: str = "conv_id", with_layout: bool = False) -> DataFrame:
    """(conv_id, turn, role, text) of records in any layout that ``layout_of`` knows, with ``layout`` on demand.

    Where a table has the fields of several layouts, each row has its own: the
    hash of the paths of the fields that it fills (those that aren't null)
    selects it; a row whose fields are no layout's has the smallest one that
    has them all, with null texts for those that are missing. A row that fills
    fields which no layout has together is one row with null layout, turn,
    role and text, so that nothing goes unseen. Null lists and empty ones have
    no turns; a null conv_id, and rows that repeat, are as they are; an empty
    table gives no rows.
    """
    layout = [F.col("layout")] if with_layout else []
    if layout_of(df) == "turn-rows":
        return df.withColumn("layout", F.lit("turn-rows")).select(*TURN_ROWS, *layout)
    fitting = layouts_in(df)
    tops = {n: sorted({_top(p) for p in LAYOUTS[n][0]}) for n in fitting}
    fields = sorted({f for own in tops.values() for f in own})
    own_paths = {f: sorted({p for n in fitting for p in LAYOUTS[n][0] if _top(p) == f}) for f in fields}
    filled = F.flatten(F.array(*(F.when(F.col(f).isNotNull(), F.array(*map(F.lit, own_paths[f]))).otherwise(F.array().cast("array<string>")) for f in fields)))
    marks = F.create_map(*(F.lit(x) for n in fitting for x in (fingerprint(LAYOUTS[n][0]), n)))
    exact = F.try_element_at(marks, F.sha2(F.array_join(F.array_sort(filled), "\n"), 256))

    def holds(n: str) -> Column:
        """Whether a row fills no field but those of a layout."""
        others = [F.col(f).isNull() for f in fields if f not in tops[n]]
        return reduce(lambda a, x: a & x, others, F.lit(True))

    name = F.coalesce(exact, *(F.when(holds(n), F.lit(n)) for n in fitting))
    turns = F.coalesce(*(F.when(name == n, _turns(n, F.col)) for n in fitting))
    rows = df.select(F.col(conv_id).alias("conv_id"), name.alias("layout"), turns.alias("turns")).select("conv_id", "layout", F.posexplode_outer("turns").alias("turn", "t"))
    return rows.where("turn is not null or layout is null").select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text", *layout)


def json_turn_rows(df: DataFrame, record: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, layout, turn, role, text) of JSON records, each in a layout of its own.

    A record's fingerprint is the hash of the nested paths that it fills, as
    its own JSON has them; it selects the layout. A record with none that fits
    (messages with other fields than the layout's too), or that is no JSON, is
    one row with null layout, turn, role and text, so that nothing goes unseen.
    Fields that no layout knows don't matter.
    """
    seen = df.select(F.col(conv_id).alias("conv_id"), F.from_json(F.col(record), RECORD).alias("r"), F.try_parse_json(F.col(record)).alias("v"))
    fields = sorted({_top(p) for paths, _ in LAYOUTS.values() for p in paths} - set(TURN_ROWS))
    mark = F.sha2(F.concat_ws("\n", F.array_sort(F.flatten(F.array(*map(_paths_in, fields))))), 256)
    name = F.try_element_at(F.create_map(*(F.lit(x) for kv in BY_FINGERPRINT.items() for x in kv)), mark)
    of = lambda field: F.col(f"r.`{field}`")
    turns = F.coalesce(*(F.when(F.col("layout") == n, _turns(n, of)) for n in LAYOUTS if n != "turn-rows"))
    return seen.withColumn("layout", name).select("conv_id", "layout", F.posexplode_outer(turns).alias("turn", "t")).select("conv_id", "layout", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def _paths_in(field: str) -> Column:
    """Paths that a JSON record ``v`` fills below one field: none if it is missing or null.

    Texts are paths as they are. What a layout can't read (a number, a list of
    lists, a message in parts) has its type behind it, so that no layout's
    fingerprint has it; an empty list has the paths that layouts give its name.
    """
    own = sorted({p for paths, _ in LAYOUTS.values() for p in paths if _top(p) == field})
    kind = F.replace(F.schema_of_variant(F.try_variant_get(F.col("v"), f"$.{field}", "variant")), F.lit("`"), F.lit(""))
    inner = F.regexp_extract(kind, r"^ARRAY<OBJECT<((?:\w+: (?:STRING|VOID)(?:, )?)+)>>$", 1)
    listed = F.transform(F.split(inner, ", "), lambda p: F.concat(F.lit(f"{field}[]."), F.lower(F.substring_index(p, ": ", 1))))
    none = F.array().cast("array<string>")
    return F.when(kind.isNull() | (kind == "VOID"), none).when(kind == "STRING", F.array(F.lit(field))).when(kind == "ARRAY<VOID>", F.array(*map(F.lit, own))).when(inner != "", listed).otherwise(F.array(F.concat(F.lit(f"{field}:"), kind)))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) for each conversation of (conv_id, turn, role, text).

    ``loss`` holds the spans (code points, end exclusive) of what assistants
    say, escapes included, marks not. Turns are in the order of turn, role and
    text, nulls first; a null text is empty, a null role is one without a
    name. A row without a conv_id is a conversation of its own, so that such
    rows, however many, are no group. Places are running sums before
    grouping, so a long conversation costs no more per turn than a short one;
    a row that repeats is a turn that repeats.
    """
    head, text = F.concat(F.lit(START), _role_in(F.col("role")), F.lit("\n")), escaped(F.coalesce("text", F.lit("")))
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), head.alias("head"), text.alias("body"))
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(STOP))
    said = F.when(F.col("role") == "assistant", F.struct((F.col("stop") - F.length("body")).cast("int").alias("start"), F.col("stop").cast("int").alias("stop")))
    piece = F.concat("head", "body", F.lit(STOP))
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.where("conv_id is not null").withColumn("nth", F.row_number().over(own)).withColumn("stop", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - len(STOP))
    one = F.struct("nth", piece.alias("piece"), said.alias("said"))
    grouped = placed.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    out = grouped.select("conv_id", F.array_join("t.piece", "").alias("formatted"), F.array_compact("t.said").alias("loss"))
    alone = rows.where("conv_id is null").withColumn("stop", F.col("size") - len(STOP))
    return out.unionByName(alone.select("conv_id", piece.alias("formatted"), F.array_compact(F.array(said)).alias("loss")))


def read_back(out: DataFrame) -> DataFrame:
    """``turns`` and ``loss_texts`` behind the columns of (conv_id, formatted, loss): the turns as they were, and what the mask shows."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    turn = lambda p: F.struct(_role_out(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"), unescaped(F.substr(p, F.locate("\n", p) + 1)).alias("text"))
    shown = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"])))
    return out.select("*", F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn).alias("turns"), shown.alias("loss_texts"))
