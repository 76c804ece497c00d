"""Canonical chat turns from records of many layouts, chosen by a fingerprint of the record's schema.

A record's schema is the set of nested field paths that hold a value in it (`messages[].role`, `prompt`, ...). Its
hash selects one of the declared mappings, which turns prompt, instruction and message layouts into one array of
(role, text) turns. The turns are then written in a template with marked turns, and the loss mask is
a list of code-point spans over the written text. DataFrame functions only.

Escaping: a backslash goes in after each `<` that is followed by any number of backslashes and a bar, so a text never
holds `<|` and taking one backslash away restores it. In roles, `%` and line feeds are written as `%25` and `%0A`.

Defined results: a record whose paths no mapping declares keeps its row, with null turns, layout and output; null texts are empty texts;
a record without turns is written as an empty string; turns keep the record's order; turns of equal number are in order of
role and text; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A declared mapping: the paths that must be there, those that may be, and SQL that makes the turns."""

    name: str
    required: tuple[str, ...]
    turns: str
    optional: tuple[str, ...] = field(default=())

    def signatures(self) -> list[str]:
        some = [c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n)]
        return ["\n".join(sorted({*self.required, *c})) for c in some]


def _single(role: str, column: str) -> str:
    return f"IF({column} IS NULL, array(), array(named_struct('role', '{role}', 'text', {column})))"


def _listed(column: str, role: str, text: str) -> str:
    return f"transform({column}, m -> named_struct('role', coalesce({role}, ''), 'text', coalesce({text}, '')))"


_SPOKEN = "CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END"

#: The declared mappings. The field names of the layouts.
LAYOUTS = (
    Layout("messages", ("messages[].role",), _listed("messages", "m.role", "m.content"), ("messages[].content",)),
    Layout("conversations", ("conversations[].from",), _listed("conversations", _SPOKEN, "m.value"), ("conversations[].value",)),
    Layout("prompt", ("prompt", "response"), f"concat({_single('system', 'system')}, {_single('user', 'prompt')}, {_single('assistant', 'response')})", ("system",)),
    Layout(
        "instruction",
        ("instruction", "output"),
        f"concat({_single('system', 'system')}, {_single('user', "concat(instruction, IF(coalesce(input, '') = '', '', concat('\\n\\n', input)))")}, {_single('assistant', 'output')})",
        ("system", "input"),
    ),
)

#: The fields that the mappings name, and their types.
FIELDS = {"messages": "array<struct<role:string,content:string>>", "conversations": "array<struct<from:string,value:string>>", "system": "string", "prompt": "string", "response": "string", "instruction": "string", "input": "string", "output": "string"}


def present_paths(schema: T.StructType, skip: set[str] = frozenset()) -> list[tuple[str, Column]]:
    """Each nested field path of a schema, and whether a row has a value there."""

    def walk(kind: T.DataType, path: str, at) -> list:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in walk(f.dataType, f"{path}.{f.name}" if path else f.name, lambda r, f=f: at(r)[f.name])]
        if isinstance(kind, T.ArrayType):
            below = walk(kind.elementType, f"{path}[]", lambda e: e)
            return [(p, lambda r, has=has: F.coalesce(F.exists(at(r), has), F.lit(False))) for p, has in below]
        return [(path, lambda r: at(r).isNotNull())]

    return [(p, has(None)) for f in schema.fields if f.name not in skip for p, has in walk(f.dataType, f.name, lambda _, f=f: F.col(f"`{f.name}`"))]


def schema_fingerprint(schema: T.StructType, skip: set[str] = frozenset()) -> Column:
    """64-bit hash of the sorted paths that hold a value in the row."""
    paths = sorted(present_paths(schema, skip), key=lambda x: x[0])
    return F.xxhash64(F.concat_ws("\n", *[F.when(has, F.lit(p)) for p, has in paths]))


def canonical_turns(records: DataFrame, key: list[str], layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records with layout (the mapping's name) and turns. key: columns that are not part of the layout."""
    out = records
    for name, kind in FIELDS.items():
        if name not in records.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    print_of = schema_fingerprint(records.schema, set(key))
    out = out.withColumn("fingerprint", print_of)
    chosen = turns = None
    for x in layouts:
        match = reduce(or_, [F.col("fingerprint") == F.xxhash64(F.lit(s)) for s in x.signatures()])
        chosen = F.when(match, x.name) if chosen is None else chosen.when(match, x.name)
        made = F.expr(x.turns).cast(TURNS)
        turns = F.when(match, made) if turns is None else turns.when(match, made)
    return out.withColumn("layout", chosen).withColumn("turns", turns).drop(*[n for n in FIELDS if n not in key])


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape_text(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape_text(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def format_chat(chats: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """chats, with turns, gets formatted (the text) and loss_spans (code points: start from 0, length) over the texts of loss_roles."""
    piece = lambda t: F.concat(F.lit(START), escape_role(F.coalesce(t["role"], F.lit(""))), F.lit("\n"), escape_text(F.coalesce(t["text"], F.lit(""))), F.lit(END + "\n"))
    pieces = chats.withColumn("_pieces", F.transform("turns", piece)).withColumn("formatted", F.array_join("_pieces", ""))
    size = F.transform("_pieces", lambda p: F.length(p).cast("long"))
    body = F.transform("turns", lambda t: F.length(escape_text(F.coalesce(t["text"], F.lit("")))).cast("long"))
    sized = pieces.withColumn("_sizes", F.arrays_zip(size.alias("size"), body.alias("body"), F.transform("turns", lambda t: F.coalesce(t["role"], F.lit("")).isin(*loss_roles)).alias("taken")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    tail = len(END) + 1

    def step(acc: Column, x: Column) -> Column:
        span = F.array(F.struct((acc["at"] + x["size"] - tail - x["body"]).alias("start"), x["body"].alias("length")))
        return F.struct((acc["at"] + x["size"]).alias("at"), F.when(x["taken"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("_sizes", start, step, lambda acc: acc["spans"])
    return sized.withColumn("loss_spans", spans).drop("_pieces", "_sizes")


def read_chat(formatted: Column) -> Column:
    """The turns that a formatted text holds, unescaped."""

    def turn(segment: Column) -> Column:
        body = F.substr(segment, F.locate("\n", segment) + 1)
        return F.struct(unescape_role(F.substring_index(segment, "\n", 1)).alias("role"), unescape_text(F.left(body, F.length(body) - F.lit(len(END) + 1))).alias("text"))

    segments = F.split(formatted, r"<\|im_start\|>")
    return F.transform(F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))), turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape_text(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def records_of(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows by turn (turn, role, text) as one record for each key, in the layout that its turns call for.

    user, assistant: prompt layout, with a system turn before them too; other talks of system, user and assistant only:
    conversations (even keys) or messages; talks with other roles: messages."""
    turns = rows.select(key, "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    talks = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    roles = F.array_join(F.transform("t", lambda t: t["role"]), ",")
    even = F.coalesce(F.col(key) % 2 == 0, F.lit(False))
    pair = roles == "user,assistant"
    full = roles == "system,user,assistant"
    spoken = ~pair & ~full & F.forall("t", lambda t: t["role"].isin("system", "user", "assistant")) & even
    at = lambda i: F.element_at("t", i)["text"]
    name = lambda t: F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"])
    return talks.select(
        key,
        F.when(pair, at(1)).when(full & even, at(2)).alias("prompt"),
        F.when(pair | (full & even), at(-1)).alias("response"),
        F.when(full, at(1)).alias("system"),
        F.when(full & ~even, at(2)).alias("instruction"),
        F.when(full & ~even, at(-1)).alias("output"),
        F.when(spoken, F.transform("t", lambda t: F.struct(name(t).alias("from"), t["text"].alias("value")))).alias("conversations"),
        F.when(~(pair | full | spoken), F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))).alias("messages"),
    )
