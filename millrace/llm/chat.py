"""Chat formatting: schema fingerprints choose the mapping that turns a layout into canonical turns.

A layout is a set of nested field paths.  For a DataFrame the paths come from its schema, for
JSON records from the variant schema of each row.  The hash of all paths of a record is its
fingerprint; each different fingerprint is resolved once, to the mapping with most of its paths
among the record's, and then selects the mapping of all records that have it.
Canonical turns are ``array<struct<turn, role, text>>``.  They are rendered with a template
that marks turns, and control strings inside texts are escaped reversibly.  The loss mask is a
list of spans of the formatted string.  Everything is DataFrame functions.

Template of a turn: ``### <role>: <text></turn>`` and a line feed.  Escapes: ``\\`` is ``\\s``,
``###`` is ``\\h``, ``</turn>`` is ``\\t``, and a colon in a role is ``\\c``; every backslash of a
formatted text starts one of these codes, so undoing them in the other order is exact.

Defined results: a null text or role is empty; turns are ordered by (turn, role, text), null
turns first; repeated rows are repeated turns; null ids form one conversation; records of an
unknown layout have null turns, a null fingerprint means text that is no JSON; an empty table
gives an empty table; columns and fields that no mapping names are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<turn:bigint,role:string,text:string>>"
#: Names that layouts use for the canonical roles.
ROLES = {"human": "user", "prompter": "user", "instruction": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "completion": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Field paths of a layout and, for each turn, its role and text as SQL, or a list of messages."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None  # list, role field, text field
    by_row: bool = False

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


LAYOUTS = (
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), by_row=True),
    Layout("messages", ("messages", "messages[].role", "messages[].content"), messages=("messages", "role", "content")),
    Layout("from_value", ("conversations", "conversations[].from", "conversations[].value"), messages=("conversations", "from", "value")),
    Layout("instruction_input", ("instruction", "input", "output"), turns=(("user", "concat_ws('\n', instruction, nullif(input, ''))"), ("assistant", "output"))),
    Layout("instruction", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt_completion", ("prompt", "completion"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system_prompt_response", ("system", "prompt", "response"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_response", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", ("question", "answer"), turns=(("user", "question"), ("assistant", "answer"))),
)


def fingerprint(paths: tuple[str, ...] | list[str]) -> str:
    """SHA-256 over the sorted field paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema; ``[]`` steps into a list."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for at in [f"{prefix}.{f.name}" if prefix else f.name] for p in [at, *field_paths(f.dataType, at)]]
    return field_paths(kind.elementType, f"{prefix}[]") if isinstance(kind, T.ArrayType) else []


def layout_of(df: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout:
    """The layout with most paths that has all its paths in the schema."""
    have = set(field_paths(df.schema))
    fitting = [x for x in layouts if have.issuperset(x.paths)]
    if not fitting:
        raise ValueError(f"no mapping for the fields {sorted(have)}")
    return max(fitting, key=lambda x: len(x.paths))


def _role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    low = F.lower(F.trim(role))
    return F.coalesce(F.try_element_at(names, low), role, F.lit(""))


def _mapped(layout: Layout) -> Column:
    if layout.messages:
        items, role, text = layout.messages
        return F.transform(F.col(items), lambda m, i: F.struct(i.cast("long").alias("turn"), _role(m[role].cast("string")).alias("role"), F.coalesce(m[text].cast("string"), F.lit("")).alias("text")))
    return F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.coalesce(F.expr(text).cast("string"), F.lit("")).alias("text")) for k, (role, text) in enumerate(layout.turns)])


def canonical_turns(df: DataFrame, key: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, layout, turns) of a table in any known layout."""
    layout = layout_of(df, layouts)
    if not layout.by_row:
        return df.select(key, F.lit(layout.name).alias("layout"), _mapped(layout).cast(TURNS).alias("turns"))
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return df.groupBy(key).agg(F.lit(layout.name).alias("layout"), F.sort_array(F.collect_list(row)).alias("turns"))


def record_paths(record: Column) -> Column:
    """Sorted nested field paths of a JSON record, null for text that is no JSON.

    They are read off its variant schema: a walk over names and brackets with a stack of prefixes.
    """
    kind = F.schema_of_variant(F.try_parse_json(record))
    tokens = F.regexp_extract_all(kind, F.lit(r"`(?:[^`]|``)*`: |[^\s<>,:`]+: |ARRAY<|OBJECT<|>"), F.lit(0))
    state = "struct<stack:array<string>,at:string,paths:array<string>>"
    start = F.struct(F.array(F.lit("")).alias("stack"), F.lit("").alias("at"), F.array().cast("array<string>").alias("paths")).cast(state)

    def step(s: Column, t: Column) -> Column:
        top = F.element_at(s["stack"], -1)
        name = F.replace(F.trim(F.substring(t, F.lit(1), F.length(t) - 2), F.lit("`")), F.lit("``"), F.lit("`"))
        path = F.concat(F.when(top == "", "").otherwise(F.concat(top, F.lit("."))), name)
        move = lambda stack, at, paths: F.struct(stack.alias("stack"), at.alias("at"), paths.alias("paths")).cast(state)
        deeper = F.concat(s["stack"], F.array(s["at"]))
        return (
            F.when(t == "OBJECT<", move(deeper, s["at"], s["paths"]))
            .when(t == "ARRAY<", move(deeper, F.concat(s["at"], F.lit("[]")), s["paths"]))
            .when(t == ">", move(F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1), s["at"], s["paths"]))
            .otherwise(move(s["stack"], path, F.concat(s["paths"], F.array(path))))
        )

    return F.array_sort(F.aggregate(tokens, start, step)["paths"])


def record_fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a JSON record; types of values do not count."""
    return F.sha2(F.array_join(record_paths(record), "\n"), 256)


def canonical_records(df: DataFrame, key: str = "conv_id", record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(key, fingerprint, layout, turns) of JSON records whose layouts differ from row to row."""
    known = sorted((x for x in layouts if not x.by_row), key=lambda x: -len(x.paths))
    d = df.select(F.col(key).alias("key"), F.col(record).cast("string").alias("record")).withColumn("paths", record_paths(F.col("record")))
    d = d.withColumn("fingerprint", F.sha2(F.array_join("paths", "\n"), 256))
    # each different shape is resolved once
    name = F.lit(None).cast("string")
    for layout in reversed(known):
        name = F.when(F.size(F.array_except(F.array(*map(F.lit, layout.paths)), F.col("paths"))) == 0, layout.name).otherwise(name)
    shapes = d.where("fingerprint is not null").groupBy("fingerprint").agg(F.any_value("paths").alias("paths")).select("fingerprint", name.alias("layout"))
    out = d.select("key", "record", "fingerprint").join(shapes, "fingerprint", "left")
    turns = F.lit(None).cast(TURNS)
    for layout in known:
        hit = F.col("layout") == layout.name
        if layout.messages:
            items, role, text = layout.messages
            fields = {items: F.from_json(F.get_json_object("record", f"$.{items}"), f"array<struct<`{role}`:string,`{text}`:string>>")}
        else:
            fields = {p: F.get_json_object("record", f"$.{p}") for p in layout.paths}
        out = out.withColumns({f"_{layout.name}_{p}": F.when(hit, c) for p, c in fields.items()})
        turns = F.when(hit, _mapped_from(layout, {p: f"_{layout.name}_{p}" for p in fields}).cast(TURNS)).otherwise(turns)
    return out.select(F.col("key").alias(key), "fingerprint", "layout", turns.alias("turns"))


def _mapped_from(layout: Layout, names: dict[str, str]) -> Column:
    """The mapping with its fields read from other columns."""
    if layout.messages:
        items, role, text = layout.messages
        return _mapped(Layout(layout.name, layout.paths, (), (names[items], role, text)))
    known = re.compile(r"\b(" + "|".join(names) + r")\b")
    return _mapped(Layout(layout.name, layout.paths, tuple((role, known.sub(lambda m: f"`{names[m[1]]}`", text)) for role, text in layout.turns)))


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("</turn>", "\\t"), ("###", "\\h"), (":", "\\c"), ("\\", "\\s")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def render(conversations: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conversations`` (with turns) plus ``formatted`` and ``loss_spans``, the code points that are trained on."""
    head = lambda t: F.concat(F.lit("### "), F.replace(escape(t["role"]), F.lit(":"), F.lit("\\c")), F.lit(": "))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*trained).alias("loss")))
    span = "struct(cast(a.at + length(p.head) as bigint) as start, cast(a.at + length(p.head) + length(p.body) as bigint) as stop)"
    walk = f"aggregate(pieces, struct(0L as at, cast(array() as array<struct<start:bigint,stop:bigint>>) as spans), (a, p) -> struct(cast(a.at + length(p.head) + length(p.body) + 8 as bigint) as at, case when p.loss then concat(a.spans, array({span})) else a.spans end as spans)).spans"
    out = conversations.withColumn("pieces", pieces)
    out = out.withColumn("formatted", F.concat_ws("", F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("</turn>\n")))))
    return out.withColumn("loss_spans", F.expr(walk)).drop("pieces")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, unescaped."""
    parts = F.filter(F.split(formatted, "\\Q</turn>\\E\\n"), lambda x: x != "")
    cut = lambda x: F.instr(x, ": ")
    return F.transform(parts, lambda x: F.struct(unescape(F.substring(x, F.lit(5), cut(x) - 5)).alias("role"), unescape(F.substring(x, cut(x) + 2, F.length(x))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, in order."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))))
