"""Chat formatting: schema fingerprints select mappings (native).

A layout of conversations is told by its schema: the nested field paths,
sorted, are hashed, and the hash selects a declarative mapping that says where
the turns are.  Three kinds of layouts end up as canonical turns (an array of
struct<role, text>): message lists, prompt and answer fields, and one row for
each turn.  Semi-structured rows (JSON) are told row by row by the paths of
their own variant schema, so that one table may mix layouts.

The template writes every turn as

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Inside roles and texts the characters that any control string begins with are
escaped as entities (& as &amp;, < as &lt;, [ as &#91;, in roles also \\n as
&#10;), so no text can open or close a turn, and unescaping gives every text
back.  The loss mask is an array of [start, end) spans in code points of the
formatted string which cover the escaped assistant texts.

Roles are kept as they are written; only a layout whose mapping names its own roles
(senders human and gpt) has them translated.

Edge cases: null texts count as empty, null roles as the empty role; turns that
tie are ordered by role and text; repeated rows are turns each; rows whose
conversation id is null form one conversation; a layout without a mapping is
an error that names its paths; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import sums_before

TURNS = "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&#10;"))


def paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a type; [] stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(field_paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """One layout.  turns: (role, path) pairs for prompt and answer fields; or
    messages: (array, role field, text field); or rows: (order, role, text).
    roles: what the layout calls roles, where these are other names."""

    field_paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None
    rows: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()


#: Names of roles in layouts of senders (from) and values.
SENDERS = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


#: Layouts that public instruction sets use.
MAPPINGS = (
    Mapping(("prompt", "completion"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Mapping(("question", "answer"), turns=(("user", "question"), ("assistant", "answer"))),
    Mapping(("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Mapping(("instruction", "input", "output"), turns=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping(("system", "prompt", "response"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping(("messages[].role", "messages[].content"), messages=("messages", "role", "content")),
    Mapping(("conversations[].from", "conversations[].value"), messages=("conversations", "from", "value"), roles=SENDERS),
    Mapping(("turn", "role", "text"), rows=("turn", "role", "text")),
)
REGISTRY = {fingerprint(list(m.field_paths)): m for m in MAPPINGS}


def select_mapping(schema: T.StructType, ids: list[str]) -> Mapping:
    """The mapping of a schema's fingerprint; where columns that no mapping knows stand beside
    a layout, that of the fingerprint without them (of several, the one with the most fields)."""
    found = paths(T.StructType([f for f in schema.fields if f.name not in ids]))
    for known in ({p for p in found if any(p in m.field_paths for m in MAPPINGS)}, *sorted((set(m.field_paths) for m in MAPPINGS), key=len, reverse=True)):
        if known <= set(found) and (mapping := REGISTRY.get(fingerprint(list(known)))):
            return mapping
    raise ValueError(f"no mapping for a layout with the fields {found}")


def _role(role: Column, names: tuple[tuple[str, str], ...] = ()) -> Column:
    role = out = F.coalesce(role, F.lit(""))
    for old, new in names:
        out = F.when(role == old, new).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _from_messages(messages: Column, mapping: Mapping) -> Column:
    _, role, text = mapping.messages
    return F.transform(messages, lambda m: _turn(_role(m[role], mapping.roles), m[text]))


def canonical(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """conv_id and turns of every conversation of a table in any known layout."""
    mapping = select_mapping(df.schema, [conv_id])
    if mapping.rows:
        order, role, text = mapping.rows
        entry = F.struct(
            F.col(order).alias("o"), _role(F.col(role), mapping.roles).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
        )
        grouped = df.groupBy(conv_id).agg(F.sort_array(F.collect_list(entry)).alias("turns"))
        return grouped.select(conv_id, F.transform("turns", lambda t: _turn(t["role"], t["text"])).alias("turns"))
    if mapping.messages:
        return df.select(conv_id, F.coalesce(_from_messages(F.col(mapping.messages[0]), mapping), F.array().cast(TURNS)).alias("turns"))
    turns = F.array(*[_turn(F.lit(role), F.col(path)) for role, path in mapping.turns])
    return df.select(conv_id, turns.alias("turns"))


def _layout(v: Column) -> Column:
    """The field paths of a JSON row as far as mappings know them, in order: name, or name[].part for arrays of objects.

    Fields that no mapping knows and further fields of messages don't take part; an empty array stands for any messages."""
    names = sorted({p for m in MAPPINGS if not m.rows for p in m.field_paths})
    seen = []
    for path in names:
        array, _, part = path.partition("[].")
        if part:
            items = F.try_variant_get(v, f"$.{array}", "array<variant>")
            has = F.coalesce(F.forall(items, lambda x: F.try_variant_get(x, f"$.{part}", "variant").isNotNull()), F.lit(False))  # noqa: B023
        else:
            has = F.try_variant_get(v, f"$.{path}", "variant").isNotNull()
        seen.append(F.when(has, F.lit(path)))
    return F.array_compact(F.array(*seen))


def layouts(df: DataFrame, column: str) -> DataFrame:
    """df with layout: the fingerprint of the mapping that a JSON row selects; null for rows that no mapping fits.

    Of the mappings whose fields a row has, that with the most fields is taken, as select_mapping() does for a table."""
    known = sorted((m for m in MAPPINGS if not m.rows), key=lambda m: -len(m.field_paths))
    there = F.col("_layout")
    chosen = F.coalesce(*[F.when(F.forall(F.array(*map(F.lit, m.field_paths)), lambda p: F.array_contains(there, p)), F.lit(fingerprint(list(m.field_paths)))) for m in known])
    seen = df.withColumn("_layout", _layout(F.try_parse_json(F.col(column))))
    return seen.withColumn("layout", chosen).drop("_layout")


def canonical_json(df: DataFrame, column: str, conv_id: str = "conv_id") -> DataFrame:
    """conv_id, turns and layout of JSON rows whose layouts differ: the paths of each row's own fields select its mapping.

    Fields that no mapping knows are ignored; null texts and roles are empty ones; a layout of messages without any is a
    conversation without turns.  Rows that no mapping fits keep null turns and a null layout, for unmatched() to count."""
    seen = layouts(df.select(conv_id, column), column)
    v = F.try_parse_json(F.col(column))
    turns = F.lit(None).cast(TURNS)
    for m in MAPPINGS:
        if m.rows:
            continue
        if m.messages:
            array, role, text = m.messages
            items = F.try_variant_get(v, f"$.{array}", "array<variant>")
            names = m.roles
            said = lambda x, part: F.try_variant_get(x, f"$.{part}", "string")
            got = F.transform(items, lambda x: _turn(_role(said(x, role), names), said(x, text)))  # noqa: B023
        else:
            got = F.array(*[_turn(F.lit(r), F.try_variant_get(v, f"$.{p}", "string")) for r, p in m.turns])
        turns = F.when(F.col("layout") == fingerprint(list(m.field_paths)), got).otherwise(turns)
    return seen.select(conv_id, turns.alias("turns"), "layout")


def unmatched(canonical_rows: DataFrame) -> DataFrame:
    """How many rows of canonical_json() no mapping fits, and how many there are: rows, unmatched."""
    return canonical_rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("turns").isNull()).alias("unmatched"))


def _escape(text: Column, escapes=ESCAPES) -> Column:
    for plain, entity in escapes:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def _unescape(text: Column, escapes=ESCAPES) -> Column:
    for plain, entity in reversed(escapes):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def formatted(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """conv_id, formatted string and loss_spans array<struct<start, end>>."""
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), _escape(t["role"], ROLE_ESCAPES), F.lit("\n")).alias("head"),
            _escape(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("loss"),
        ),
    )
    df = turns.select(conv_id, pieces.alias("_pieces"))
    size = lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(END)).cast("long")
    df = df.select(conv_id, "_pieces", F.transform("_pieces", size).alias("_sizes"))
    df = df.select(conv_id, "_pieces", sums_before(F.col("_sizes")).alias("_at"))

    def span(p, at):
        start = (at + F.length(p["head"])).cast("int")
        return F.when(p["loss"], F.struct(start.alias("start"), (start + F.length(p["body"])).alias("end")))

    return df.select(
        conv_id,
        F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
        F.filter(F.zip_with("_pieces", "_at", span), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parsed(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Reads formatted strings back: conv_id, turns, loss_text (the unescaped text
    under the mask), formatted_chars."""
    blocks = F.slice(F.split("formatted", r"<\|im_end\|>\n"), 1, F.size(F.split("formatted", r"<\|im_end\|>\n")) - 1)
    df = df.select(conv_id, "formatted", "loss_spans", blocks.alias("_blocks"))

    def turn(block):
        body = F.substring(block, len(START) + 1, F.length(block))
        role = F.substring_index(body, "\n", 1)
        text = F.substring(body, F.length(role) + 2, F.length(body))
        return F.struct(_unescape(role, ROLE_ESCAPES).alias("role"), _unescape(text).alias("text"))

    masked = F.transform("loss_spans", lambda s: _unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return df.select(
        conv_id,
        F.transform("_blocks", turn).alias("turns"),
        F.array_join(masked, "").alias("loss_text"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
