"""Chat formatting: any known record layout becomes turns, turns become one marked text with a loss mask.

The layout of a record is its nested field names.  Their hash picks a mapping from a table of declarations, so a new
layout is a new row of that table, not new code.  Typed tables are fingerprinted from their schema, JSON records one
by one inside Spark.  Everything is SQL functions.

Formatted text: ``### role: text</turn>`` and a newline per turn, where backslash, ``#``, ``:`` (in roles) and the
``<`` of ``</turn>`` inside role or text are written with a backslash.  No unescaped marker can come from a text, and
dropping the backslashes gives every text back.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "</turn>"
TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns.

    ``shape`` is the layout written as nested field names, sorted by name: ``{a,b:[{c,d}]}``.  ``turns`` is SQL for
    an array of (role, text) over the record ``r``.  ``by`` and ``order`` say how to gather rows that hold one turn
    each; ``turns`` then speaks of the array ``rows`` of such records.
    """

    name: str
    shape: str
    turns: str
    by: str | None = None
    order: str | None = None

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.shape.encode()).hexdigest()


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', {text})"


def _list(items: str, role: str, text: str) -> str:
    return f"transform({items}, m -> {_turn(f'm.{role}', f'm.{text}')})"


_SPEAKER = "case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end"

MAPPINGS = [
    Mapping("turn rows", "{conv_id,role,text,turn}", _list("rows", "role", "text"), "conv_id", "turn"),
    Mapping("messages", "{messages:[{content,role}]}", _list("r.messages", "role", "content")),
    Mapping(
        "speakers", "{conversations:[{from,value}]}", f"transform(r.conversations, m -> {_turn(_SPEAKER, 'm.value')})"
    ),
    Mapping(
        "prompt and completion",
        "{completion,prompt}",
        f"array({_turn("'user'", 'r.prompt')}, {_turn("'assistant'", 'r.completion')})",
    ),
    Mapping(
        "prompt and response",
        "{prompt,response}",
        f"array({_turn("'user'", 'r.prompt')}, {_turn("'assistant'", 'r.response')})",
    ),
    Mapping(
        "instruction",
        "{input,instruction,output}",
        "array("
        + _turn("'user'", "concat_ws('\\n\\n', r.instruction, nullif(r.input, ''))")
        + f", {_turn("'assistant'", 'r.output')})",
    ),
    Mapping(
        "question and answer with system",
        "{question,response,system_prompt}",
        "filter(array("
        + f"{_turn("'system'", 'r.system_prompt')}, {_turn("'user'", 'r.question')}, "
        + f"{_turn("'assistant'", 'r.response')}), m -> m.role <> 'system' or coalesce(m.text, '') <> '')",
    ),
]


def shape_of(kind: T.DataType) -> str:
    """The nested field names of a type; leaves have none."""
    if isinstance(kind, T.StructType):
        fields = (f.name + (f":{inner}" if (inner := shape_of(f.dataType)) else "") for f in kind.fields)
        return "{" + ",".join(sorted(fields)) + "}"
    if isinstance(kind, T.ArrayType):
        return f"[{inner}]" if (inner := shape_of(kind.elementType)) else ""
    return ""


def json_shape(record: Column) -> Column:
    """The same for each JSON text of a column; null where the text is not JSON.

    Spark names the type of a parsed record with its fields sorted; what remains is to drop the leaf types.
    """
    kind = F.schema_of_variant(F.try_parse_json(record))
    shape = F.regexp_replace(kind, r"(?<=: )(?!OBJECT<|ARRAY<)[A-Z]+(\(\d+, *\d+\))?", "")
    shape = F.regexp_replace(shape, r"ARRAY<(?!OBJECT<|ARRAY<)[A-Z]+(\(\d+, *\d+\))?>", "")
    for _ in range(8):  # closes the innermost brackets first; deeper layouts match no mapping
        shape = F.regexp_replace(shape, r"OBJECT<([^<>]*)>", "{$1}")
        shape = F.regexp_replace(shape, r"ARRAY<([^<>]*)>", "[$1]")
    return F.regexp_replace(F.regexp_replace(shape, r": (?=[,}]|$)", ""), r"([:,]) ", "$1")


def _json_type(shape: str) -> str:
    """A Spark type for a shape, all leaves text."""
    out = re.sub(r"([A-Za-z_]+)(?=[,}])", r"`\1`: string", shape)
    out = re.sub(r"([A-Za-z_]+):(?=[\[{])", r"`\1`: ", out)
    return out.replace("{", "struct<").replace("}", ">").replace("[", "array<").replace("]", ">")


def turns_from_json(df: DataFrame, record: str, mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """Adds ``fingerprint``, ``layout`` and ``turns`` to rows with a JSON record.

    Null, broken or unknown records keep their row, with null layout and turns, for the caller to look into; null
    texts and roles become empty.  Columns with these names in the input are replaced.
    """
    known = [m for m in mappings if m.by is None]
    out = df.withColumn("fingerprint", F.sha2(json_shape(F.col(record)).cast("binary"), 256))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for i, m in enumerate(known):
        is_m = F.col("fingerprint") == m.fingerprint
        out = out.withColumn(f"__r{i}", F.from_json(F.when(is_m, F.col(record)), _json_type(m.shape)))
        layout = F.when(is_m, F.lit(m.name)).otherwise(layout)
        turns = F.when(is_m, F.expr(re.sub(r"\br\.", f"__r{i}.", m.turns)).cast(TURNS)).otherwise(turns)
    out = out.withColumn("layout", layout).withColumn("turns", clean_turns(turns))
    return out.drop(*(f"__r{i}" for i in range(len(known))))


def clean_turns(turns: Column) -> Column:
    return F.transform(
        turns,
        lambda m: F.struct(
            F.coalesce(m["role"], F.lit("")).alias("role"), F.coalesce(m["text"], F.lit("")).alias("text")
        ),
    )


def turns_from_table(df: DataFrame, mappings: list[Mapping] = MAPPINGS) -> DataFrame:
    """Turns of a typed table whose schema has a known fingerprint; further columns are left out before the look-up.

    A mapping that gathers rows groups them by its key in its order (ties by role, then text; nulls first; a null key
    is a record of its own).  Gives the key, ``layout`` and ``turns``; record layouts keep all columns.
    """
    for m in mappings:
        wanted = re.findall(r"[A-Za-z_]+(?=[,:}])", re.sub(r":\[.*?\](?=[,}])|:\{.*?\}(?=[,}])", "", m.shape[1:]))
        if not set(wanted) <= set(df.columns):
            continue
        found = df.select(*sorted(wanted))
        if hashlib.sha256(shape_of(found.schema).encode()).hexdigest() != m.fingerprint:
            continue
        if m.by is None:
            record = F.struct(*[F.col(c) for c in sorted(wanted)])
            out = df.drop("turns", "layout").withColumn("__r", record)
            turns = F.expr(re.sub(r"\br\.", "__r.", m.turns))
            return out.withColumn("turns", clean_turns(turns)).withColumn("layout", F.lit(m.name)).drop("__r")
        rest = [c for c in sorted(wanted) if c not in (m.by, m.order)]
        rows = F.array_sort(F.collect_list(F.struct(m.order, *rest))).alias("rows")
        grouped = found.groupBy(m.by).agg(rows)
        return grouped.select(m.by, F.lit(m.name).alias("layout"), clean_turns(F.expr(m.turns)).alias("turns"))
    raise ValueError(f"no mapping for the layout {shape_of(df.schema)}")


def escape(text: Column, role: bool = False) -> Column:
    """Reversible: after it, every marker inside is broken up by a backslash."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#"))
    out = F.replace(out, F.lit(END), F.lit("<\\" + END[1:]))
    return F.replace(out, F.lit(":"), F.lit("\\:")) if role else out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(df: DataFrame, turns: str = "turns", trained_role: str = "assistant") -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``: code point ranges [start, end) of the trained role's texts, unmarked.

    A record without turns gives an empty text and no spans.
    """
    heads = F.transform(
        F.coalesce(F.col(turns), F.array().cast(TURNS)),
        lambda m: F.struct(
            F.concat(F.lit("### "), escape(m["role"], True), F.lit(": ")).alias("head"),
            escape(m["text"]).alias("body"),
            (m["role"] == trained_role).alias("trained"),
        ),
    )
    out = df.withColumn("__parts", heads)
    tail = f"{END}\n"
    out = out.withColumn(
        "formatted",
        F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), ""),
    )
    # Where each turn begins: a running sum over the parts, in one pass.
    spans = F.aggregate(
        "__parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"]) + len(tail)).alias("at"),
            F.when(
                p["trained"],
                F.concat(
                    s["spans"],
                    F.array(
                        F.struct(
                            (s["at"] + F.length(p["head"])).alias("start"),
                            (s["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end"),
                        )
                    ),
                ),
            )
            .otherwise(s["spans"])
            .alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return out.withColumn("loss_spans", spans).drop("__parts")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, read back."""
    pieces = F.filter(F.split(formatted, f"{END}\n", -1), lambda p: p != "")
    head = r"(?s)^### ((?:[^\\:]|\\.)*+): (.*)$"
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_extract(p, head, 2)).alias("text")
        ),
    )


def read_masked(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped, as trained on."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), ""
    )
