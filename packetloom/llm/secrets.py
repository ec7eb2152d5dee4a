"""Secret scan with linking of credential parts, in SQL functions only.

Strong parts are reported wherever they stand: assignments to secret-like names, access identifiers and long hex
runs.  Weak parts (account names, mixed-case random-looking words, service addresses) are too common alone; each is
reported only when the parts that complete it stand near by, found by an interval join of the parts of a text:

* an account name needs a secret,
* a random-looking word needs an identifier or an address, also one that it is part of,
* an address needs an identifier and a secret, also such as are part of it.

Otherwise parts that overlap do not complete each other: one word is not evidence for itself.

Positions are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.words import row_key

# Parts whose gap is at most this many code points complete each other.
SCOPE = 240


@dataclass(frozen=True)
class Part:
    """A kind of part: matches of ``pattern`` (leftmost, not overlapping) of which group ``value`` passes ``keep``.

    ``hint`` is a cheaper pattern found in every text with a match.  ``role`` is what it gives a credential.
    """

    kind: str
    role: str
    pattern: str
    hint: str
    strong: bool
    value: int = 0
    keep: Callable[[Column], Column] = lambda value: F.lit(True)


_QUOTE = "[\"']?"
PARTS = [
    Part(
        "assign",
        "secret",
        rf"(?i)(password|passwd|secret|token|api_?key){_QUOTE}\x20*[:=]\x20*{_QUOTE}([A-Za-z0-9+/_.=-]+)",
        r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]",
        True,
        2,
        lambda value: F.length(value) >= 6,
    ),
    # Runs are taken whole, so a least length inside the pattern drops the same matches as a check afterwards.
    Part("access", "identifier", r"AKIA[A-Z0-9]{16,}", "AKIA", True),
    Part("hex", "secret", r"[0-9a-f]{24,}", r"[0-9a-f]{24}", True),
    Part(
        "account",
        "identifier",
        rf"(?i)\b(?:user(?:_?name|_?id)?|login|account|client_?id|(?:access_)?key_?id){_QUOTE}\x20*[:=]\x20*{_QUOTE}([A-Za-z0-9@._+-]+)",
        r"(?i)(user|login|account|id|name)[\"']?\x20*[:=]",
        False,
        1,
        lambda value: F.length(value) >= 3,
    ),
    Part(
        "random",
        "secret",
        r"[A-Za-z0-9+/_-]{20,}={0,2}",
        r"[A-Za-z0-9+/_-]{20}",
        False,
        0,
        lambda value: value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]"),
    ),
    Part(
        "address",
        "address",
        r"(?:https?|ftp|s3|jdbc:\w+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20\"'<>]+",
        "://",
        False,
    ),
]
_RANK = {p.kind: i for i, p in enumerate(PARTS)}


_CELLS = "array<struct<kind:string,gap:int,size:int,ok:boolean>>"


def _cells(body: Column, part: Part) -> Column:
    """For each match, in order: the length of the text before it, its own length, and whether it is kept."""
    pattern = F.lit(part.pattern)
    matches = F.regexp_extract_all(body, pattern, F.lit(0))
    values = F.regexp_extract_all(body, pattern, F.lit(part.value)) if part.value else matches
    gaps = F.transform(F.split(body, part.pattern, -1), lambda x: F.length(x))
    zipped = F.arrays_zip(gaps, F.transform(matches, lambda x: F.length(x)), F.transform(values, part.keep))
    # The piece after the last match has no size and is not kept.
    return F.transform(zipped.cast("array<struct<gap:int,size:int,ok:boolean>>"), lambda c: F.struct(F.lit(part.kind).alias("kind"), c["gap"].alias("gap"), c["size"].alias("size"), c["ok"].alias("ok")))


def parts(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """All matches: key, kind, role, strong, start, end.

    A text is split at its matches; running sums over the lengths of pieces and matches give the positions.  Only
    texts with a match are shuffled, and of them only lengths.
    """
    body = F.coalesce(df[text], F.lit(""))
    found = [F.when(body.rlike(p.hint), _cells(body, p)).otherwise(F.array().cast(_CELLS)) for p in PARTS]
    rows = df.select(row_key(df[id_column], df[text]).alias("key"), F.concat(*found).alias("cells"))
    # Equal rows fold into one before positions are summed.
    rows = rows.where(F.size("cells") > 0).groupBy("key").agg(F.first("cells").alias("cells"))
    rows = rows.select("key", F.posexplode("cells").alias("i", "c")).select("key", "i", "c.*")
    upto = Window.partitionBy("key", "kind").orderBy("i")
    size = F.coalesce("size", F.lit(0))
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(upto).cast("int"))
    rows = rows.where("ok").select("key", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    roles = F.create_map(*[F.lit(x) for p in PARTS for x in (p.kind, p.role)])
    return rows.withColumn("role", roles[F.col("kind")]).withColumn(
        "strong", F.col("kind").isin([p.kind for p in PARTS if p.strong])
    )


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The strong parts, and the weak ones whose complements stand within ``scope``.

    The interval join meets parts of a text by cells of ``scope`` code points: a part is listed in its cell, a weak
    one asks its own and the neighbouring cells.  Parts do not overlap within a kind, so a cell holds a bounded
    number of them, whatever the length of the text.  Overlapping parts complete each other (with no gap) if one of
    them is an address.
    """
    wide = F.greatest(F.lit(scope), F.lit(1))
    cells = lambda a, b: F.sequence(F.floor(a / wide), F.floor(b / wide))
    asks = found.where(~F.col("strong")).select(
        "key",
        F.col("kind").alias("a_kind"),
        F.col("start").alias("a"),
        F.col("end").alias("b"),
        F.explode(cells(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope)).alias("cell"),
    )
    # A long part is found by its ends: what is near it is near one of them.  What an address holds can be anywhere in it.
    ends = F.array_distinct(F.array(F.floor(F.col("start") / wide), F.floor((F.col("end") - 1) / wide)))
    through = cells(F.col("start"), F.col("end") - 1)
    gives = found.select(
        "key", "role", "kind", "start", "end", F.explode(F.when(F.col("role") == "address", through).otherwise(ends)).alias("cell")
    )
    apart = (F.col("start") >= F.col("b")) | (F.col("end") <= F.col("a"))
    inside = (F.col("kind") != F.col("a_kind")) & ((F.col("role") == "address") | (F.col("a_kind") == "address"))
    close = (F.col("start") - F.col("b") <= scope) & (F.col("a") - F.col("end") <= scope)
    near = asks.join(gives, ["key", "cell"]).where(close & (apart | inside))
    has = lambda role: F.max(F.when(F.col("role") == role, 1).otherwise(0)) == 1
    seen = near.groupBy("key", "a_kind", "a", "b").agg(
        has("identifier").alias("i"), has("secret").alias("s"), has("address").alias("e")
    )
    complete = (
        ((F.col("a_kind") == "account") & F.col("s"))
        | ((F.col("a_kind") == "random") & (F.col("i") | F.col("e")))
        | ((F.col("a_kind") == "address") & F.col("i") & F.col("s"))
    )
    weak = seen.where(complete).select("key", F.col("a_kind").alias("kind"), F.col("a").alias("start"), F.col("b").alias("end"))
    strong = found.where("strong").select("key", "kind", "start", "end")
    return strong.unionByName(weak)


def scan(df: DataFrame, id_column: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), scope: int = SCOPE) -> DataFrame:
    """Every row's id (and the columns in ``keep``) with ``spans``: (start, end, kind) by start, then kind as listed.

    Null and empty texts have none.  Repeated rows each get their spans; a null id is an id like others.
    """
    rank = F.create_map(*[F.lit(x) for pair in _RANK.items() for x in pair])
    per_text = (
        link(parts(df, id_column, text), scope)
        .groupBy("key")
        .agg(F.array_sort(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "end", "kind"))).alias("spans"))
    )
    rows = df.select(
        df[id_column].alias("__id"),
        F.struct(*[df[c] for c in keep] or [F.lit(0).alias("none")]).alias("__kept"),
        row_key(df[id_column], df[text]).alias("key"),
    )
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    out = rows.join(per_text, "key", "left")
    return out.select(
        F.col("__id").alias(id_column), *[F.col("__kept")[c].alias(c) for c in keep], F.coalesce(spans, none).alias("spans")
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span (overlapping ones together) replaced by the mark; pieces are joined once."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"),
        F.when(x["start"] < s["at"], s["out"])
        .otherwise(F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit(mark))))
        .alias("out"),
    )
    done = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, done)).otherwise(text)


def redact_rows(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows and columns (whatever their names), every found span of the text replaced by a mark.

    Only texts in which some kind of part may match are shuffled to meet their spans.  Null and empty texts stay as they
    are, repeated rows are treated alike, an empty table stays empty.
    """
    maybe = F.lit(False)
    for p in PARTS:
        maybe = maybe | F.coalesce(df[text].rlike(p.hint), F.lit(False))
    rows = df.where(maybe).select(df[id_column].alias("__doc"), df[text].alias("__text"), F.struct(*[df[c] for c in df.columns]).alias("__row"))
    found = scan(rows, "__doc", "__text", keep=("__row",))
    row = F.col("__row")
    clean = redact(row[text], F.col("spans"))
    done = found.select(*[(clean if c == text else row[c]).alias(c) for c in df.columns])
    return df.where(~maybe).unionByName(done)
