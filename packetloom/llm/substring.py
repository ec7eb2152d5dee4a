"""Passages that earlier documents hold too: exact windows of words, found behind a count-min sketch.

Every window of ``window`` words has an anchor, the least hash among its runs of half as many words; equal windows have
equal anchors and neighbouring windows mostly share theirs, so there are some 13 times fewer anchors than windows of 50.
Each task counts the distinct anchors of its texts in a count-min sketch; the sketches are summed cell by cell.  A
cell's count is never below the number of texts that hold a window with this anchor, so what it estimates to be in one
text only is in no other, and nothing is lost by leaving it out.

The second pass groups exactly: first the anchors that the sketch takes for repeated, then, by 128-bit hashes of all
their words, the windows of anchors that really are.  A full sketch (the corpus is larger than its bound) therefore
costs one row for each anchor, not for each window.

Equal texts are reduced to the one with the least id before all this: the others are removed as a whole.

Odd rows: a null text has no words; texts shorter than the window are kept; a row with a null id removes nothing
from others and is kept whole; rows that share an id do not remove each other's words; repeated rows give equal
results; an empty table gives no rows.  Words are runs of characters other than blank, tab and the line breaks of ASCII.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm import words as W
from packetloom.session import materialize, run_dir

WINDOW = 50
# Rows of counters; counters of a row (powers of two): four for each anchor, as far as the bound goes (64 MB of flags).
DEPTH, LEAST_BITS, MOST_BITS = 2, 16, 28
_SEEDS = np.array([0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179], np.uint64)
_BASES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
# Words are hashed in stretches of at most this many bytes, a longer word on its own.
_STRETCH = 1 << 19
_ROWS = 1 << 16

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int) -> np.ndarray:
    out = np.full(_STRETCH + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = [(_powers(int(b)), _powers(pow(int(b), -1, 1 << 64))) for b in _BASES]


@dataclass
class Tokens:
    """Words of some texts in order; ``first[i]:first[i + 1]`` are those of text i, two hashes each."""

    hashes: tuple[np.ndarray, np.ndarray]
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    raw: np.ndarray
    bounds: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    texts = texts.cast(pa.large_string()).fill_null("")
    none = np.zeros(0, np.int64)
    if len(texts) == 0:
        return Tokens((none.astype(np.uint64),) * 2, none, none, np.zeros(1, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64))
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    inside = ~_BLANK[raw]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    heads = bounds[:-1][bounds[:-1] < len(raw)]
    opens[heads] = inside[heads]
    tails = bounds[1:][bounds[1:] > 0] - 1
    closes[tails] = inside[tails]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    hashes = tuple(np.empty(len(starts), np.uint64) for _ in _BASES)
    k = 0
    while k < len(starts):
        stop = int(np.searchsorted(ends, starts[k] + _STRETCH, "right"))
        if stop <= k:
            whole = hashlib.blake2b(raw[starts[k] : ends[k]].tobytes(), digest_size=16).digest()
            for out, half in zip(hashes, (whole[:8], whole[8:])):
                out[k] = int.from_bytes(half, "little")
            k += 1
            continue
        low = starts[k]
        stretch = raw[low : ends[stop - 1]].astype(np.uint64) + np.uint64(1)
        a, b = starts[k:stop] - low, ends[k:stop] - low
        for out, (up, down) in zip(hashes, _POWERS):
            sums = np.zeros(len(stretch) + 1, np.uint64)
            np.cumsum(stretch * up[: len(stretch)], out=sums[1:])
            out[k:stop] = (sums[b] - sums[a]) * down[a]
        k = stop
    return Tokens(tuple(map(W.mix, hashes)), starts, ends, np.searchsorted(starts, bounds), raw, bounds)


def _runs(hashes: np.ndarray, base: np.uint64, size: int) -> np.ndarray:
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * base + hashes[j : j + n]
    return W.mix(out)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


@dataclass
class Windows:
    """Windows of some texts: their text, first word, and anchor."""

    text: np.ndarray
    start: np.ndarray
    anchor: np.ndarray
    of: Tokens
    window: int

    def keys(self, chosen: np.ndarray) -> list[np.ndarray]:
        """Two hashes of all words of the chosen windows."""
        half, at = self.window // 2, self.start[chosen]
        rest = self.window - 2 * half
        out = []
        for hashes, base in zip(self.of.hashes, _BASES):
            runs = _runs(hashes, base, half)
            key = runs[at] * base + runs[at + half]
            out.append(W.mix(key * base + hashes[at + 2 * half] if rest else key))
        return out


def windows(texts: pa.Array, window: int = WINDOW) -> Windows:
    found = tokens(texts)
    half = window // 2
    n = len(found.starts) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return Windows(none, none, none.astype(np.uint64), found, window)
    text = np.repeat(np.arange(len(texts)), np.diff(found.first))
    anchor = _least(_runs(found.hashes[0], _BASES[0], half), window - half + 1)
    start = np.flatnonzero(text[:n] == text[window - 1 :])
    return Windows(text[start], start, anchor[start], found, window)


def _cells(anchors: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (W.mix(anchors ^ _SEEDS[row]) >> np.uint64(64 - bits)).astype(np.int64)


def _anchors(found: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(text, anchor): the distinct anchors of each text."""
    new = np.ones(len(found.anchor), bool)
    new[1:] = (found.anchor[1:] != found.anchor[:-1]) | (found.text[1:] != found.text[:-1])
    text, anchor = found.text[new], found.anchor[new]
    order = np.lexsort((anchor, text))
    text, anchor = text[order], anchor[order]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    return text[new], anchor[new]


def _batches(columns: dict[str, np.ndarray | pa.Array]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_pydict({k: pa.array(v.view(np.int64)) if isinstance(v, np.ndarray) and v.dtype == np.uint64 else v for k, v in columns.items()})
    for begin in range(0, whole.num_rows, _ROWS):
        yield whole.slice(begin, _ROWS)


def sketch(texts: DataFrame, bits: int, window: int = WINDOW) -> np.ndarray:
    """Whether each counter of each row stands for two texts or more (packed bits, at most 2 x 32 MB on the driver)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, "text"):
            _, anchors = _anchors(windows(batch.column(0), window))
            cells = np.concatenate([_cells(anchors, row, bits) + (row << bits) for row in range(DEPTH)])
            cell, n = np.unique(cells, return_counts=True)
            yield from _batches({"cell": cell, "n": n.astype(np.int64)})

    counts = texts.select("text").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    # 64 flags in each long: what comes to the driver has a fixed bound.
    word = F.call_function("div", F.col("cell"), F.lit(64))
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cell") % 64).cast("int"))
    flags = counts.where("n > 1").groupBy(word.alias("word")).agg(F.bit_or(flag).alias("flags")).toArrow()
    out = np.zeros(DEPTH << bits >> 6, np.int64)
    out[flags.column("word").to_numpy()] = flags.column("flags").to_numpy()
    return out


def _repeated(flags: np.ndarray, anchors: np.ndarray, bits: int) -> np.ndarray:
    """Whether the least of an anchor's counters stands for two texts or more."""
    out = np.ones(len(anchors), bool)
    for row in range(DEPTH):
        cell = _cells(anchors, row, bits) + (row << bits)
        out &= (flags[cell >> 6] >> (cell & 63)) & 1 == 1
    return out


def _bucketed(df: DataFrame, column: str) -> DataFrame:
    """``df`` as a table of buckets by ``column``: later joins on it leave its rows where they are."""
    spark = df.sparkSession
    name = f"packetloom_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(parts, column).option("path", f"{run_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # the files stay, the catalog is left as it was
    return table


def remove_repeats(df: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """All rows and columns; of ``text`` stay the words that no window repeating a smaller id's covers, joined by blanks.

    Adds (or replaces) n_words and n_removed.
    """
    return spread(df, kept_by_text(df, id_column, text, window), id_column, text, window)


def kept_by_text(df: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """For each distinct text and the least id that has it: key, first, kept, whole, n_words, n_removed.

    ``kept`` are the words that stay in the row of that id, ``whole`` is all words, where rows with a null id need them.
    ``spread`` gives every row of ``df`` what is its own; what only needs a digest of the words can take it in between.
    """
    spark = df.sparkSession
    ident, key = _row_parts(id_column, text)
    rows = df.select(key.alias("key"), ident.alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    least = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "text")).alias("r")
    distinct = rows.groupBy("key").agg(least, F.max(F.col("id").isNull()).alias("unnamed"))
    texts = _bucketed(distinct.select("key", "r.id", "r.text", "unnamed"), "key")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, int(size // 20).bit_length()))
    named = texts.where("id is not null").select("key", "id", "text")
    shared = spark.sparkContext.broadcast(sketch(named, bits, window))  # 64 MB at most, see MOST_BITS

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, "text"):
            at, anchors = _anchors(windows(batch.column(2), window))
            kept = _repeated(shared.value, anchors, bits)
            at = pa.array(at[kept])
            yield from _batches({"key": batch.column(0).take(at), "id": batch.column(1).take(at), "anchor": anchors[kept]})

    guessed = materialize(named.mapInArrow(guess, "key string, id long, anchor long"), "anchors-guessed")
    real = guessed.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    real = materialize(real.select("anchor"), "anchors-repeated")
    listed = guessed.join(real, "anchor").groupBy("key").agg(F.collect_set("anchor").alias("anchors"))  # of one text

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, "text"):
            found = windows(batch.column(2), window)
            wanted = batch.column(3)
            of = np.repeat(np.arange(batch.num_rows), np.asarray(wanted.value_lengths().fill_null(0)))
            # Anchors of one text only count for windows of this text.
            pairs = W.mix(wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64)) ^ W.mix(of.astype(np.uint64) + np.uint64(1))
            asked = W.mix(found.anchor) ^ W.mix(found.text.astype(np.uint64) + np.uint64(1))
            chosen = np.flatnonzero(np.isin(asked, pairs))
            a, b = found.keys(chosen)
            at, start = found.text[chosen], found.start[chosen]
            place = (start - found.of.first[at]).astype(np.int32)
            at = pa.array(at)
            yield from _batches({"key": batch.column(0).take(at), "id": batch.column(1).take(at), "a": a, "b": b, "place": place})

    marked = named.join(listed, "key").select("key", "id", "text", "anchors")
    each = materialize(marked.mapInArrow(cover, "key string, id long, a long, b long, place int"), "windows")
    firsts = each.groupBy("a", "b").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    firsts = materialize(firsts.select("a", "b", "low"), "windows-repeated")
    later = each.join(firsts, ["a", "b"]).where("low < id")
    removed = later.groupBy("key").agg(F.array_sort(F.collect_list("place")).alias("places"))  # of one text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, "text"):
            kept, n_words, n_removed = kept_texts(batch.column(2), batch.column(4), window)
            unnamed = batch.column(3)
            whole = pa.nulls(batch.num_rows, pa.string())
            if pc.any(unnamed).as_py():  # null ids want their texts whole
                all_words = pa.array(kept_texts(batch.column(2), None, window)[0], pa.string())
                whole = pc.if_else(unnamed, all_words, whole)
            columns = [batch.column(0), batch.column(1), pa.array(kept, pa.string()), whole]
            names = ["key", "first", "kept", "whole", "n_words", "n_removed"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names)

    done = texts.join(removed, "key", "left").select("key", "id", "text", "unnamed", "places")
    return done.mapInArrow(cut, "key string, first long, kept string, whole string, n_words long, n_removed long")


def spread(df: DataFrame, done: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = WINDOW, empty: str = "") -> DataFrame:
    """All rows and columns of ``df`` with the ``kept`` of their texts; rows that are removed whole get ``empty``.

    No text of ``df`` moves, only what ``done`` has of each distinct one.
    """
    ident, key = _row_parts(id_column, text)
    own = [c for c in df.columns if c not in (text, "n_words", "n_removed")]
    carried = df.select(F.struct(*own).alias("row"), ident.alias("id"), key.alias("key"))
    both = carried.join(done, "key")
    first = F.col("id") == F.col("first")
    copy = ~first & (F.col("n_words") >= window)
    out = F.when(F.col("id").isNull(), F.col("whole")).when(copy, F.lit(empty)).otherwise(F.col("kept"))
    count = F.when(F.col("id").isNull(), F.lit(0)).when(copy, F.col("n_words")).otherwise(F.col("n_removed"))
    columns = [F.col("row")[c].alias(c) if c != text else out.alias(text) for c in df.columns if c not in ("n_words", "n_removed")]
    return both.select(*columns, F.col("n_words"), count.cast("long").alias("n_removed"))


def _row_parts(id_column: str, text: str) -> tuple[Column, Column]:
    return F.col(id_column).cast("long"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def kept_texts(texts: pa.Array, places: pa.Array | None, window: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each text the words outside the windows at ``places`` joined by blanks, its words, and how many went."""
    found = tokens(texts)
    steps = np.zeros(len(found.starts) + 1, np.int64)
    if places is not None:
        of = np.repeat(np.arange(len(texts)), np.asarray(places.value_lengths().fill_null(0)))
        begin = found.first[of] + places.flatten().to_numpy(zero_copy_only=False)
        np.add.at(steps, begin, 1)
        np.add.at(steps, begin + window, -1)
    stays = np.cumsum(steps[:-1]) == 0
    # A word that stays brings the byte behind it, a blank, if the text goes on there.
    text = np.repeat(np.arange(len(texts)), np.diff(found.first))
    until = np.minimum(found.ends + 1, found.bounds[text + 1])
    edges = np.zeros(len(found.raw) + 1, np.int64)
    edges[found.starts[stays]] += 1
    np.add.at(edges, until[stays], -1)
    shown = np.cumsum(edges[:-1]) > 0
    flat = np.where(_BLANK[found.raw], np.uint8(0x20), found.raw)[shown]
    at = np.concatenate([[0], np.cumsum(shown)])[found.bounds]
    kept = [flat[a:b].tobytes().decode().removesuffix(" ") for a, b in zip(at[:-1], at[1:])]
    gone = np.concatenate([[0], np.cumsum(~stays)])[found.first]
    return kept, np.diff(found.first), np.diff(gone)
