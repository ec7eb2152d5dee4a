"""Best-fit packing of texts into sequences of several permitted lengths.

Longer texts are first cut into pieces of the largest length and a rest.  Pieces are packed by falling length, each
into the open bin it leaves least room in; when none fits, a bin of the size that costs least per token of the pieces
at hand is opened.  In the end every bin shrinks to the least permitted length that holds its contents.  Which sizes
may be opened is chosen beforehand: all sets of permitted lengths are tried on the counts of piece lengths of the
whole table, and the one with the least total cost wins.

Pieces of equal length are packed as one class with a count, so planning takes time by distinct lengths, not by rows.
The rows are dealt evenly to tasks of ``SHARD_ROWS`` pieces, each packing its own; a task ends with a few part-filled
bins, one row in thousands.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (512, 1024, 2048, 4096)
# One task packs this many pieces: about 1 MB of lengths and ids.
SHARD_ROWS = 32_768


def default_costs(sizes: tuple[int, ...] = SIZES) -> dict[int, float]:
    """Cost of a sequence: linear in its length, plus attention growing with its square, plus a fixed share."""
    return {s: s * (1 + s / 16_384) + 16.0 for s in sizes}


@dataclass
class Bins:
    """``count`` bins with the same contents: (length, pieces of it) in packing order."""

    count: int
    room: int
    contents: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0

    @property
    def used(self) -> int:
        return sum(length * n for length, n in self.contents)


def _opening_size(length: int, n: int, openable: list[int], costs: Mapping[int, float]) -> int:
    fits = lambda s: min(n, s // length)
    return min((s for s in openable if s >= length), key=lambda s: (costs[s] / (fits(s) * length), s))


def pack_classes(counts: Mapping[int, int], openable: list[int], costs: Mapping[int, float]) -> list[Bins]:
    """Packs ``counts[length]`` pieces of each length; the same bins as packing them one by one."""
    open_bins: dict[int, list[Bins]] = {}
    rooms: list[int] = []  # rooms that some open bin has, ascending

    def put(bins: Bins) -> None:
        if bins.room not in open_bins:
            open_bins[bins.room] = []
            insort(rooms, bins.room)
        open_bins[bins.room].append(bins)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                bins = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            else:
                room = _opening_size(length, left, openable, costs)
                bins = Bins(max(1, left // (room // length)), room)
            # A bin that took a piece is the tightest fit for the next one, until it is full.
            each = min(room // length, left)
            taken = min(bins.count, left // each)
            if taken < bins.count:
                put(Bins(bins.count - taken, room, bins.contents))
            put(Bins(taken, room - each * length, [*bins.contents, (length, each)]))
            left -= taken * each
    return [b for group in open_bins.values() for b in group]


def shrink(bins: list[Bins], sizes: list[int]) -> list[Bins]:
    for b in bins:
        b.size = sizes[bisect_left(sizes, b.used)]
    return bins


def total_cost(bins: list[Bins], costs: Mapping[int, float]) -> float:
    return sum(b.count * costs[b.size] for b in bins)


def choose_openable(counts: Mapping[int, int], costs: Mapping[int, float]) -> list[int]:
    """The set of sizes to open that packs these pieces at the least cost (ties: the fewer and smaller sizes)."""
    sizes = sorted(costs)
    longest = max(counts, default=0)
    best = None
    for k in range(1, len(sizes) + 1):
        for some in combinations(sizes, k):
            if some[-1] >= longest:
                cost = total_cost(shrink(pack_classes(counts, list(some), costs), sizes), costs)
                if best is None or cost < best[0]:
                    best = cost, list(some)
    return best[1]


def pieces(df: DataFrame, length: Column, largest: int) -> DataFrame:
    """All columns of each row once per piece, with ``piece_start`` and ``piece_length``.

    Null, zero and negative lengths give one piece of length 0.
    """
    whole = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0))
    cut = df.drop("piece_start", "piece_length", "__whole").withColumn("__whole", whole)
    last = F.greatest(F.col("__whole") - 1, F.lit(0))
    starts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(last / largest)), lambda i: i * largest)
    cut = cut.withColumn("piece_start", F.explode(starts))
    size = F.least(F.col("__whole") - F.col("piece_start"), F.lit(largest))
    return cut.withColumn("piece_length", size.cast("int")).drop("__whole")


def pack(
    df: DataFrame, length: Column, id_column: str = "doc_id", costs: Mapping[int, float] | None = None, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Every piece of every row with its bin.

    Gives the id, ``piece_start`` and ``piece_length`` (in the unit of ``length``), ``bin_id``, ``bin_size`` and
    ``bin_offset``.  Rows of length 0 come with a null bin.  Repeated rows are packed each; a null id is kept.
    ``costs`` maps the permitted lengths to their costs.
    """
    costs = dict(costs or default_costs())
    sizes = sorted(costs)
    if not sizes or sizes[0] < 1:
        raise ValueError("bins need positive sizes")
    cut = pieces(df.select(F.col(id_column).cast("long").alias("__id"), length.alias("__length")), F.col("__length"), sizes[-1])
    cut = cut.select("__id", "piece_start", "piece_length")
    # One count per possible length.
    rows = cut.groupBy("piece_length").count().collect()
    counts = {r["piece_length"]: r["count"] for r in rows if r["piece_length"] > 0}
    openable = choose_openable(counts, costs) if counts else sizes
    shards = max(1, -(-sum(r["count"] for r in rows) // shard_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            lengths = table.column("piece_length").to_numpy()
            found = _assign(lengths, openable, sizes, costs, TaskContext.get().partitionId())
            yield from (
                table.append_column("bin_id", found[0]).append_column("bin_size", found[1]).append_column("bin_offset", found[2])
            ).to_batches()

    # Dealing in turns keeps tasks even, whatever ids or lengths repeat.
    out = cut.repartition(shards).mapInArrow(
        run, "__id long, piece_start long, piece_length int, bin_id long, bin_size int, bin_offset int"
    )
    return out.withColumnRenamed("__id", id_column)


def _assign(lengths: np.ndarray, openable: list[int], sizes: list[int], costs: Mapping[int, float], shard: int) -> list[pa.Array]:
    """Bin, its size and the offset in it for each piece of a task."""
    order = np.argsort(-lengths, kind="stable")
    values, first, n = np.unique(-lengths[order], return_index=True, return_counts=True)
    counts = {int(-v): int(c) for v, c in zip(values, n) if v < 0}
    following = {int(-v): int(f) for v, f in zip(values, first)}  # next unplaced piece of each length, in order
    bin_id = np.full(len(lengths), -1, np.int64)
    bin_size, offset = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int32)
    begin = 0
    for b in shrink(pack_classes(counts, openable, costs), sizes):
        at = 0
        numbers = begin + np.arange(b.count)
        for length, each in b.contents:
            picked = order[following[length] : following[length] + b.count * each]
            following[length] += b.count * each
            bin_id[picked] = np.repeat(numbers, each) + (shard << 32)
            bin_size[picked] = b.size
            offset[picked] = at + np.tile(np.arange(each) * length, b.count)
            at += each * length
        begin += b.count
    none = bin_id < 0
    return [pa.array(x, mask=none) for x in (bin_id, bin_size, offset)]


def word_count(text: Column) -> Column:
    """Words between white space, and one for the end of the text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", 1).otherwise(F.size(F.split(trimmed, r"\s+")) + 1)
