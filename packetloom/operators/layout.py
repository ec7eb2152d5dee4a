"""Row layouts that keep every task's share bounded, whatever the key skew.

* ``split_hot_keys``: keys with more rows than ``max_rows`` are cut into
  time-ordered blocks, so ordered windows run per (key, block).
* ``sequence_blocks``: rows with a dense sequence number are cut into
  equal-sized blocks, each with a halo of the rows its first frames look back on.
* ``dense_sequence``: gives rows such a number without a single-task window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.session import materialize

MAX_GROUP_ROWS = 5_000_000
# Rows of a written table (some 100 bytes each) that may be broadcast.
BROADCAST_ROWS = 500_000

BLOCK_ROWS = 16_384
# Blocks that a task takes on average.
TASK_BLOCKS = 4


def small_side(table: DataFrame, values_per_row: int = 1) -> DataFrame:
    """Broadcast a written table when its size allows; otherwise leave it to a shuffle join."""
    return F.broadcast(table) if table.count() * values_per_row <= BROADCAST_ROWS else table


def split_hot_keys(
    df: DataFrame, keys: list[str], order: str, max_rows: int = MAX_GROUP_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """Add ``block`` so that (keys, block) groups stay near ``max_rows`` rows.

    Counts per key combine on the map side.  There are at most
    ``total / max_rows`` hot keys; their cut points are quantiles of ``order``.
    The cut points are written once, so that re-run tasks place rows the same
    way.  Returns the rows and the hot keys (None when no key is hot).
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_rows)
    size = counts.agg(F.count(F.lit(1)).alias("keys"), F.max("n").alias("largest")).first()
    if not size["keys"]:
        return df.withColumn("block", F.lit(0)), None
    counts = materialize(counts, "hot-keys")
    parts = math.ceil(size["largest"] / max_rows) + 1
    cuts = [i / parts for i in range(1, parts)]
    hot_rows = df.select(*keys, order).join(small_side(counts).select(*keys), keys)
    hot = materialize(
        hot_rows.groupBy(*keys).agg(
            F.percentile_approx(order, F.array(*map(F.lit, cuts)), 20 * parts).alias("cuts")
        ),
        "hot-cuts",
    )
    # A cut point takes 8 bytes, a row of names about 100.
    placed = df.join(small_side(hot, 1 + parts // 12), keys, "left").withColumn(
        "block", F.when(F.col("cuts").isNull(), 0).otherwise(cuts_below(F.col("cuts"), F.col(order), parts))
    )
    return placed.drop("cuts"), hot.select(*keys)


def cuts_below(cuts: Column, value: Column, parts: int) -> Column:
    """How many of the ascending ``cuts`` are smaller than ``value`` (binary search)."""
    steps = [2**p for p in reversed(range(parts.bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda found, step: F.when(F.get(cuts, found + step - 1) < value, found + step).otherwise(found),
    )


def sequence_blocks(
    df: DataFrame,
    look_back: int,
    block_rows: int = BLOCK_ROWS,
    seq: str = "seq",
    by: list[str] | None = None,
    task_blocks: int = TASK_BLOCKS,
) -> DataFrame:
    """Copy each row into every block whose rows may look back on it.

    Adds ``block`` and ``halo`` (true for context copies, to be dropped after
    the windows).  A group holds at most ``block_rows + look_back`` rows and
    one hash exchange on the block serves every window partitioned by the
    block plus further keys.  Tasks grow in number with the rows, to some
    ``task_blocks`` blocks each.
    """
    own = F.call_function("div", F.col(seq), F.lit(block_rows))
    last = F.call_function("div", F.col(seq) + look_back, F.lit(block_rows))
    placed = df.withColumn("block", F.explode(F.sequence(own, last))).withColumn("halo", F.col("block") != own)
    # Not by the session's number of partitions alone: a task sorts its rows once for each kind of window.
    rows = df.select(seq).count()
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / (task_blocks * block_rows)))
    return placed.repartition(tasks, *(by or []), "block")


def dense_sequence(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "seq") -> DataFrame:
    """Number the rows 0, 1, 2, ... in ``order``, anew for each value of ``by``.

    A range exchange spreads the rows over tasks by the whole sort key, so a
    single large group is cut into many ranges.  Each row then knows its place
    in its range; adding the rows of its group in earlier ranges gives the number.  ``order`` must end in a unique column.
    """
    by = by or []
    keys = [*by, *order]
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(partitions, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_range", F.shiftrightunsigned("_id", 33))
        .withColumn("_place", F.col("_id").bitwiseAND((1 << 33) - 1))
        .drop("_id")
    )
    placed = materialize(placed, "ordered")
    # Per range and group: its rows there, where they begin, and its rows in earlier ranges.
    parts = placed.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_low"))
    # One row per range (and group): a group has at most as many as there are ranges.
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_low")
    shifts = parts.select("_range", *by, shift.alias("_shift"))
    if not by:
        shifts = F.broadcast(shifts)  # one row per shuffle partition
    # The range is part of the key, so a large group does not make a large join partition.
    numbered = placed.join(shifts, ["_range", *by]).withColumn(name, F.col("_place") + F.col("_shift"))
    return numbered.drop("_range", "_place", "_shift")
