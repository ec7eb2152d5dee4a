"""Hard negatives by exact integer products, many candidates in each multiplication.

The vectors of a block of rows are packed by component (Kronecker substitution): biased to be no less than zero, the
j-th components of all rows stand side by side in fields of one wide integer.  An anchor's j-th component multiplies
all of them at once; the sum of these products over j holds one exact inner product in each field, because fields are
wide enough for the largest possible sum and nothing is carried from one into the next.

Anchors and rows meet in cells of bounded blocks.  A cell hands on only its best few rows of each anchor, which are
ranked once more over all cells, so no list of all scores exists anywhere.

Odd rows: a row with a null id or label, a null vector, or a null or non-finite component takes no part.  Of rows that
repeat an id the one with the least (label, components) counts.  A shorter vector stands for one with zeros behind, an
empty one for zeros.  Equal scores stand in order of ids.  Components and scores beyond the range of a long are held at
its ends.  An empty table gives no rows.  Columns besides the id, the label and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.session import materialize

POSITIVES, NEGATIVES = 5, 10
# A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
# Rows of a block: fewer on a small table, so that there are blocks for all tasks.
MOST_ROWS, LEAST_ROWS, ANCHORS = 16_384, 1024, 4096
_LONG = (-(1 << 63), (1 << 63) - 1)


def products(anchors: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """For each anchor its exact inner products with all rows (both: vectors x components, long)."""
    count, width = rows.shape
    if count == 0 or width == 0:
        yield from (np.zeros(count, np.int64) for _ in anchors)
        return
    # Python integers, because a bias may leave the range of a long.
    row_bias, row_top = -min(0, int(rows.min())), int(rows.max())
    bias, top = -min(0, int(anchors.min(initial=0))), int(anchors.max(initial=0))
    bits = (width * (row_top + row_bias) * (top + bias)).bit_length()
    size = next((s for s in (4, 8) if bits <= 8 * s), -(-bits // 8))
    wide = [_packed(rows[:, j], row_bias, size) for j in range(width)]
    sums = [sum(r) for r in rows.tolist()]
    small = bits <= 62 and width * max(row_bias, row_top) * max(bias, top) < 1 << 61
    back = np.array(sums, np.int64) * bias if small else [s * bias for s in sums]
    for anchor in anchors.tolist():
        total = sum(map(mul, (a + bias for a in anchor), wide)).to_bytes(count * size, "little")
        shift = row_bias * sum(anchor) + width * row_bias * bias
        if small:
            yield np.frombuffer(total, f"<u{size}").astype(np.int64) - back - shift
        else:
            fields = (int.from_bytes(total[i : i + size], "little") for i in range(0, len(total), size))
            yield np.array([min(max(f - b - shift, _LONG[0]), _LONG[1]) for f, b in zip(fields, back)], np.int64)


def _packed(column: np.ndarray, bias: int, size: int) -> int:
    """One component of all rows in fields of ``size`` bytes."""
    if size in (4, 8) and bias < 1 << 62:
        return int.from_bytes((column.astype(np.uint64) + np.uint64(bias)).astype(f"<u{size}").tobytes(), "little")
    return int.from_bytes(b"".join((v + bias).to_bytes(size, "little") for v in column.tolist()), "little")


def vectors(df: DataFrame, id_column: str, label: Column, vector: str) -> DataFrame:
    """(id, label, v): the rows that take part, components as floor(256 x)."""
    values = F.col(vector).cast("array<double>")
    sound = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = df.where(F.col(id_column).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & sound)
    rows = kept.select(
        F.col(id_column).cast("long").alias("id"),
        label.cast("string").alias("label"),
        F.transform(values, lambda x: F.floor(x * 256)).alias("v"),
    )
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _cells(rows: DataFrame, anchors: DataFrame, run, kind: str) -> DataFrame:
    """``run(anchor columns, row columns, products)`` in each cell of anchor and row blocks."""
    count, asked = rows.count(), anchors.count()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = min(MOST_ROWS, max(LEAST_ROWS, count // tasks))
    row_blocks, anchor_blocks = max(1, -(-count // size)), max(1, -(-asked // ANCHORS))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ours = anchors.withColumn("i", place(anchor_blocks)).withColumn("j", every(row_blocks))
    theirs = rows.withColumn("j", place(row_blocks)).withColumn("i", every(anchor_blocks))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.sort_by("id")
        width = max([0, *(n for t in (a, b) for n in t.column("v").combine_chunks().value_lengths().to_pylist())])
        found = list(run(a, b, products(_matrix(a.column("v"), width), _matrix(b.column("v"), width)))) if len(a) and len(b) else []
        names = [part.split()[0] for part in kind.split(", ")]
        parts = [np.concatenate(c) for c in zip(*found)] or [np.zeros(0, np.int64)] * len(names)
        return pa.table({n: pa.array(p, pa.int64()) for n, p in zip(names, parts)})

    return ours.groupBy("i", "j").cogroup(theirs.groupBy("i", "j")).applyInArrow(cell, kind)


def _best_positives(a: pa.Table, b: pa.Table, scores: Iterator[np.ndarray], most: int):
    ids, labels = b.column("id").to_numpy(), np.array(b.column("label").to_pylist(), object)
    of = {label: np.flatnonzero(labels == label) for label in set(labels)}
    for anchor, label, score in zip(a.column("id").to_pylist(), a.column("label").to_pylist(), scores):
        same = of.get(label, np.zeros(0, np.int64))
        same = same[ids[same] != anchor]
        best = same[np.argsort(~score[same], kind="stable")[:most]]  # ~x falls as x rises and cannot overflow
        yield np.full(len(best), anchor), ids[best], score[best]


def _best_negatives(a: pa.Table, b: pa.Table, scores: Iterator[np.ndarray], most: int, low: int, high: int):
    ids, labels = b.column("id").to_numpy(), np.array(b.column("label").to_pylist(), object)
    of = {label: np.flatnonzero(labels != label) for label in set(a.column("label").to_pylist())}
    asked = zip(*(a.column(c).to_pylist() for c in ("id", "label", "positives")))
    for (anchor, label, positives), score in zip(asked, scores):
        others = of[label]
        order = others[np.argsort(~score[others], kind="stable")]
        falling = ~score[order]
        for p in positives:
            least, greatest = -(-low * p["score"] // 100), high * p["score"] // 100
            begin, end = np.searchsorted(falling, ~greatest), np.searchsorted(falling, ~least, "right")
            best = order[begin : min(end, begin + most)]
            n = len(best)
            yield np.full(n, anchor), np.full(n, p["id"]), ids[best], np.full(n, p["score"]), score[best]


def _ranked(found: DataFrame, by: list[str], score: str, name: str, most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), name)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(
    df: DataFrame,
    anchor: Column,
    id_column: str = "vec_id",
    label: Column | None = None,
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """For each anchor (a condition on ``id``) and each of its first positives, the first negatives within the window.

    Gives anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    rows = materialize(vectors(df, id_column, F.col("label") if label is None else label, vector), "mining-vectors")
    anchors = rows.where(anchor)
    near = _cells(rows, anchors, lambda a, b, s: _best_positives(a, b, s, positives), "anchor long, id long, score long")
    near = _ranked(near, ["anchor"], "score", "id", positives)
    near = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("id", "score"))).alias("positives"))  # five at most
    asking = materialize(anchors.join(near.withColumnRenamed("anchor", "id"), "id"), "mining-anchors")
    kind = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    far = _cells(rows, asking, lambda a, b, s: _best_negatives(a, b, s, negatives, low, high), kind)
    ranked = _ranked(far, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
