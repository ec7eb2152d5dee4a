"""K-means sweep with inertia and silhouette."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.layout import small_side
from packetloom.operators.sampling import SEED, fixed_sample
from packetloom.operators.trees import as_array
from packetloom.session import materialize

# Range of k, restarts, sample size.
K_RANGE = range(2, 11)
RESTARTS = 10
SAMPLE_ROWS = 10_000
MAX_ITERATIONS, TOLERANCE = 300, 1e-4
# Rows from which starting centers are drawn; they come to the driver.
START_ROWS = 10_000
# Points of one side of a block pair.
BLOCK_ROWS = 2048


@dataclass(frozen=True)
class ClusterModel:
    """Fitted centers and the inertia of the rows they were fitted on."""

    centers: np.ndarray
    inertia: float
    iterations: int = 0
    vector: str = "vector"

    def getK(self) -> int:  # noqa: N802  like the library's other fitted models
        return len(self.centers)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``: the nearest center, of equally near ones the first."""
        centers = self.centers

        @F.pandas_udf("int")
        def place(values: pd.Series) -> pd.Series:
            if len(values) == 0:
                return pd.Series([], dtype="int32")
            return pd.Series(_squares(np.stack(values.to_numpy()), centers).argmin(1).astype(np.int32))

        return df.withColumn("prediction", place(as_array(df, self.vector)))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(i, [float(v) for v in c], float(self.inertia)) for i, c in enumerate(self.centers)]
        spark.createDataFrame(rows, "cluster int, center array<double>, inertia double").coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ClusterModel:
        rows = spark.read.schema("cluster int, center array<double>, inertia double").json(path).orderBy("cluster").collect()
        return cls(np.array([r["center"] for r in rows]), rows[0]["inertia"])


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centers."""
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centers.T + (centers**2).sum(1), 0)


def spread_starts(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Starting centers: each further one is drawn by its squared distance to the nearest so far (k-means++)."""
    chosen = [int(rng.integers(len(points)))]
    nearest = ((points - points[chosen[0]]) ** 2).sum(1)
    for _ in range(1, k):
        total = nearest.sum()
        share = nearest / total if total > 0 else None
        chosen.append(int(rng.choice(len(points), p=share)))
        nearest = np.minimum(nearest, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def fit_many(df: DataFrame, starts: list[np.ndarray], vector: str = "vector", max_iter: int = MAX_ITERATIONS, tolerance: float = TOLERANCE) -> list[ClusterModel]:
    """Lloyd's iterations from each of the ``starts`` at once: one scan of ``df`` for each iteration, whatever their number.

    A set of centers whose shift falls to ``tolerance`` times the mean variance of the features (or 0) is frozen and
    takes no more part; a last scan gives the inertia of all final centers.  A center that loses all rows stays.
    What comes to the driver in an iteration is one row for each center.
    """
    rows = df.select(as_array(df, vector).alias("x"))
    width = starts[0].shape[1]
    each = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.var_pop("v").alias("v"))
    least = tolerance * float(each.agg(F.avg("v")).first()[0] or 0.0)
    centers = [np.array(s, float) for s in starts]
    active, rounds = list(range(len(centers))), [0] * len(centers)
    for _ in range(max_iter):
        if not active:
            break
        still = []
        for index, (sums, counts, _) in _assigned(rows, centers, active).items():
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers[index])
            shift = ((new - centers[index]) ** 2).sum()
            centers[index], rounds[index] = new, rounds[index] + 1
            if shift > least:
                still.append(index)
        active = still
    last = _assigned(rows, centers, list(range(len(centers))))
    return [ClusterModel(c, last[i][2], rounds[i], vector) for i, c in enumerate(centers)]


def _assigned(rows: DataFrame, centers: list[np.ndarray], active: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Of each active set: the sum of rows and their number by center, and the inertia."""
    width = centers[0].shape[1]
    sets = {i: centers[i] for i in active}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {i: np.zeros((len(c), width + 2)) for i, c in sets.items()}
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, -1)
            if len(x) == 0:
                continue
            every = _squares(x, np.concatenate(list(sets.values())))  # one product for the centers of all sets
            begin = 0
            for i, c in sets.items():
                own = every[:, begin : begin + len(c)]
                begin += len(c)
                place = own.argmin(1)
                member = np.zeros((len(x), len(c)))
                member[np.arange(len(x)), place] = 1
                sums[i][:, :width] += member.T @ x
                sums[i][:, width] += member.sum(0)
                sums[i][:, width + 1] += np.bincount(place, own[np.arange(len(x)), place], len(c))
        ids = [(i, k) for i, c in sets.items() for k in range(len(c))]
        values = np.concatenate(list(sums.values()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in ids], pa.int32()), pa.array([k for _, k in ids], pa.int32()), pa.array(list(values), pa.list_(pa.float64()))],
            ["set", "center", "values"],
        )

    def add(table: pa.Table) -> pa.Table:
        total = np.stack(table.column("values").to_numpy()).sum(0)
        return table.slice(0, 1).set_column(2, "values", pa.array([total.tolist()], pa.list_(pa.float64())))

    kind = "set int, center int, values array<double>"
    # One row for each task in a group.
    merged = rows.mapInArrow(assign, kind).groupBy("set", "center").applyInArrow(add, kind)
    found = {i: np.zeros((len(c), width + 2)) for i, c in sets.items()}
    for row in merged.collect():  # one row for each center
        found[row["set"]][row["center"]] = row["values"]
    return {i: (v[:, :width], v[:, width], float(v[:, width + 1].sum())) for i, v in found.items()}


def fit_kmeans(df: DataFrame, k: int, restarts: int = RESTARTS, seed: int = SEED, max_iter: int = MAX_ITERATIONS, vector: str = "vector") -> ClusterModel:
    """Best of ``restarts`` runs by inertia; all runs share their scans."""
    return fit_sweep(df, [k], restarts, seed, max_iter, vector)[k]


def fit_sweep(
    df: DataFrame, ks: Iterable[int], restarts: int = RESTARTS, seed: int = SEED, max_iter: int = MAX_ITERATIONS, vector: str = "vector"
) -> dict[int, ClusterModel]:
    """The best run for each k.  Starting centers are drawn from at most ``START_ROWS`` rows, picked by hash."""
    hashed = df.select(as_array(df, vector).alias("x")).withColumn("h", F.xxhash64("x"))
    points = np.array([r["x"] for r in hashed.orderBy("h", "x").limit(START_ROWS).collect()])
    jobs = [(k, r) for k in ks for r in range(restarts)]
    starts = [spread_starts(points, k, np.random.default_rng((seed, k, r))) for k, r in jobs]
    best: dict[int, ClusterModel] = {}
    for (k, _), model in zip(jobs, fit_many(df, starts, vector, max_iter)):
        if k not in best or model.inertia < best[k].inertia:
            best[k] = model
    return best


def kmeans_sweep(
    df: DataFrame,
    key: str,
    ks: range = K_RANGE,
    restarts: int = RESTARTS,
    sample_rows: int = SAMPLE_ROWS,
    refit: bool = True,
) -> tuple[DataFrame, int, ClusterModel | None]:
    """Sweep ``ks`` on a sample: (k, inertia, silhouette) rows, best k by silhouette, model on all rows.

    The sample is the operator's own definition (at most ``sample_rows`` rows);
    the winning k is fitted again on everything.
    """
    spark = df.sparkSession
    sample = materialize(fixed_sample(df.select(key, "vector"), sample_rows, key), "kmeans-sample")
    fitted = fit_sweep(sample, ks, restarts)
    scores = silhouettes(sample, key, fitted)
    rows = [(k, float(fitted[k].inertia), scores[k]) for k in ks]
    best = max(rows, key=lambda r: r[2])[0]
    final = fit_kmeans(df.select("vector"), best, restarts) if refit else None
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double"), best, final


def silhouettes(df: DataFrame, key: str, fitted: dict[int, ClusterModel], block_rows: int = BLOCK_ROWS) -> dict[int, float]:
    """Mean Euclidean silhouette of each fit; the distances of a pair of blocks serve all of them.

    Time and the blocks' copies grow with the square of the rows, so ``df`` should be a sample.
    """
    vector = next(iter(fitted.values())).vector
    ks = list(fitted)
    ends = np.cumsum([0, *ks])
    blocks = max(1, -(-df.count() // block_rows))

    def member(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), ends[-1]))
        for begin, k in zip(ends, ks):
            out[np.arange(len(x)), begin + _squares(x, fitted[k].centers).argmin(1)] = 1
        return out

    rows = df.select(F.col(key).alias("key"), as_array(df, vector).alias("x")).withColumn("own", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    asks = rows.select("key", "x", F.col("own").alias("i"), every.alias("j")).groupBy("i", "j")
    gives = rows.select("x", every.alias("i"), F.col("own").alias("j")).groupBy("i", "j")

    def sums(ask: pa.Table, give: pa.Table) -> pa.Table:
        if len(ask) == 0 or len(give) == 0:
            return pa.table({"key": pa.array([], ask.schema.field("key").type), "sums": pa.array([], pa.list_(pa.float64()))})
        own, theirs = (np.stack(t.column("x").to_numpy()) for t in (ask, give))
        found = np.sqrt(_squares(own, theirs)) @ member(theirs)
        return pa.table({"key": ask.column("key"), "sums": pa.array(list(found), pa.list_(pa.float64()))})

    kind = rows.schema["key"].dataType.simpleString()
    cells = asks.cogroup(gives).applyInArrow(sums, f"key {kind}, sums array<double>")
    apart = cells.select("key", F.posexplode("sums").alias("c", "s")).groupBy("key", "c").agg(F.sum("s").alias("s"))
    total = apart.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("a")).select("key", F.col("a.s").alias("sums"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros((0, len(fitted[ks[0]].centers[0])))
            yield pa.RecordBatch.from_arrays([pa.array([member(x).sum(0).tolist()], pa.list_(pa.float64()))], ["n"])

    counted = rows.select("x").mapInArrow(count, "n array<double>").select(F.posexplode("n").alias("c", "n"))
    sizes = np.zeros(ends[-1])
    for r in counted.groupBy("c").agg(F.sum("n").alias("n")).collect():  # one row for each cluster
        sizes[r["c"]] = r["n"]

    def value(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, found = (np.stack(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("x", "sums"))
            belongs, scores = member(x) > 0, []
            for begin, end in zip(ends[:-1], ends[1:]):
                mine, n = belongs[:, begin:end], sizes[begin:end]
                far = np.where(mine | (n == 0), np.inf, found[:, begin:end] / np.maximum(n, 1)).min(1)
                size = np.where(mine, n, 0).sum(1)
                within = np.where(mine, found[:, begin:end], 0).sum(1) / np.maximum(size - 1, 1)
                widest = np.maximum(within, np.where(np.isinf(far), 0, far))
                alone = (size < 2) | np.isinf(far) | (widest == 0)
                scores.append(np.where(alone, 0.0, (np.where(alone, 0.0, far) - within) / np.where(alone, 1.0, widest)))
            yield pa.RecordBatch.from_arrays([pa.array([[float(s.sum()) for s in scores]], pa.list_(pa.float64())), pa.array([len(x)])], ["s", "n"])

    parts = rows.select("key", "x").join(total, "key").mapInArrow(value, "s array<double>, n long")
    row = parts.agg(F.sum("n"), *[F.sum(F.col("s")[i]) for i in range(len(ks))]).first()
    return {k: row[i + 1] / row[0] for i, k in enumerate(ks)}


def inertia(df: DataFrame, point: Column, center: Column) -> DataFrame:
    """Sum of squared distances of the points to their given centers."""
    gap = F.zip_with(point, center, lambda a, b: (a.cast("double") - b.cast("double")) ** 2)
    return df.agg(F.sum(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x)).alias("inertia"))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``x`` to all of ``y``; near ones, in which products would cancel, by differences."""
    of_x, of_y = (x**2).sum(1), (y**2).sum(1)
    squares = (-2 * x) @ y.T
    squares += of_x[:, None]
    squares += of_y
    near = np.nonzero(~(squares > 1e-4 * (of_x[:, None] + of_y.max(initial=0))))
    for begin in range(0, len(near[0]), 1 << 14):
        i, j = (n[begin : begin + (1 << 14)] for n in near)
        squares[i, j] = ((x[i] - y[j]) ** 2).sum(1)
    return np.sqrt(squares, out=squares)


def silhouette_rows(placed: DataFrame, key: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Euclidean silhouette value of each row (unique key, point array, cluster).

    Each point needs its distance to all others: rows are written in blocks, one row a block, and every pair of blocks
    is reduced at once to one sum per point and cluster, by matrix products.  A task keeps the sums of its own block over
    all blocks it meets.  Neither pairs nor copies of blocks are written or shuffled, and nothing passes through the
    driver, but time grows with the square of the rows: for a large table hand over a ``fixed_sample``.
    """
    blocks = max(1, -(-placed.count() // block_rows))
    rows = placed.select(F.struct(F.col(key).alias("key"), "cluster", F.col("point").cast("array<double>").alias("point")).alias("r"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("own"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema["r"].dataType.fields}
    tasks = min(blocks, int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = materialize(rows.repartition(tasks, "own").groupBy("own").agg(F.collect_list("r").alias("asks")), "blocks")

    def unpacked(block: pa.ListScalar) -> tuple[pa.Array, pa.Array, np.ndarray]:
        names, of, points = (block.values.field(c) for c in ("key", "cluster", "point"))
        return names, of, np.stack(points.to_numpy(zero_copy_only=False))

    def reduced(ask: tuple, found: dict) -> pa.RecordBatch:
        count = len(ask[0])
        at = pa.array(np.tile(np.arange(count), len(found)))
        other = pa.array(list(found), ask[1].type).take(pa.array(np.repeat(np.arange(len(found)), count)))
        return pa.RecordBatch.from_arrays([ask[0].take(at), ask[1].take(at), other, pa.array(np.concatenate(list(found.values())))], ["key", "cluster", "other", "sum"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ask, found = None, None, {}
        for batch in batches:
            for number, asks, gives in zip(batch.column("own").to_pylist(), batch.column("asks"), batch.column("gives")):
                if number != own:
                    if found:
                        yield reduced(ask, found)
                    own, ask, found = number, unpacked(asks), {}
                _, of, theirs = unpacked(gives)
                names = of.dictionary_encode("encode")
                member = np.eye(len(names.dictionary))[names.indices.to_numpy(zero_copy_only=False)]
                total = np.concatenate([distances(ask[2][i : i + 256], theirs) @ member for i in range(0, len(ask[2]), 256)])
                for name, column in zip(names.dictionary.to_pylist(), total.T):
                    found[name] = found[name] + column if name in found else column
        if found:
            yield reduced(ask, found)

    # Each task of the product reads its two portions of the written blocks.
    pairs = packed.hint("shuffle_replicate_nl").crossJoin(packed.select(F.col("asks").alias("gives")))
    parts = pairs.mapInArrow(sums, f"key {kinds['key']}, cluster {kinds['cluster']}, other {kinds['cluster']}, sum double")
    # One row per cluster.
    sizes = small_side(materialize(placed.groupBy(F.col("cluster").alias("other")).agg(F.count(F.lit(1)).alias("n")), "cluster-sizes"))
    far = parts.groupBy("key", "cluster", "other").agg(F.sum("sum").alias("sum")).join(sizes, "other")
    mine = F.col("other") == F.col("cluster")
    each = far.groupBy("key", "cluster").agg(
        F.max(F.when(mine & (F.col("n") > 1), F.col("sum") / (F.col("n") - 1))).alias("within"),
        F.min(F.when(~mine, F.col("sum") / F.col("n"))).alias("nearest"),
    )
    widest = F.greatest("within", "nearest")
    alone = F.col("within").isNull() | F.col("nearest").isNull() | (widest == 0)
    value = F.when(alone, 0.0).otherwise((F.col("nearest") - F.col("within")) / F.when(widest != 0, widest))
    return each.select(F.col("key").alias(key), "cluster", value.alias("silhouette"))


def silhouette(placed: DataFrame, key: str) -> float:
    return silhouette_rows(placed, key).agg(F.avg("silhouette")).first()[0]
