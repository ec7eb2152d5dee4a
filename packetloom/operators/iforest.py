"""Isolation forest over source windows (Liu, Ting and Zhou, 2008).

Fitting draws a small exact sample per tree, whatever the table size, and
grows each tree in its own task; the forest is a node table.  Scoring walks
the nodes with array operations inside the scan of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.encode import NotFittedError, scaling_parameters
from packetloom.operators.sampling import exact_quantile
from packetloom.schemas import WINDOW_FEATURES
from packetloom.session import materialize

# Forest size, sample size, share of outliers, seed, least baseline.
TREES = 200
TREE_ROWS = 256
CONTAMINATION = 0.02
SEED = 42
MIN_BASELINE = 50
EULER_GAMMA = 0.5772156649015329

NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n, 3.0)
    many = 2.0 * (np.log(m - 1.0) + EULER_GAMMA) - 2.0 * (m - 1.0) / m
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


def tree_samples(df: DataFrame, key: str, n: int, trees: int, rows: int, seed: int) -> DataFrame:
    """(tree, features...) with exactly ``min(rows, n)`` rows per tree, without replacement.

    A row joins a tree when its hash for that tree is small enough; the bound
    leaves a few more than needed, of which the smallest hashes are kept.
    About ``trees * rows`` rows are shuffled, however many there are to scan.
    """
    margin = rows + 12.0 * rows**0.5 + 40.0
    share = min(1.0, margin / n)
    hashed = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(seed), t, F.col(key)).alias("h")),
    )
    limit = int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1
    near = F.filter(hashed, lambda x: x["h"] <= limit)
    picked = df.withColumn("pick", F.explode(near)).select("pick.*", key, *WINDOW_FEATURES)
    # Trees are little data but much work: a fixed number of partitions keeps them apart.
    tasks = min(trees, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    picked = picked.repartition(tasks, "tree")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("h", key))
    return picked.withColumn("rank", rank).where(F.col("rank") <= rows).select("tree", key, *WINDOW_FEATURES)


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree: (node, feature, threshold, left, right, size, depth); leaves have feature -1."""
    nodes: list[tuple] = [()]
    todo = [(0, points, 0)]
    while todo:
        node, part, depth = todo.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(low < high)
        if depth >= limit or len(part) <= 1 or not len(usable):
            nodes[node] = (node, -1, 0.0, -1, -1, len(part), depth)
            continue
        feature = int(rng.choice(usable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= threshold
        left, right = len(nodes), len(nodes) + 1
        nodes += [(), ()]
        nodes[node] = (node, feature, threshold, left, right, len(part), depth)
        todo += [(left, part[goes_left], depth + 1), (right, part[~goes_left], depth + 1)]
    return nodes


@dataclass
class WindowAnomalyModel:
    """Scaler parameters, node table and score offset; trees x 511 nodes at most."""

    scaler: dict[str, tuple[float, float]] | None = None
    nodes: DataFrame | None = None
    sample_rows: int = 0
    offset: float = 0.0
    baseline_rows: int = 0
    _shared: tuple[Broadcast, int] | None = field(default=None, repr=False, compare=False)

    @classmethod
    def fit(
        cls,
        windows: DataFrame,
        key: str = "window_id",
        trees: int = TREES,
        rows: int = TREE_ROWS,
        contamination: float = CONTAMINATION,
        seed: int = SEED,
        min_baseline: int = MIN_BASELINE,
    ) -> WindowAnomalyModel:
        """``windows``: a unique ``key`` and the window features."""
        n = windows.count()
        if n < min_baseline:
            raise ValueError(f"a baseline of {n} windows is too small to fit on; {min_baseline} are needed")
        scaler = scaling_parameters(windows, WINDOW_FEATURES)
        sample = tree_samples(windows, key, n, trees, rows, seed)
        centre = np.array([scaler[f][0] for f in WINDOW_FEATURES])
        spread = np.array([scaler[f][1] for f in WINDOW_FEATURES])
        size = min(rows, n)
        limit = int(np.ceil(np.log2(max(size, 2))))

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            pdf = pdf.sort_values(key)
            points = (pdf[WINDOW_FEATURES].to_numpy(dtype=float) - centre) / spread
            nodes = _grow(points, np.random.default_rng([seed, tree]), limit)
            names = ["node", "feature", "threshold", "left", "right", "size", "depth"]
            return pd.DataFrame(nodes, columns=names).assign(tree=tree)

        nodes = materialize(sample.groupBy("tree").applyInPandas(build, NODE_SCHEMA), "forest")
        model = cls(scaler, nodes, size, 0.0, n)
        raw = materialize(model._raw_scores(windows.select(key, *WINDOW_FEATURES)), "baseline-scores")
        model.offset = exact_quantile(raw, "raw_score", contamination)
        return model

    def _forest(self) -> tuple[Broadcast, int]:
        """The trees as arrays, sent to the executors once, and the greatest depth."""
        if self._shared is None:
            # At most trees x (2 x sample rows - 1) nodes, whatever the data.
            table = self.nodes.orderBy("tree", "node").toPandas()
            trees = []
            for _, tree in table.groupby("tree", sort=True):
                leaf_path = tree["depth"].to_numpy() + average_path(tree["size"].to_numpy())
                arrays = [tree[c].to_numpy() for c in ("feature", "threshold", "left", "right")]
                trees.append((*arrays, leaf_path))
            shared = self.nodes.sparkSession.sparkContext.broadcast(trees)
            self._shared = (shared, int(table["depth"].max()))
        return self._shared

    def _raw_scores(self, df: DataFrame) -> DataFrame:
        """Add ``raw_score`` = -2^(-E[path] / c(sample)); lower is more anomalous."""
        if self.nodes is None or self.scaler is None:
            raise NotFittedError("anomaly model is not fitted: fit it first")
        shared, depth = self._forest()
        centre = np.array([self.scaler[f][0] for f in WINDOW_FEATURES])
        spread = np.array([self.scaler[f][1] for f in WINDOW_FEATURES])
        scale = float(average_path(np.array([self.sample_rows]))[0])

        @F.pandas_udf("double")
        def score(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for parts in columns:
                x = (np.column_stack([p.to_numpy(dtype=float) for p in parts]) - centre) / spread
                rows = np.arange(len(x))
                total = np.zeros(len(x))
                for feature, threshold, left, right, leaf_path in shared.value:
                    at = np.zeros(len(x), dtype=np.int64)
                    for _ in range(depth):
                        split = feature[at]
                        inner = split >= 0
                        goes_left = x[rows, np.maximum(split, 0)] <= threshold[at]
                        at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
                    total += leaf_path[at]
                yield pd.Series(-np.power(2.0, -(total / len(shared.value)) / scale))

        return df.withColumn("raw_score", score(*WINDOW_FEATURES))

    def score(self, windows: DataFrame) -> DataFrame:
        """Add ``anomaly_score`` (rounded to 4 places, higher is worse) and ``is_anomaly``."""
        scored = self._raw_scores(windows)
        gap = F.lit(self.offset) - F.col("raw_score")
        return scored.withColumns({"anomaly_score": F.round(gap, 4), "is_anomaly": gap > 0}).drop("raw_score")

    def save(self, path: str) -> None:
        if self.nodes is None or self.scaler is None:
            raise NotFittedError("there is no fitted model to save")
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        rows = [
            (f, m, s, self.sample_rows, self.offset, self.baseline_rows) for f, (m, s) in self.scaler.items()
        ]
        schema = "feature string, mean double, deviation double, sample_rows int, offset double, baseline_rows long"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark, path: str) -> WindowAnomalyModel:
        rows = spark.read.parquet(f"{path}/model").collect()  # one row per feature
        scaler = {r["feature"]: (r["mean"], r["deviation"]) for r in rows}
        first = rows[0]
        nodes = spark.read.parquet(f"{path}/nodes")
        return cls(scaler, nodes, first["sample_rows"], first["offset"], first["baseline_rows"])


def flag_by_share(df: DataFrame, score: str = "raw_score", share: float = CONTAMINATION) -> DataFrame:
    """Flag rows whose raw score lies below the ``share`` quantile.

    The rows are written once: every round of the quantile and the flags read the same.
    """
    df = materialize(df, "scores")
    offset = exact_quantile(df, score, share)
    return df.withColumn("is_anomaly", F.col(score) < F.lit(offset))
