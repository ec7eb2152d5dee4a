"""Batch jobs: train on the labelled datasets, mine rules, fit the anomaly model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.labels import flow_category, require_known, unknown_flow_labels
from packetloom.operators.clusters import kmeans_sweep
from packetloom.operators.encode import connection_encoder, flow_encoder
from packetloom.operators.iforest import WindowAnomalyModel
from packetloom.operators.models import MODEL_NAMES, train_models
from packetloom.operators.patterns import mine_rules
from packetloom.operators.sampling import stratified_split
from packetloom.session import materialize
from packetloom.sources.artifacts import ArtifactStore
from packetloom.sources.datasets import read_connections, read_flows
from packetloom.sources.logs import read_baseline


def train_connection_models(
    spark: SparkSession, train_path: str, test_path: str, store: ArtifactStore, models=MODEL_NAMES, **sizes: int
) -> DataFrame:
    """Encoder, all classifiers and their metrics on the fixed test split."""
    train, test = read_connections(spark, train_path), read_connections(spark, test_path)
    encoder = connection_encoder().fit(train)
    store.save_encoder(encoder, "nsl")
    return _train(train, test, encoder, store, "nsl", models, sizes)


def train_flow_models(
    spark: SparkSession, folder: str, store: ArtifactStore, models=MODEL_NAMES, **sizes: int
) -> DataFrame:
    """The same on the flow files, with a stratified 70/30 split.

    The split is by category; rows get a number once, which the split hashes.
    """
    rows = read_flows(spark, folder).drop("file")
    keyed = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "flows")
    require_known(unknown_flow_labels(keyed))
    train, test = stratified_split(keyed.withColumn("category", flow_category(F.col("label"))), "category", "row_id")
    encoder = flow_encoder().fit(train)
    store.save_encoder(encoder, "cic")
    return _train(train, test, encoder, store, "cic", models, sizes)


def _train(train, test, encoder, store, dataset, models, sizes) -> DataFrame:
    def save(fitted, name, phase):
        return store.save_model(fitted, name, phase, dataset)

    store.save_metrics(train_models(train, test, encoder, dataset, save, models, **sizes), dataset)
    return store.load_metrics(dataset, "binary").unionByName(store.load_metrics(dataset, "multiclass"))


def sweep_clusters(spark: SparkSession, train_path: str, store: ArtifactStore, **options) -> int:
    """K-means sweep over the encoded training connections; returns the best k."""
    rows = store.load_encoder("nsl").transform(read_connections(spark, train_path))
    keyed = materialize(rows.select("vector", F.monotonically_increasing_id().alias("row_id")), "sweep-rows")
    sweep, best, model = kmeans_sweep(keyed, "row_id", **options)
    store.save_sweep(sweep)
    if model is not None:
        store.save_clusters(model)
    return best


def build_rules(spark: SparkSession, train_path: str, store: ArtifactStore) -> DataFrame:
    """Mine the top rules of the training connections and save them."""
    store.save_rules(mine_rules(read_connections(spark, train_path)))
    return store.load_rules()


def train_anomaly_model(spark: SparkSession, baseline_path: str, model_path: str, **options) -> WindowAnomalyModel:
    """Fit the window model on the captured baseline and save it."""
    model = WindowAnomalyModel.fit(read_baseline(spark, baseline_path), **options)
    model.save(model_path)
    return model
