"""Persisted models, encoders, metrics and rules."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import NaiveBayesModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.clusters import ClusterModel
from packetloom.operators.encode import FeatureEncoder
from packetloom.operators.models import MODEL_NAMES, PHASES, check_names
from packetloom.operators.patterns import REPORTED_RULES
from packetloom.operators.trees import TreeModel
from packetloom.schemas import CATEGORICAL_FEATURES, FLOW_FEATURES, NUMERIC_FEATURES

RULE_SCHEMA = "antecedents string, consequents string, support double, confidence double, lift double"
METRIC_SCHEMA = "phase string, model string, accuracy double, precision double, recall double, f1 double"
SWEEP_SCHEMA = "k int, inertia double, silhouette double"


class MissingArtifactError(FileNotFoundError):
    """Raised when a model, encoder or report has not been written yet."""


class ArtifactStore:
    """Models and reports below one folder, looked up by (dataset, model, phase)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def model_path(self, model: str, phase: str, dataset: str = "nsl") -> str:
        check_names(model, phase, dataset)
        return f"{self.root}/{dataset}/{model}_{phase}"

    def save_model(self, fitted: Model | TreeModel, model: str, phase: str, dataset: str = "nsl") -> str:
        path = self.model_path(model, phase, dataset)
        if isinstance(fitted, TreeModel):
            fitted.save(path)
        else:
            fitted.write().overwrite().save(path)
        return path

    def load_model(self, model: str, phase: str, dataset: str = "nsl") -> Model | TreeModel:
        path = self.model_path(model, phase, dataset)
        self._require(f"{path}/metadata", f"model {dataset}/{model}_{phase}")
        return NaiveBayesModel.load(path) if model == "nb" else TreeModel.load(self.spark, path)

    def available(self, dataset: str = "nsl") -> list[tuple[str, str]]:
        """(model, phase) pairs that can be loaded."""
        names = [(m, p) for m in MODEL_NAMES for p in PHASES]
        return [(m, p) for m, p in names if self._exists(f"{self.model_path(m, p, dataset)}/metadata")]

    def save_encoder(self, encoder: FeatureEncoder, dataset: str = "nsl") -> None:
        encoder.save(f"{self.root}/{dataset}/encoder")

    def load_encoder(self, dataset: str = "nsl") -> FeatureEncoder:
        path = f"{self.root}/{dataset}/encoder"
        self._require(f"{path}/metadata", f"encoder of {dataset}")
        numeric = NUMERIC_FEATURES if dataset == "nsl" else FLOW_FEATURES
        return FeatureEncoder.load(path, numeric, CATEGORICAL_FEATURES if dataset == "nsl" else None)

    def save_metrics(self, metrics: DataFrame, dataset: str) -> None:
        metrics.coalesce(1).write.mode("overwrite").json(f"{self.root}/{dataset}/metrics")

    def load_metrics(self, dataset: str, phase: str) -> DataFrame:
        path = f"{self.root}/{dataset}/metrics"
        self._require(path, f"metrics of {dataset}")
        return self.spark.read.schema(METRIC_SCHEMA).json(path).where(F.col("phase") == phase)

    def save_sweep(self, sweep: DataFrame) -> None:
        sweep.coalesce(1).write.mode("overwrite").json(f"{self.root}/kmeans_sweep")

    def load_sweep(self) -> DataFrame:
        self._require(f"{self.root}/kmeans_sweep", "k-means sweep")
        return self.spark.read.schema(SWEEP_SCHEMA).json(f"{self.root}/kmeans_sweep")

    def save_clusters(self, fitted: ClusterModel) -> None:
        fitted.save(self.spark, f"{self.root}/kmeans")

    def load_clusters(self) -> ClusterModel:
        self._require(f"{self.root}/kmeans", "k-means model")
        return ClusterModel.load(self.spark, f"{self.root}/kmeans")

    def save_rules(self, rules: DataFrame) -> None:
        """Write at most the top rules; one file keeps the order readable."""
        rules.coalesce(1).write.mode("overwrite").csv(f"{self.root}/rules", header=True)

    def load_rules(self, n: int = REPORTED_RULES) -> DataFrame:
        self._require(f"{self.root}/rules", "rules")
        rules = self.spark.read.schema(RULE_SCHEMA).csv(f"{self.root}/rules", header=True)
        return rules.orderBy(F.desc("lift"), F.desc("confidence"), "antecedents", "consequents").limit(n)

    def _exists(self, path: str) -> bool:
        # Spark resolves the path on whatever file system the folder lives on.
        try:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
            return not files.select("path").limit(1).isEmpty()
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(error):
                return False
            raise

    def _require(self, path: str, what: str) -> None:
        if not self._exists(path):
            raise MissingArtifactError(f"{what} not found at {path}: train and save it first")
