"""Live feature records: schema check, metadata, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.labels import prediction_columns
from packetloom.operators.rolling import connection_features
from packetloom.schemas import CATEGORICAL_FEATURES, FILE_ACTIVITY_COLUMNS, REQUIRED_FEATURES


class MissingFeaturesError(ValueError):
    """Raised when records lack required feature columns."""


def project_records(df: DataFrame, dataset: str = "nsl", keep: list[str] | None = None) -> DataFrame:
    """Required columns in order, plus ``keep``; other columns are dropped."""
    required = REQUIRED_FEATURES[dataset]
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise MissingFeaturesError(f"records missing features: {missing}")
    return df.select(*required, *[c for c in keep or [] if c not in required])


def flow_meta() -> Column:
    """The side-car that windowing reads: who talked to whom, how it ended, how much."""
    return F.struct(
        "src_ip", "dst_ip", "dst_port", "flag", (F.col("src_bytes") + F.col("dst_bytes")).alias("bytes")
    )


def flow_records(conns: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """32-feature records of connections, with display columns and ``meta``."""
    return conns.select(
        *(keep or []),
        "features.*",
        F.col("proto").alias("protocol_type"),
        "service",
        "flag",
        flow_meta().alias("meta"),
    )


def connection_feature_records(
    conns: DataFrame, by: list[str] | None = None, keep: list[str] | None = None, **options
) -> DataFrame:
    """41-feature records of numbered connections, with ``meta``."""
    return connection_features(conns, by, keep=[*(keep or []), flow_meta().alias("meta")], **options)


def has_file_activity(columns: list[str]) -> Column:
    def some(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) > 0 if name in columns else F.lit(False)

    return some("num_file_creations") | some("num_access_files")


def live_events(scored: DataFrame, dataset: str, classes: list[str], keep: list[str]) -> DataFrame:
    """Event rows of scored records; columns the feature set lacks are null."""
    cols = scored.columns

    def column(name: str, kind: str) -> Column:
        value = F.col(name) if name in cols else F.lit(None)
        return value.cast(kind).alias(name)

    return scored.select(
        *keep,
        F.lit(dataset).alias("dataset"),
        *[column(c, "string") for c in CATEGORICAL_FEATURES],
        *[column(c, "double") for c in FILE_ACTIVITY_COLUMNS],
        has_file_activity(cols).alias("has_file_activity"),
        *[c.alias(n) for n, c in prediction_columns(F.col("prediction"), classes).items()],
    )


def attack_log_rows(events: DataFrame) -> DataFrame:
    """Attacks with the time of logging, ISO-8601 in UTC, and its date for partitioning."""
    now = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return events.where("is_attack").select(
        "*",
        F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("logged_at"),
        F.to_date(now).alias("log_date"),
    )
