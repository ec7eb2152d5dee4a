"""Newest-first views over the event, attack and anomaly tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def _newest(df: DataFrame, limit: int, order: str) -> DataFrame:
    if limit < 1:
        raise ValueError(f"a view shows one row at least, not {limit}")
    # Every task keeps its newest rows; only these meet.
    return df.orderBy(F.desc(order)).limit(limit)


def live_recent(events: DataFrame, limit: int = 50, order: str = "seq") -> DataFrame:
    """Newest scored events."""
    return _newest(events, limit, order)


def attack_log(log: DataFrame, limit: int = 100, files_only: bool = False, order: str = "seq") -> DataFrame:
    """Newest logged attacks; ``files_only`` keeps those that touched files."""
    return _newest(log.where("has_file_activity") if files_only else log, limit, order)


def anomalies_recent(
    scored: DataFrame, limit: int = 50, anomalies_only: bool = False, order: str = "seq"
) -> DataFrame:
    """Newest scored windows; with ``anomalies_only`` the newest anomalies, however far back they lie."""
    return _newest(scored.where("is_anomaly") if anomalies_only else scored, limit, order)


def view_counts(rows: DataFrame, flag: str, name: str) -> DataFrame:
    """count and number of flagged rows of a view."""
    return rows.agg(F.count(F.lit(1)).alias("count"), F.count_if(F.col(flag)).alias(name))


def anomaly_status(baseline: DataFrame, open_windows: DataFrame, model_loaded: bool, seconds: int) -> DataFrame:
    """model_loaded, window_seconds, baseline_windows_captured, windows_open."""
    at = F.lit(0).alias("at")
    rows = baseline.agg(F.count(F.lit(1)).alias("baseline_windows_captured")).select("*", at)
    still = open_windows.select(F.col("open_windows").alias("windows_open"), at)
    return rows.join(still, "at").select(
        F.lit(model_loaded).alias("model_loaded"),
        F.lit(seconds).alias("window_seconds"),
        "baseline_windows_captured",
        "windows_open",
    )
