"""Live scoring: events, attack log and per-batch counts."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetloom.operators.encode import FeatureEncoder
from packetloom.operators.models import CLASS_NAMES
from packetloom.operators.records import attack_log_rows, live_events, project_records
from packetloom.operators.trees import TreeModel
from packetloom.schemas import CATEGORICAL_FEATURES
from packetloom.streaming.sinks import write_batch


def score_records(records: DataFrame, encoder: FeatureEncoder, model: Model | TreeModel, dataset: str = "nsl") -> DataFrame:
    """Event rows (with ``seq``, ``ts``, ``meta``) of feature records."""
    keep = ["seq", "ts", "meta"]
    known = project_records(records, dataset, [*keep, *CATEGORICAL_FEATURES])
    scored = model.transform(encoder.transform(known))
    return live_events(scored, dataset, CLASS_NAMES[(dataset, "binary")], keep)


def score_live(
    records: DataFrame,
    encoder: FeatureEncoder,
    model: Model | TreeModel,
    checkpoint: str,
    event_path: str,
    log_path: str,
    count_path: str | None = None,
    dataset: str = "nsl",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score each micro-batch once and write events, attacks and (optionally) counts."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        events = score_records(batch, encoder, model, dataset).persist()
        write_batch(events, event_path, batch_id)
        write_batch(attack_log_rows(events), log_path, batch_id)
        if count_path:
            counts = events.agg(F.count(F.lit(1)).alias("count"), F.count_if("is_attack").alias("attacks"))
            write_batch(counts, count_path, batch_id)
        events.unpersist()

    writer = records.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
