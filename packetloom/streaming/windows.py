"""Source windows over the live stream: baseline capture and anomaly scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetloom.operators.iforest import WindowAnomalyModel
from packetloom.operators.windows import WINDOW_SECONDS, stream_windows
from packetloom.sources.logs import baseline_rows
from packetloom.streaming.sinks import write_batch


def record_meta(records: DataFrame) -> DataFrame:
    """Window input of live records; those without ``meta`` are skipped."""
    return records.where(F.col("meta").isNotNull()).select("ts", "meta.*")


def capture_windows(
    meta: DataFrame,
    checkpoint: str,
    baseline_path: str,
    delay: str,
    anomaly_path: str | None = None,
    model: WindowAnomalyModel | None = None,
    seconds: int = WINDOW_SECONDS,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append every closed window to the baseline and, with a model, its score to the anomaly table."""

    def on_batch(closed: DataFrame, batch_id: int) -> None:
        closed = closed.persist()
        write_batch(baseline_rows(closed), baseline_path, batch_id, "json")
        if model is not None and anomaly_path:
            write_batch(model.score(closed), anomaly_path, batch_id)
        closed.unpersist()

    stream = stream_windows(meta, delay, seconds)
    writer = stream.writeStream.outputMode("append").foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()
