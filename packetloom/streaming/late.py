"""Late rows of a stream: told apart before any stateful operator, written to a table of their own and counted.

Spark drops rows behind the watermark without a trace but a number.  ``route`` stands before the stateful operators: it
follows the same rule on its own (the greatest event time of earlier batches less the delay), hands rows in time on to
a folder that they read as a stream, and writes the others to a table.  Nothing is lost between the two: what a
downstream operator with the same delay gets is never late for it, because its watermark follows the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetloom.streaming.sinks import is_written, write_batch

MARK_SCHEMA = "top_us long, rows long, late long"


def route(
    stream: DataFrame, checkpoint: str, in_time_path: str, late_path: str, mark_path: str, delay_us: int, ts: str = "ts",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Split a stream with event time ``ts`` into rows in time and late ones.

    Each batch reads one row of the batch before (the greatest event time so far) and leaves one: its own top, its rows
    and its late rows.  A batch that is run again after a failure finds what it has already written and leaves it, so
    readers of ``in_time_path`` see every row once.  Rows without event time count as late.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        top = top_before(spark, mark_path, batch_id)
        us = F.unix_micros(ts)
        late = us.isNull() if top is None else F.coalesce(us < F.lit(top - delay_us), F.lit(True))
        rows = batch.withColumn("__late", late).persist()
        for flag, path in ((False, in_time_path), (True, late_path)):
            if not is_written(spark, path, batch_id):
                write_batch(rows.where(F.col("__late") == flag).drop("__late"), path, batch_id)
        counts = rows.agg(
            F.greatest(F.max(us), F.lit(top).cast("long")).alias("top_us"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if("__late").alias("late"),
        )
        write_batch(counts.coalesce(1), mark_path, batch_id)
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def top_before(spark: SparkSession, mark_path: str, batch_id: int) -> int | None:
    """The greatest event time of the batches before this one."""
    if batch_id == 0:
        return None
    row = spark.read.schema(MARK_SCHEMA).parquet(f"{mark_path}/batch_id={batch_id - 1}").first()
    return row["top_us"]


def late_rows(spark: SparkSession, late_path: str) -> DataFrame:
    """The late rows of all batches, with their ``batch_id``."""
    return spark.read.parquet(late_path)


def late_counts(spark: SparkSession, mark_path: str) -> DataFrame:
    """batch_id, rows, late of every batch."""
    return spark.read.schema(f"{MARK_SCHEMA}, batch_id long").parquet(mark_path).select("batch_id", "rows", "late")
