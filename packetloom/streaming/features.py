"""The 41 rolling features over a stream of connections.

Row-ranged frames do not exist on streams, so each micro-batch is joined to the
connections before it.  Frames look back at most ``HISTORY`` connections per
sensor: that many rows are carried from batch to batch in a table, and the
batch operator does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetloom.operators.records import connection_feature_records
from packetloom.operators.rolling import HISTORY
from packetloom.session import remove_path
from packetloom.sources.logs import retain_newest
from packetloom.streaming.sinks import write_batch

CARRIED = [
    "sensor", "seq", "conn_id", "ts_us", "duration", "proto", "service", "flag", "src_ip", "src_port", "dst_ip", "dst_port",
    "src_bytes", "dst_bytes", "land", "wrong_fragment", "urgent",
]


def batch_features(batch: DataFrame, history: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(records of the batch with ``meta``, rows to carry on).

    New connections are numbered after those carried, in completion order, and
    may end before earlier ones: the arrival-order counts apply.
    """
    # A micro-batch is bounded by the trigger, so its rows can be ranked directly.
    place = F.row_number().over(Window.partitionBy("sensor").orderBy("ts_us", "conn_id")).cast("bigint") - 1
    new = batch.withColumn("seq", place).select(*CARRIED, F.lit(True).alias("fresh"))
    if history is not None:
        ends = history.groupBy("sensor").agg(F.max("seq").alias("last"))
        after = F.col("seq") + F.coalesce(F.col("last") + 1, F.lit(0))
        new = new.join(ends, "sensor", "left").withColumn("seq", after)
        known = history.select(*CARRIED, F.lit(False).alias("fresh"))
        rows = known.unionByName(new.select(*CARRIED, "fresh"))
    else:
        rows = new.select(*CARRIED, "fresh")
    records = connection_feature_records(rows, ["sensor"], ["conn_id", "ts_us", "fresh"], arrival_order=True)
    return records.where("fresh").drop("fresh"), retain_newest(rows.select(*CARRIED), HISTORY, log="sensor")


def stream_features(
    conns: DataFrame, checkpoint: str, record_path: str, carry_path: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write the feature records of each micro-batch of connections (with a ``sensor`` column).

    A replayed batch reads the carry of the batch before it again and replaces
    its own outputs, so the result does not depend on failures.
    """
    spark = conns.sparkSession

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        history = _carry(spark, carry_path, batch_id - 1)
        batch = batch.persist()
        records, carry = batch_features(batch, history)
        write_batch(records, record_path, batch_id)
        write_batch(carry, carry_path, batch_id)
        # A replay needs the carry before its own; older ones are of no use.
        remove_path(spark, f"{carry_path}/batch_id={batch_id - 2}")
        batch.unpersist()

    writer = conns.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()


def _carry(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    return spark.read.parquet(f"{path}/batch_id={batch_id}") if batch_id >= 0 else None
