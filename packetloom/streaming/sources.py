"""Stream sources: packet files and live feature records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.schemas import PACKET_SCHEMA, live_record_schema

# Fixed value: records per batch that the live endpoint accepts at most.
MAX_FILES_PER_BATCH = 10


def packet_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", max_files: int = MAX_FILES_PER_BATCH, sensors: bool = False
) -> DataFrame:
    """Packet rows with the event-time column ``ts`` (and their ``sensor``) from files that arrive in ``path``."""
    schema = T.StructType(PACKET_SCHEMA.fields + [T.StructField("sensor", T.StringType())] * sensors)
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files)
    return reader.load(path).withColumn("ts", F.timestamp_micros("us"))


def live_records(
    spark: SparkSession, path: str, dataset: str = "nsl", fmt: str = "json", max_files: int = MAX_FILES_PER_BATCH
) -> DataFrame:
    """Feature records with optional ``meta``, ``ts`` and ``seq`` for one feature set."""
    schema = live_record_schema(dataset).add("ts", "timestamp").add("seq", "long")
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(path)
