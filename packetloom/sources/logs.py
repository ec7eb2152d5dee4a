"""Append-only logs: attack log and window baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.layout import dense_sequence
from packetloom.schemas import WINDOW_FEATURES, WINDOW_SCHEMA

def append_log(df: DataFrame, path: str, fmt: str = "json", partition: str | None = None) -> None:
    writer = df.write.mode("append").format(fmt)
    if partition:
        writer = writer.partitionBy(partition)
    writer.save(path)


def append_dated(df: DataFrame, path: str, date: str = "log_date", fmt: str = "parquet") -> None:
    """Append to a log with one folder for each date, so that newest-first readers open few of them."""
    append_log(df, path, fmt, partition=date)


def read_newest(
    spark: SparkSession, path: str, rows: int, order: list[str], date: str = "log_date", where: Column | None = None, fmt: str = "parquet"
) -> DataFrame:
    """The newest ``rows`` rows (that meet ``where``) of a dated log, newest first.

    Reads back in time, twice as many dates in each step, until there are enough rows; earlier dates are not opened.
    Dates come first in the order, then ``order``, each descending.
    """
    if rows < 1:
        raise ValueError(f"a view shows one row at least, not {rows}")
    log = spark.read.format(fmt).load(path)
    log = log if where is None else log.where(where)
    dates = [r[0] for r in spark.read.format(fmt).load(path).select(date).distinct().orderBy(F.desc(date)).collect()]
    span = 1
    while True:
        # One date for each day of the log; they are literals, so that only their folders are read.
        part = log.where(F.col(date).isin(dates[:span]) | (F.lit(None in dates[:span]) & F.col(date).isNull()))
        if span >= len(dates) or part.limit(rows).count() == rows:
            return part.orderBy(F.desc(date), *[F.desc(c) for c in order]).limit(rows)
        span *= 2


def append_baseline(windows: DataFrame, path: str) -> None:
    """Append window rows as JSON lines, ``window_start`` in epoch seconds."""
    append_log(baseline_rows(windows), path)


def baseline_rows(windows: DataFrame) -> DataFrame:
    start = (F.col("window_start_us") / 1e6).alias("window_start")
    return windows.select("src_ip", start, *WINDOW_FEATURES)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """Baseline windows with a ``window_id``; blank lines are skipped."""
    rows = read_json_log(spark, path, WINDOW_SCHEMA)
    return rows.withColumn("window_id", F.xxhash64("src_ip", "window_start"))


def read_json_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    parsed = spark.read.schema(schema).json(path)
    present = [F.col(f.name).isNotNull() for f in schema.fields]
    some = present[0]
    for p in present[1:]:
        some = some | p
    return parsed.where(some)


def log_size(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a log."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def retain_newest(rows: DataFrame, keep_rows: int, order: str = "seq", log: str = "log") -> DataFrame:
    """The newest ``keep_rows`` rows of each log.

    Spark keeps only ``keep_rows`` rows per log and task before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(log).orderBy(F.desc(order)))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= keep_rows).drop("_rank")


def compact_log(
    spark: SparkSession,
    path: str,
    target: str,
    schema: T.StructType,
    order: list[str],
    *,
    max_bytes: int,
    keep_rows: int,
) -> int | None:
    """Write the newest rows of an oversized log to a new version directory.

    Both bounds are the caller's policy.  Returns how many rows were left out; None if the log is not too large.
    """
    if log_size(spark, path) <= max_bytes:
        return None
    rows = read_json_log(spark, path, schema)
    newest = rows.orderBy(*[F.desc(c) for c in order]).limit(keep_rows)
    newest.write.mode("errorifexists").json(target)
    return max(0, rows.count() - keep_rows)


def numbered(log: DataFrame, order: list[str]) -> DataFrame:
    """Give log rows a dense ``seq`` in ``order`` for the newest-first views."""
    return dense_sequence(log, order)
