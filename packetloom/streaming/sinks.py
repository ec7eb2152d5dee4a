"""Sinks that write each micro-batch once, also when it is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_batch(df: DataFrame, path: str, batch_id: int, fmt: str = "parquet") -> None:
    """A batch owns the directory ``batch_id=N``; a replay replaces it."""
    df.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")


def is_written(spark: SparkSession, path: str, batch_id: int) -> bool:
    """Whether the batch's directory is complete (its writer has left the mark of success)."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch_id}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
