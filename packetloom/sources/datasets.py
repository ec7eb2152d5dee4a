"""Labelled connection files and daily flow files."""

from __future__ import annotations

import csv
import functools
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.labels import trimmed
from packetloom.schemas import FLOW_COLUMN_NAMES, FLOW_FEATURES, LABELLED_CONNECTION_SCHEMA

# Published row counts of the two connection splits, column count.
SPLIT_ROWS = {"train": 125_973, "test": 22_544}
RAW_COLUMNS = 43
# The JVM's name of latin1.
_ENCODING = "ISO-8859-1"
_NUMBERS = "__numbers"
# Every file becomes one task, however large or small (1 PB), and its lines reach the task few at a time.
_FILE_A_TASK = {
    "spark.sql.files.maxPartitionBytes": str(1 << 50),
    "spark.sql.files.openCostInBytes": str(1 << 50),
    "spark.sql.files.maxPartitionNum": str((1 << 31) - 1),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "16",
}


class ShapeError(ValueError):
    """Raised when a file set does not have the expected rows and columns."""


def read_connections(spark: SparkSession, path: str, drop_difficulty: bool = True) -> DataFrame:
    """Headerless CSV with 43 positional columns."""
    df = spark.read.schema(LABELLED_CONNECTION_SCHEMA).csv(path, header=False)
    return df.drop("difficulty") if drop_difficulty else df


def shape_check(df: DataFrame, name: str, rows: int, cols: int) -> DataFrame:
    """name, expected and actual rows and columns, ok."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(name).alias("name"),
        F.lit(rows).cast("bigint").alias("expected_rows"),
        "rows",
        F.lit(cols).alias("expected_cols"),
        F.lit(len(df.columns)).alias("cols"),
        ((F.col("rows") == rows) & F.lit(len(df.columns) == cols)).alias("ok"),
    )


def verify_split(df: DataFrame, split: str) -> DataFrame:
    """Fail unless the raw split has its published shape; returns ``df``."""
    if split not in SPLIT_ROWS:
        raise ValueError(f"{split!r} is none of the splits {', '.join(SPLIT_ROWS)}")
    found = shape_check(df, split, SPLIT_ROWS[split], RAW_COLUMNS).first()
    if not found["ok"]:
        raise ShapeError(
            f"split {split} has {found['rows']} rows of {found['cols']} columns,"
            f" not {found['expected_rows']} of {found['expected_cols']}"
        )
    return df


def watched_split(df: DataFrame, split: str) -> tuple[DataFrame, Callable[[], None]]:
    """The split with its rows counted while it is first used, and a check to call after that.

    Saves the scan that ``verify_split`` takes.
    """
    if split not in SPLIT_ROWS:
        raise ValueError(f"{split!r} is none of the splits {', '.join(SPLIT_ROWS)}")
    seen, columns = Observation(f"split-{split}"), len(df.columns)

    def check() -> None:
        rows = seen.get["rows"]
        if (rows, columns) != (SPLIT_ROWS[split], RAW_COLUMNS):
            raise ShapeError(f"split {split} has {rows} rows of {columns} columns, not {SPLIT_ROWS[split]} of {RAW_COLUMNS}")

    return df.observe(seen, F.count(F.lit(1)).alias("rows")), check


def first_lines(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(path, line): the first line that is not blank of every file below ``folder``; files without one are left out.

    One job for any number of files: every file is one task, which ends after its first lines.
    """
    own = spark.newSession()
    for key, value in _FILE_A_TASK.items():
        own.conf.set(key, value)
    lines = own.read.options(pathGlobFilter=pattern, recursiveFileLookup=True).text(folder)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, line in enumerate(batch.column(1).to_pylist()):
                if line.strip():
                    yield batch.slice(i, 1)
                    return

    # The text reader hands bytes on as they are.
    line = F.decode(F.col("value").cast("binary"), _ENCODING).alias("line")
    return lines.select(F.col("_metadata.file_path").alias("path"), line).mapInArrow(first, "path string, line string")


def read_flows_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Daily flow CSVs as text columns named like the features, plus ``label`` and ``file``.

    Columns are matched by trimmed header name in each file, so files may order them differently; of columns of one name
    the first counts.  Files of one header share a scan; a file without any line adds no rows.
    """
    layouts: dict[tuple[str, ...], list[str]] = {}
    # One row a file, as many as the scans below are given paths.
    for found in first_lines(spark, folder).orderBy("path").collect():
        header = next(csv.reader([found["line"]], skipinitialspace=True))
        # File metadata give paths in their encoded form, readers take plain ones.
        layouts.setdefault(tuple(c.strip() for c in header), []).append(unquote(found["path"]))
    if not layouts:
        raise FileNotFoundError(f"no CSV files with a header under {folder}")
    return functools.reduce(DataFrame.unionByName, [_read_days(spark, h, p) for h, p in layouts.items()])


def _flow_reader(spark: SparkSession) -> DataFrameReader:
    return spark.read.options(header=True, encoding=_ENCODING, ignoreLeadingWhiteSpace=True)


def _read_days(spark: SparkSession, header: tuple[str, ...], paths: list[str]) -> DataFrame:
    at = {c: i for i, c in reversed(list(enumerate(header)))}
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header))])
    return _flow_reader(spark).schema(schema).csv(paths).select(
        *[F.col(f"c{at[theirs]}").alias(ours) for ours, theirs in FLOW_COLUMN_NAMES.items()],
        F.col(f"c{at['Label']}").alias("label"),
        F.col("_metadata.file_name").alias("file"),
    )


def to_number(value: Column) -> Column:
    """A double, null where the text is no number (Java's type suffixes, as in ``5d``, make no number)."""
    text = F.trim(value.cast("string"))
    return F.when(~text.rlike(r"(?i)[0-9.][df]$"), text.try_cast("double"))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def clean_flows(df: DataFrame, columns: list[str] | None = None, duration: str | None = "flow_duration") -> DataFrame:
    """Numbers only: rows with a null, NaN or infinite feature or a negative duration are dropped."""
    columns = columns or FLOW_FEATURES
    # All numbers are made once, as one array: as columns, the filter would be pushed below them and repeat each.
    numbers = F.transform(F.array(*[F.col(c).cast("string") for c in columns]), to_number)
    made = df.withColumn(_NUMBERS, numbers)
    value = {c: F.get(F.col(_NUMBERS), F.lit(i)) for i, c in enumerate(columns)}
    kept = F.forall(_NUMBERS, is_finite)
    if duration:
        kept = kept & ((value[duration] if duration in value else F.col(duration)) >= 0)
    label = {"label": trimmed(F.col("label"))} if "label" in df.columns and "label" not in columns else {}
    return made.where(kept).withColumns(value | label).drop(_NUMBERS)


def read_flows(spark: SparkSession, folder: str) -> DataFrame:
    """Cleaned flows of all days: 32 features, ``label`` and ``file``."""
    return clean_flows(read_flows_raw(spark, folder))


RAW_FLOW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in FLOW_FEATURES] + [T.StructField("label", T.StringType())]
)
