"""Per-source tumbling windows over connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.rounding import ratio, round_ratio

# States that count as failed; window length.
FAILED_FLAGS = ["S0", "S1", "S2", "S3", "REJ", "RSTO", "RSTR", "SH", "OTH"]
WINDOW_SECONDS = 60
# Precision of distinct-count sketches.
SKETCH_BITS = 13


def window_start_us(ts_us: Column, seconds: int = WINDOW_SECONDS) -> Column:
    return ts_us - F.pmod(ts_us, F.lit(seconds * 1_000_000))


def _aggregates(distinct: str) -> list[Column]:
    count = {
        "exact": F.count_distinct,
        "approx": F.approx_count_distinct,
    }[distinct]
    return [
        F.count(F.lit(1)).alias("flow_count"),
        count(F.col("dst_port")).cast("bigint").alias("distinct_dst_ports"),
        count(F.col("dst_ip")).cast("bigint").alias("distinct_dst_hosts"),
        F.count_if(F.col("flag").isin(FAILED_FLAGS)).alias("failed"),
        F.sum(F.coalesce("bytes", F.lit(0))).alias("total_bytes"),
    ]


def _derived(df: DataFrame, digits: bool) -> DataFrame:
    hosts = F.greatest(F.col("distinct_dst_hosts"), F.lit(1))

    def per(part: str, whole: Column, places: int) -> Column:
        return round_ratio(F.col(part), whole, places) if digits else ratio(F.col(part), whole)

    return df.withColumns(
        {
            "failed_ratio": per("failed", F.col("flow_count"), 4),
            "ports_per_host": per("distinct_dst_ports", hosts, 4),
            "mean_bytes": per("total_bytes", F.col("flow_count"), 2),
        }
    )


def source_windows(
    meta: DataFrame, seconds: int = WINDOW_SECONDS, distinct: str = "exact", digits: bool = True
) -> DataFrame:
    """Window features per source: src_ip, window_start_us and the seven features.

    ``meta``: ts_us, src_ip, dst_ip, dst_port, flag, bytes; rows without a
    source are skipped.  Exact distinct counts first combine per value, spread
    over all tasks, so one busy source does not land in one task;
    ``distinct="approx"`` replaces them by sketches.
    """
    keyed = meta.where(F.col("src_ip") != "").withColumn("window_start_us", window_start_us(F.col("ts_us"), seconds))
    rows = keyed.groupBy("src_ip", "window_start_us").agg(*_aggregates(distinct))
    return _derived(rows, digits)


def window_sketches(meta: DataFrame, seconds: int = WINDOW_SECONDS, bits: int = SKETCH_BITS) -> DataFrame:
    """Windows that can be united later: counts and sums, and sketches in place of distinct counts.

    A sketch has a fixed size (some 2 ** bits bytes at most), whatever it has seen.  Kept for each minute, longer windows need
    the rows no more.
    """
    keyed = meta.where(F.col("src_ip") != "").withColumn("window_start_us", window_start_us(F.col("ts_us"), seconds))
    return keyed.groupBy("src_ip", "window_start_us").agg(
        F.count(F.lit(1)).alias("flow_count"),
        F.hll_sketch_agg("dst_port", bits).alias("port_sketch"),
        F.hll_sketch_agg("dst_ip", bits).alias("host_sketch"),
        F.count_if(F.col("flag").isin(FAILED_FLAGS)).alias("failed"),
        F.sum(F.coalesce("bytes", F.lit(0))).alias("total_bytes"),
    )


def united_sketches(sketches: DataFrame, seconds: int) -> DataFrame:
    """Sketched windows of ``seconds`` from shorter ones (whose length divides it)."""
    longer = sketches.withColumn("window_start_us", window_start_us(F.col("window_start_us"), seconds))
    sums = [F.sum(c).alias(c) for c in ("flow_count", "failed", "total_bytes")]
    unions = [F.hll_union_agg(c).alias(c) for c in ("port_sketch", "host_sketch")]
    return longer.groupBy("src_ip", "window_start_us").agg(*sums, *unions)


def sketched_windows(sketches: DataFrame, digits: bool = True) -> DataFrame:
    """The window features of sketched windows; distinct counts are estimates.

    Their relative error is about 0.83 / sqrt(2 ** bits) in one standard deviation: 0.9 % at 13 bits, and small counts
    are exact.
    """
    counts = sketches.withColumns(
        {f"distinct_dst_{n}s": F.coalesce(F.hll_sketch_estimate(f"{n}_sketch"), F.lit(0)) for n in ("port", "host")}
    )
    return _derived(counts.drop("port_sketch", "host_sketch"), digits)


def stream_windows(meta: DataFrame, delay: str, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """The same windows over a stream with an event-time column ``ts``.

    Rows may come late by up to ``delay``; later ones are dropped.  In append mode each window is emitted once, when
    the watermark passes its end; the newest windows stay open.  Distinct ports and hosts are counted by a first
    aggregate with one small state row per source and value, so a scanning source is spread over all tasks and no
    set grows in one row.
    """
    keyed = meta.where(F.col("src_ip") != "").withWatermark("ts", delay)
    cell = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    cells = F.array(cell("all", F.lit("")), cell("port", F.col("dst_port")), cell("host", F.col("dst_ip")))
    rows = keyed.select("ts", "src_ip", "flag", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.explode(cells).alias("cell"))
    whole = F.col("cell.kind") == "all"
    first = rows.groupBy(F.window("ts", f"{seconds} seconds"), "src_ip", "cell").agg(
        F.count_if(whole).alias("flows"),
        F.count_if(whole & F.col("flag").isin(FAILED_FLAGS)).alias("failed"),
        F.sum(F.when(whole, F.col("bytes"))).alias("bytes"),
    )
    seen = lambda kind: F.count_if((F.col("cell.kind") == kind) & F.col("cell.value").isNotNull())
    second = first.groupBy(F.window(F.window_time("window"), f"{seconds} seconds"), "src_ip").agg(
        F.sum("flows").alias("flow_count"),
        seen("port").alias("distinct_dst_ports"),
        seen("host").alias("distinct_dst_hosts"),
        F.sum("failed").alias("failed"),
        F.sum("bytes").alias("total_bytes"),
    )
    return _derived(second.withColumn("window_start_us", F.unix_micros("window.start")).drop("window"), True)


def closed_windows(windows: DataFrame, now_us: int, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Windows that have ended by ``now_us``."""
    return windows.where(F.col("window_start_us") + seconds * 1_000_000 <= now_us)


def open_window_count(meta: DataFrame, now_us: int, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """How many (source, window) pairs are still open at ``now_us``."""
    keyed = meta.where(F.col("src_ip") != "").select("src_ip", window_start_us(F.col("ts_us"), seconds).alias("start"))
    still = keyed.where(F.col("start") + seconds * 1_000_000 > now_us)
    return still.distinct().agg(F.count(F.lit(1)).alias("open_windows"))
