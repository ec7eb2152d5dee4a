"""Source windows: hand numbers, closing, skew and plan."""

import pytest
from pyspark.sql import functions as F

from packetloom.operators import windows
from packetloom.plans.views import connection_view

SCHEMA = "src_ip string, ts_us long, dst_ip string, dst_port int, flag string, bytes long"


def meta(spark, rows):
    return spark.createDataFrame([(s, int(t * 1e6), d, p, f, b) for s, t, d, p, f, b in rows], SCHEMA)


def test_grouping_and_missing_source(spark):
    rows = [("A", 10, "d", 1, "SF", 1), ("A", 20, "d", 1, "SF", 1), ("B", 30, "d", 1, "SF", 1), ("A", 70, "d", 1, "SF", 1)]
    skipped = [("", 10, "d", 1, "SF", 1), (None, 10, "d", 1, "SF", 1)]
    assert windows.source_windows(meta(spark, rows + skipped)).count() == 3


def test_port_scan(spark):
    rows = [("A", 5, "d", port, "S0", None) for port in range(100)]
    (w,) = windows.source_windows(meta(spark, rows)).collect()
    got = (w.flow_count, w.distinct_dst_ports, w.distinct_dst_hosts, w.failed_ratio, w.ports_per_host, w.total_bytes)
    assert got == (100, 100, 1, 1.0, 100.0, 0)


def test_browsing_and_nulls(spark):
    rows = [("A", i, "d", 443, "SF", 5000) for i in range(5)]
    (w,) = windows.source_windows(meta(spark, rows)).collect()
    assert (w.distinct_dst_ports, w.failed_ratio, w.mean_bytes) == (1, 0.0, 5000.0)
    (w,) = windows.source_windows(meta(spark, [("A", 1, None, None, None, 10)])).collect()
    assert (w.distinct_dst_ports, w.distinct_dst_hosts, w.ports_per_host, w.failed_ratio) == (0, 0, 0.0, 0.0)


@pytest.mark.parametrize("flag, failed", [("S1", 1.0), ("RSTO", 1.0), ("OTH", 1.0), ("SH", 1.0), ("RSTOS0", 0.0), ("SF", 0.0)])
def test_failed_flags(spark, flag, failed):
    (w,) = windows.source_windows(meta(spark, [("A", 1, "d", 1, flag, 1)])).collect()
    assert w.failed_ratio == failed


def test_closing(spark):
    rows = meta(spark, [("A", 10, "d", 1, "SF", 1), ("A", 130, "d", 1, "SF", 1)])
    closed = windows.closed_windows(windows.source_windows(rows), 90_000_000).collect()
    assert [w.window_start_us for w in closed] == [0]
    assert windows.open_window_count(rows, 90_000_000).first()[0] == 1
    ordered = windows.source_windows(rows).orderBy("window_start_us").collect()
    assert [w.window_start_us for w in ordered] == [0, 120_000_000]


def test_rounding_is_half_even(spark):
    rows = [("A", i, "d", i, "S0" if i == 0 else "SF", 1 if i == 0 else 0) for i in range(32)]
    (w,) = windows.source_windows(meta(spark, rows)).collect()
    assert (w.failed_ratio, w.mean_bytes) == (round(1 / 32, 4), round(1 / 32, 2)) == (0.0312, 0.03)


def test_approximate_counts_stay_close(spark, medium):
    rows = connection_view(spark, medium).withColumn("src_ip", F.lit("10.0.0.1"))
    exact = windows.source_windows(rows, 600).orderBy("window_start_us").collect()
    near = windows.source_windows(rows, 600, distinct="approx").orderBy("window_start_us").collect()
    for a, b in zip(exact, near):
        assert b.flow_count == a.flow_count
        assert b.distinct_dst_ports == pytest.approx(a.distinct_dst_ports, rel=0.15)


def test_distinct_counts_are_spread_by_value(spark, medium):
    """The first exchange keys on the counted value too, so one hot source is no single task."""
    plan = windows.source_windows(connection_view(spark, medium))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2 and "dst_port" in exchanges[-1] and "dst_ip" in exchanges[-1]
