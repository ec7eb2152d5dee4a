"""Late rows, observed metrics, native sessions, united sketches and dated logs."""

import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from packetloom.operators import flows, windows
from packetloom.plans.views import connection_view, packet_view
from packetloom.schemas import PACKET_SCHEMA
from packetloom.sources import datasets, logs
from packetloom.streaming import late
from packetloom.streaming.flows import PENDING_SCHEMA, STATE_NAMES, ConnectionAssembler, stream_connections, stream_sessions
from packetloom.streaming.progress import ProgressTotals, observed
from packetloom.streaming.sinks import is_written, write_batch
from packetloom.streaming.sources import packet_stream

ONCE = {"availableNow": True}


def folder():
    return tempfile.mkdtemp(prefix="packetloom-late-")


def arrivals(spark, batches):
    """Rows (n, us) in files, one for each batch."""
    path = folder()
    for batch in batches:
        spark.createDataFrame(batch, "n long, us long").coalesce(1).write.mode("append").parquet(path)
    raw = spark.readStream.schema("n long, us long").option("maxFilesPerTrigger", 1).parquet(path)
    return raw.withColumn("ts", F.timestamp_micros("us"))


def test_rows_are_split_by_the_rule_of_the_watermark(spark):
    batches = [[(1, 100), (2, 5000)], [(3, 3999), (4, 4000), (5, 9000), (6, None)], [(7, 7999), (8, 8000), (9, 4500)], [(10, 8000)]]
    good, bad, marks = folder(), folder(), folder()
    late.route(arrivals(spark, batches), folder(), good, bad, marks, 1000, trigger=ONCE).awaitTermination(120)
    ids = lambda df: sorted(r.n for r in df.collect())
    assert ids(late.late_rows(spark, bad)) == [3, 6, 7, 9]
    assert ids(spark.read.parquet(good)) == [1, 2, 4, 5, 8, 10]
    assert [tuple(r) for r in late.late_counts(spark, marks).orderBy("batch_id").collect()] == [(0, 2, 0), (1, 4, 2), (2, 3, 2), (3, 1, 0)]


def test_a_batch_run_again_leaves_what_is_there(spark):
    path = folder()
    assert not is_written(spark, path, 3)
    write_batch(spark.range(3), path, 3)
    assert is_written(spark, path, 3) and not is_written(spark, path, 4)


def test_stream_and_late_rows_together_are_the_batch(spark, small):
    """Packets out of order by more than the delay: the stream gives the connections of those in time, the rest is in a table."""
    packets = packet_view(spark, small).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PACKET_SCHEMA.fields])
    path, good, bad, out = folder(), folder(), folder(), folder()
    part = packets.withColumn("part", F.expr("case when seq % 40 = 0 then 3 else least(3, seq div 300) end"))
    for i in range(4):
        part.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(path)
    source = packet_stream(spark, path, max_files=1)
    late.route(source, folder(), good, bad, folder(), 1_000_000, trigger=ONCE).awaitTermination(120)
    in_time = spark.read.parquet(good).select(*packets.columns)
    missed = late.late_rows(spark, bad).select(*packets.columns)
    assert missed.count() > 0 and in_time.unionByName(missed).exceptAll(packets).count() == 0
    assert in_time.count() + missed.count() == packets.count()
    ahead = packets.limit(1).withColumns({"us": F.lit(10**14), "seq": F.lit(10**9), "proto": F.lit("end")}).withColumn("ts", F.timestamp_micros("us"))
    ahead.coalesce(1).write.parquet(f"{good}/batch_id=99")
    listener = ProgressTotals.follow(spark)
    stream = stream_connections(packet_stream(spark, good, max_files=1).drop("batch_id"), "1 second")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder()).trigger(**ONCE).start()
    query.awaitTermination(300)
    totals = listener.settled(query.id, in_time.count() + 1)
    spark.streams.removeListener(listener)
    assert totals["dropped_rows"] == 0  # what was routed in time is in time
    key = lambda df: sorted((r.conn_id, r.ts_us, r.src_bytes, r.dst_bytes, r.flag) for r in df.collect())
    assert key(spark.read.parquet(out)) == key(flows.connections(in_time))


def test_dropped_rows_are_counted(spark):
    stream = arrivals(spark, [[(1, 10**9)], [(2, 2 * 10**9)], [(3, 5), (4, 3 * 10**9)]]).withWatermark("ts", "1 second")
    counts = stream.groupBy(F.window("ts", "10 seconds")).count()
    listener = ProgressTotals.follow(spark)
    query = counts.writeStream.outputMode("append").format("memory").queryName("dropped").option("checkpointLocation", folder()).trigger(**ONCE).start()
    query.awaitTermination(120)
    assert listener.settled(query.id, 4)["dropped_rows"] == 1
    spark.streams.removeListener(listener)


def test_observed_metrics_of_a_stream(spark):
    stream = observed(arrivals(spark, [[(1, 1), (2, 2)], [(3, 3)]]), "seen", {"rows": F.count(F.lit(1)), "odd": F.count_if(F.expr("n % 2 = 1"))})
    listener = ProgressTotals.follow(spark)
    query = stream.writeStream.format("memory").queryName("observed").option("checkpointLocation", folder()).trigger(**ONCE).start()
    query.awaitTermination(120)
    totals = listener.settled(query.id, 3)
    spark.streams.removeListener(listener)
    assert (totals["rows"], totals["odd"], totals["input_rows"]) == (3, 2, 3)


def test_split_is_checked_while_it_is_used(spark, monkeypatch):
    monkeypatch.setitem(datasets.SPLIT_ROWS, "test", 7)
    good = spark.range(7).selectExpr(*[f"id as c{i}" for i in range(datasets.RAW_COLUMNS)])
    rows, check = datasets.watched_split(good, "test")
    assert rows.selectExpr("sum(c1)").first()[0] == 21
    check()
    rows, check = datasets.watched_split(good.where("c0 > 0"), "test")
    rows.count()
    with pytest.raises(datasets.ShapeError, match="6 rows"):
        check()
    with pytest.raises(ValueError, match="none of the splits"):
        datasets.watched_split(good, "other")


@pytest.mark.parametrize("gap_us, sessions", [(10_000_000, 1), (10_000_001, 2)])
def test_a_gap_of_exactly_the_timeout_goes_on(spark, gap_us, sessions):
    row = lambda n, us, proto: (n, us, "10.0.0.1", "10.0.0.2", 1000, 53, proto, 10, 50, "", -1, -1, -1, False)
    kind = "seq long, us long, src_ip string, dst_ip string, src_port int, dst_port int, proto string, payload_len long, ip_len long, tcp_flags string, tcp_window int, icmp_type int, icmp_code int, is_fragment boolean"
    path, out = folder(), folder()
    rows = [row(1, 10**6, "udp"), row(2, 10**6 + gap_us, "udp"), row(3, 2 * 10**6, "tcp")]
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([row(9, 10**12, "end")], kind).coalesce(1).write.mode("append").parquet(path)
    stream = stream_sessions(packet_stream(spark, path, max_files=1), "1 second")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder()).trigger(**ONCE).start().awaitTermination(120)
    got = spark.read.parquet(out).where("proto = 'udp'").collect()
    assert len(got) == sessions and sum(r.fwd_pkts for r in got) == 2 and "MapInPandas" not in str(got)


def test_united_sketches_stay_close_and_small(spark, medium):
    conns = connection_view(spark, medium)
    wide = conns.withColumn("dst_port", F.col("seq").cast("int")).withColumn("src_ip", F.lit("10.0.0.9"))
    kept = windows.window_sketches(wide)
    assert kept.agg(F.max(F.length("port_sketch"))).first()[0] < 2 << windows.SKETCH_BITS
    got = windows.sketched_windows(windows.united_sketches(kept, 3600)).orderBy("window_start_us").collect()
    want = windows.source_windows(wide, 3600).orderBy("window_start_us").collect()
    assert [r.flow_count for r in got] == [r.flow_count for r in want] and max(r.flow_count for r in want) > 2000
    for a, b in zip(got, want):
        assert abs(a.distinct_dst_ports - b.distinct_dst_ports) <= 0.04 * b.distinct_dst_ports
        assert a.distinct_dst_hosts == b.distinct_dst_hosts  # few values are exact
    nulls = windows.window_sketches(conns.withColumn("dst_port", F.lit(None).cast("int")))
    assert windows.sketched_windows(nulls).agg(F.max("distinct_dst_ports")).first()[0] == 0


def test_newest_rows_of_a_dated_log(spark):
    path = folder()
    rows = [(i, f"2024-01-{1 + i // 10:02d}", i % 3) for i in range(200)] + [(999, None, 0)]
    df = spark.createDataFrame(rows, "seq long, d string, kind int").withColumn("log_date", F.to_date("d")).drop("d")
    logs.append_dated(df.where("seq < 95"), path)
    logs.append_dated(df.where("seq >= 95"), path)
    seqs = lambda n, **kw: [r.seq for r in logs.read_newest(spark, path, n, ["seq"], **kw).collect()]
    assert seqs(25) == list(range(199, 174, -1))
    assert seqs(5, where=F.col("kind") == 1) == [199, 196, 193, 190, 187]
    assert seqs(1000)[-2:] == [0, 999]  # rows without a date come last
    few = logs.read_newest(spark, path, 5, ["seq"])
    assert len(few.inputFiles()) == len(spark.read.parquet(path).inputFiles())  # pruned by the scan, not before
    assert "PartitionFilters" in few._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="one row at least"):
        logs.read_newest(spark, path, 0, ["seq"])


class FakeValue:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    def clear(self):
        self.row = None


class FakeMap:
    def __init__(self):
        self.rows, self.reads = {}, 0

    def containsKey(self, key):  # noqa: N802
        return key in self.rows

    def getValue(self, key):  # noqa: N802
        self.reads += 1
        return self.rows[key]

    def updateValue(self, key, value):  # noqa: N802
        self.rows[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.rows[key]

    def keys(self):
        return iter(list(self.rows))


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.ms

    def registerTimer(self, ms):  # noqa: N802
        self.ms = ms


@pytest.mark.parametrize("waiting", [10, 5000])
def test_a_timer_reads_the_slices_that_came_due(waiting):
    worker = ConnectionAssembler(flows.IDLE_US, slice_us=1000)
    worker.handle, worker.state, worker.pending = At(0), FakeValue(), FakeMap()
    key = ("", "udp", "a", 1, "b", 2)
    row = lambda n, us: (us, n, True, 1, 41, "", -1, -1, -1, False)
    rows = [row(n, n * 100 + 1) for n in range(waiting + 20)]
    for begin in range(0, len(rows), 500):
        frame = pd.DataFrame(rows[begin : begin + 500], columns=PENDING_SCHEMA.names)
        list(worker.handleInputRows(key, iter([frame]), At(0)))
    worker.pending.reads = 0
    done = pd.concat(list(worker.handleExpiredTimer(key, At(2), None)))  # two slices and no more
    assert worker.pending.reads == 2 and len(done) == 0
    assert dict(zip(STATE_NAMES, worker.state.get()))["fwd_pkts"] == 20
    assert (0,) not in worker.pending.rows and (2,) in worker.pending.rows
    # The rest in one go, then silence ends the connection.
    list(worker.handleExpiredTimer(key, At(10**6), None))
    (last,) = [d for d in worker.handleExpiredTimer(key, At(10**8), None) if len(d)] or [pd.DataFrame()]
    assert not worker.pending.rows and (last.empty or last.fwd_pkts[0] == len(rows))
