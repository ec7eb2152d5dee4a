"""Registered queries that pass the supplied tables through files, logs, models and streams of the library."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetloom.operators import encode, evaluate, iforest, models, packets, views, windows
from packetloom.operators.trees import as_array
from packetloom.plans import training
from packetloom.plans.queries import COLLECTOR, CONNECTION_COLUMNS, flow_features32, query
from packetloom.plans.views import connection_view, header_view, packet_view, prediction_view
from packetloom.schemas import CONNECTION_FEATURES, FLOW_COLUMN_NAMES, FLOW_FEATURES, PACKET_SCHEMA, WINDOW_FEATURES
from packetloom.session import ROCKSDB, materialize, run_dir
from packetloom.sources import datasets, logs
from packetloom.sources.artifacts import ArtifactStore
from packetloom.streaming import late
from packetloom.streaming.flows import stream_connections, stream_sessions
from packetloom.streaming.progress import ProgressTotals, observed
from packetloom.streaming.scoring import score_live
from packetloom.streaming.sources import live_records, packet_stream
from packetloom.streaming.windows import capture_windows

ONCE = {"availableNow": True}
# Parts that stream inputs arrive in, and the bounds of their event time.
PARTS = 3
DELAY_US = 1_000_000


def folder(spark: SparkSession, name: str) -> str:
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ended(stream: StreamingQuery) -> None:
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()


def in_parts(df: DataFrame, order: str, path: str, parts: int = PARTS) -> None:
    """Files that arrive one after the other, each with the next rows in ``order``."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    step = (high - low) // parts + 1
    for i in range(parts):
        part = df.where(F.col(order).between(low + i * step, low + (i + 1) * step - 1))
        part.coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(path)


def packet_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = packet_view(spark, sf)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PACKET_SCHEMA.fields])


# --- files --------------------------------------------------------------------


@query
def labelled_file(spark, sf):
    """Headerless files of 43 columns, written and read; ``num_root`` carries the row's number."""
    view = connection_view(spark, sf)
    known = {c: F.col(c) for c in CONNECTION_FEATURES if c in view.columns} | {"num_root": F.col("seq")}
    columns = [known.get(c, F.lit(0)).alias(c) for c in CONNECTION_FEATURES]
    path = folder(spark, "labelled")
    view.select(*columns, "label", (F.col("seq") % 22).alias("difficulty")).write.csv(path)
    rows = datasets.read_connections(spark, path)
    assert "difficulty" not in rows.columns
    return rows.select("num_root", "duration", "protocol_type", "service", "flag", "src_bytes", "is_guest_login", "hot", "label")


@query
def flow_files(spark, sf):
    """Daily files with a header, columns in another order each day, numbers as text and some of them broken."""
    rows = flow_features32(spark, sf)
    kind = F.when(F.col("conn_id") % 4 == 0, " BENIGN").when(F.col("conn_id") % 4 == 1, "DoS Hulk ").otherwise("PortScan")
    broken = F.when(F.col("conn_id") % 7 == 0, "Infinity").when(F.col("conn_id") % 11 == 0, "n/a")
    text = rows.withColumns({c: F.col(c).cast("string") for c in FLOW_FEATURES})
    text = materialize(text.withColumn("flow_bytes_per_s", F.coalesce(broken, "flow_bytes_per_s")).withColumn("label", kind), "flow-days")
    path = folder(spark, "days")
    for day in range(3):
        order = FLOW_FEATURES[day * 5 :] + FLOW_FEATURES[: day * 5]
        columns = [F.col(c).alias(f" {FLOW_COLUMN_NAMES[c]}" if i else FLOW_COLUMN_NAMES[c]) for i, c in enumerate(order)]
        part = text.where(F.col("conn_id") % 3 == day).select(*columns, F.col("label").alias(" Label"))
        part.write.csv(f"{path}/day{day}", header=True, encoding="ISO-8859-1", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return datasets.read_flows(spark, path).drop("file")


@query
def baseline_log(spark, sf):
    """Windows appended to a log twice and read back."""
    rows = windows.source_windows(connection_view(spark, sf))
    path = folder(spark, "baseline")
    for half in (0, 1):
        logs.append_baseline(rows.where(F.expr("window_start_us div 60000000") % 2 == half), path)
    return logs.read_baseline(spark, path).drop("window_id")


@query
def dated_log(spark, sf):
    """The newest attacks on one host from a log with a folder for each 100 s."""
    view = connection_view(spark, sf).where("label <> 'normal'")
    rows = view.select("seq", "dst_ip", "label", F.expr("timestampadd(DAY, ts_us div 100000000, date'2024-01-01')").cast("date").alias("log_date"))
    path = folder(spark, "dated")
    logs.append_dated(rows.where("seq % 2 = 0"), path)
    logs.append_dated(rows.where("seq % 2 = 1"), path)
    newest = logs.read_newest(spark, path, 70, ["seq"], where=F.col("dst_ip") == "192.168.0.3")
    return newest.select("seq", "label", F.col("log_date").cast("string").alias("log_date"))


@query
def stored_metrics(spark, sf):
    """Metrics of one model saved and looked up by phase."""
    rows = prediction_view(spark, sf).where("model = 'a'").select("label", "prediction")
    store = ArtifactStore(spark, folder(spark, "store"))
    both = None
    for phase, part in (("multiclass", rows), ("binary", rows.select(*[(F.col(c) > 0).cast("int").alias(c) for c in rows.columns]))):
        row = evaluate.metrics(part, phase).select(F.lit(phase).alias("phase"), F.lit("dt").alias("model"), "*")
        both = row if both is None else both.unionByName(row)
    store.save_metrics(both, "nsl")
    return store.load_metrics("nsl", "binary").select("phase", "model", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


# --- encoders and models --------------------------------------------------------


@query
def encoder_names(spark, sf):
    """Names of the entries of the 41-feature vector."""
    view = connection_view(spark, sf)
    known = [c if c in view.columns else F.lit(0).alias(c) for c in CONNECTION_FEATURES]
    names = encode.connection_encoder().fit(view.select(*known)).feature_names
    return spark.createDataFrame(list(enumerate(names)), "i int, name string")


@query
def feature_matrix(spark, sf):
    """Window features scaled by a saved encoder, one row for each entry of each vector."""
    rows = windows.source_windows(connection_view(spark, sf), digits=False)
    path = folder(spark, "encoder")
    encode.FeatureEncoder(WINDOW_FEATURES).fit(rows).save(path)
    encoded = encode.FeatureEncoder.load(path, WINDOW_FEATURES).transform(rows)
    each = encoded.select("src_ip", "window_start_us", F.posexplode(as_array(encoded, "vector")).alias("i", "value"))
    return each.select("src_ip", "window_start_us", "i", F.round("value", 6).alias("value"))


@query
def trained_from_log(spark, sf):
    """What the anomaly model learns of each feature from the captured baseline, saved and read back."""
    path, target = folder(spark, "baseline"), folder(spark, "model")
    logs.append_baseline(windows.source_windows(connection_view(spark, sf)), path)
    training.train_anomaly_model(spark, path, target)
    model = iforest.WindowAnomalyModel.load(spark, target)
    rows = [(f, float(m), float(s), int(model.baseline_rows)) for f, (m, s) in model.scaler.items()]
    found = spark.createDataFrame(rows, "feature string, mean double, deviation double, rows long")
    return found.select("feature", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), "rows")


@query
def iforest_trees(spark, sf):
    """Of each tree: its sample, the rows of its leaves, and whether nodes and leaves add up."""
    rows = windows.source_windows(connection_view(spark, sf)).withColumn("window_id", F.xxhash64("src_ip", "window_start_us"))
    nodes = iforest.WindowAnomalyModel.fit(materialize(rows, "baseline")).nodes
    leaf = F.col("feature") < 0
    return nodes.groupBy("tree").agg(
        F.max(F.when(F.col("node") == 0, F.col("size"))).cast("long").alias("sample"),
        F.sum(F.when(leaf, F.col("size"))).cast("long").alias("leaf_rows"),
        (F.count(F.lit(1)) == 2 * F.count_if(leaf) - 1).alias("binary"),
    )


# --- streams ------------------------------------------------------------------


@query
def streamed_connections(spark, sf):
    """Connections that a stream of packet files gives; a packet far ahead lets the watermark pass them all."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows, path, out = packet_rows(spark, sf), folder(spark, "packets"), folder(spark, "streamed")
    in_parts(rows, "seq", path)
    _far_ahead(rows, path)
    stream = stream_connections(packet_stream(spark, path, max_files=1), "1 second")
    ended(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark, "ck")).trigger(**ONCE).start())
    return spark.read.parquet(out).select(*CONNECTION_COLUMNS)


def _far_ahead(rows: DataFrame, path: str, proto: str = "end") -> None:
    last = rows.limit(1).withColumns({"us": F.lit(10**14), "seq": F.lit(10**9), "proto": F.lit(proto)})
    last.select(*rows.columns).coalesce(1).write.mode("append").parquet(path)


@query
def streamed_sessions(spark, sf):
    """Idle sessions of UDP and ICMP by session windows of a stream."""
    rows, path, out = packet_rows(spark, sf), folder(spark, "packets"), folder(spark, "streamed")
    in_parts(rows, "seq", path)
    _far_ahead(rows, path)
    stream = stream_sessions(packet_stream(spark, path, max_files=1), "1 second")
    ended(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark, "ck")).trigger(**ONCE).start())
    kept = spark.read.parquet(out).where("proto <> 'end'")
    return kept.select("flow_seq", "last_us", "fwd_pkts", "bwd_pkts", "src_bytes", "dst_bytes", "fwd_bytes", "bwd_bytes")


@query
def streamed_windows(spark, sf):
    """Closed source windows of a stream, captured as a baseline; the newest stay open."""
    rows = connection_view(spark, sf).select("seq", "ts_us", "src_ip", "dst_ip", "dst_port", "flag", "bytes")
    path, base = folder(spark, "meta"), folder(spark, "baseline")
    in_parts(rows, "seq", path)
    raw = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    ended(capture_windows(raw.withColumn("ts", F.timestamp_micros("ts_us")), folder(spark, "ck"), base, "1 second", trigger=ONCE))
    return logs.read_baseline(spark, base).drop("window_id", "batch_id")


@query
def streamed_scores(spark, sf):
    """Live records scored by a saved tree: events, logged attacks and the counts of the live view."""
    rows = flow_features32(spark, sf).withColumn("label", (F.col("tot_fwd_pkts") > 1).cast("int"))
    rows = materialize(rows, "records")
    store = ArtifactStore(spark, folder(spark, "store"))
    store.save_encoder(encode.flow_encoder().fit(rows), "cic")
    store.save_model(models.make_classifier("dt", "binary").fit(store.load_encoder("cic").transform(rows)), "dt", "binary", "cic")
    meta = F.struct(
        F.lit("10.0.0.1").alias("src_ip"), F.lit("h").alias("dst_ip"), F.col("dst_port").cast("int").alias("dst_port"),
        F.lit("SF").alias("flag"), F.lit(1).cast("long").alias("bytes"),
    )
    named = {c: F.lit(v) for c, v in (("protocol_type", "tcp"), ("service", "http"), ("flag", "SF"), ("extra", "junk"))}
    records = rows.withColumns(named).withColumns({"meta": meta, "ts": F.timestamp_micros(F.col("conn_id") * 1_000_000), "seq": F.col("conn_id")})
    path, events, log, counts = (folder(spark, n) for n in ("records", "events", "log", "counts"))
    records.select(*FLOW_FEATURES, *named, "meta", "ts", "seq").repartition(3).write.json(path)
    source = live_records(spark, path, "cic", max_files=1)
    ended(score_live(source, store.load_encoder("cic"), store.load_model("dt", "binary", "cic"), folder(spark, "ck"), events, log, counts, "cic", ONCE))
    seen = spark.read.parquet(events)
    shown = views.view_counts(seen, "is_attack", "attacks").withColumn("at", F.lit(0))
    logged = spark.read.parquet(log).agg(F.count(F.lit(1)).alias("logged"), F.lit(0).alias("at"))
    batches = spark.read.parquet(counts).agg(F.sum("count").alias("counted"), F.sum("attacks").alias("counted_attacks"), F.lit(0).alias("at"))
    return shown.join(logged, "at").join(batches, "at").drop("at")


@query
def late_split(spark, sf):
    """Rows of a stream that come too late: what stands in the table of late rows, and how many rows went on in time."""
    rows = connection_view(spark, sf).select("seq", "ts_us", "src_ip")
    # Three parts by time; every 50th row arrives with the last one.
    part = F.expr(f"case when seq % 50 = 0 then 2 else least(2, seq * 3 div {rows.count()}) end").cast("int")
    rows = materialize(rows.withColumn("part", part), "arrivals")
    path, good, bad, marks = (folder(spark, n) for n in ("arriving", "in-time", "late", "marks"))
    for i in range(3):
        rows.where(F.col("part") == i).coalesce(1).write.mode("append").parquet(path)
    raw = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    ended(late.route(raw.withColumn("ts", F.timestamp_micros("ts_us")), folder(spark, "ck"), good, bad, marks, DELAY_US, trigger=ONCE))
    counted = late.late_counts(spark, marks).agg(F.sum("rows").alias("rows"), F.sum("late").alias("late")).withColumn("at", F.lit(0))
    seen = spark.read.parquet(good).agg(F.count(F.lit(1)).alias("in_time"), F.lit(0).alias("at"))
    table = late.late_rows(spark, bad).agg(F.sum("seq").alias("late_seqs"), F.count(F.lit(1)).alias("late_rows"), F.lit(0).alias("at"))
    return counted.join(seen, "at").join(table, "at").drop("at")


@query
def observed_counters(spark, sf):
    """Packet counters that a stream reports while its rows pass by."""
    rows, path, out = materialize(header_view(spark, sf), "headers"), folder(spark, "headers"), folder(spark, "kept")
    in_parts(rows, "seq", path)
    raw = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    listener = ProgressTotals.follow(spark)
    try:
        watched = observed(raw, "capture", packets.packet_counts(*COLLECTOR))
        kept = packets.drop_own_traffic(packets.normalize_packets(watched), *COLLECTOR)
        stream = kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder(spark, "ck")).trigger(**ONCE).start()
        ended(stream)
        totals = listener.settled(stream.id, rows.count())
    finally:
        spark.streams.removeListener(listener)
    row = [tuple(int(totals[n]) for n in ("packets", "non_ip", "own", "errors")) + (spark.read.parquet(out).count(),)]
    return spark.createDataFrame(row, "packets long, non_ip long, own long, errors long, kept long")


@query
def hour_windows(spark, sf):
    """Windows of ten minutes from sketches kept for each; counts and sums exact, distinct counts within 5 %."""
    conns = connection_view(spark, sf)
    kept = materialize(windows.window_sketches(conns), "sketches")
    wide = windows.sketched_windows(windows.united_sketches(kept, 600))
    exact = windows.source_windows(conns, 600).select(
        "src_ip", "window_start_us", F.col("distinct_dst_ports").alias("ports"), F.col("distinct_dst_hosts").alias("hosts")
    )
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.05 * F.col(b)
    both = wide.join(exact, ["src_ip", "window_start_us"])
    return both.select(
        "src_ip", "window_start_us", "flow_count", "total_bytes", "failed",
        near("distinct_dst_ports", "ports").alias("ports_near"), near("distinct_dst_hosts", "hosts").alias("hosts_near"),
    )
