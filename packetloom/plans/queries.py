"""The registered queries: every operator over the supplied tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import labels
from packetloom.operators import (
    alerts,
    clusters,
    encode,
    evaluate,
    flows,
    iforest,
    models,
    packets,
    patterns,
    records,
    rolling,
    sampling,
    views,
    windows,
)
from packetloom.plans.views import (
    connection_view,
    embedding_view,
    feature_view,
    header_view,
    packet_view,
    prediction_view,
    raw_number_view,
    table,
)
from packetloom.schemas import CONNECTION_FEATURES, FLOW_FEATURES, WINDOW_FEATURES
from packetloom.operators.layout import small_side
from packetloom.session import materialize, run_dir
from packetloom.sources import datasets, logs
from packetloom.sources.artifacts import ArtifactStore

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

COLLECTOR = ("192.168.0.3", 443)
# Event time (microseconds) at which "now" questions are asked of the views.
NOW_US = 1_200_000_000
BATCH_US = 10_000_000


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


# --- sources and sinks --------------------------------------------------------


@query
def verify_shape(spark, sf):
    tables = [("events", 6), ("lineitem", 11), ("embeddings", 3), ("labels", 3)]
    checks = [datasets.shape_check(table(spark, sf, name), name, 10_000, cols) for name, cols in tables]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


@query
def clean_numeric(spark, sf):
    raw = raw_number_view(spark, sf)
    as_text = lambda c: F.when(F.isnan(c), "nan").when(F.abs(c) == float("inf"), "inf").otherwise(
        c.cast("decimal(38,0)").cast("string")
    )
    return raw.select(
        "l_orderkey",
        "l_linenumber",
        as_text(datasets.to_number(F.col("price"))).alias("price"),
        as_text(datasets.to_number(F.col("quantity"))).alias("quantity"),
    )


@query
def clean_flows(spark, sf):
    return datasets.clean_flows(raw_number_view(spark, sf), ["price", "quantity", "flow_duration"])


@query
def log_retention(spark, sf):
    log = connection_view(spark, sf).where("label <> 'normal'").select("seq", F.col("src_ip").alias("log"), "label")
    return logs.retain_newest(log, 10_000)


@query
def rules_top20(spark, sf):
    return patterns.top_rules(rules_top50(spark, sf), patterns.REPORTED_RULES)


# --- labels, lookups, records -------------------------------------------------


@query
def label_binary(spark, sf):
    return connection_view(spark, sf).select("seq", labels.binary_label(F.col("label")).alias("target"))


@query
def label_multiclass(spark, sf):
    return labels.with_attack_class(connection_view(spark, sf).select("seq", "label"))


@query
def unknown_labels(spark, sf):
    rows = connection_view(spark, sf).selectExpr(
        "case when bytes % 50 = 0 then concat(label, '_', bytes % 7) else label end as label"
    )
    return labels.unknown_attack_labels(rows)


def flow_label_rows(spark, sf) -> DataFrame:
    return connection_view(spark, sf).selectExpr(
        "seq",
        "case label when 'normal' then ' BENIGN' when 'neptune' then 'DoS Hulk'"
        " when 'satan' then concat('PortScan', char(9))"
        " else (case when bytes % 2 = 0 then 'SSH-Patator' else 'Web Attack - XSS ' end) end as label",
    )


@query
def label_binary_cic(spark, sf):
    return flow_label_rows(spark, sf).select("seq", labels.binary_flow_label(F.col("label")).alias("target"))


@query
def label_cic_category(spark, sf):
    return labels.with_flow_class(flow_label_rows(spark, sf)).drop("label")


@query
def prediction_names(spark, sf):
    rows = connection_view(spark, sf).selectExpr("seq", "bytes % 5 as prediction")
    return rows.select("seq", *[c.alias(n) for n, c in labels.prediction_columns(F.col("prediction"), labels.ATTACK_CLASSES).items()])


@query
def service_name(spark, sf):
    return connection_view(spark, sf).select("seq", "proto", "dst_port", "service")


@query
def file_activity(spark, sf):
    rows = connection_view(spark, sf)
    return rows.select("seq", records.has_file_activity(rows.columns).alias("has_file_activity"))


def event_rows(spark, sf) -> DataFrame:
    scored = connection_view(spark, sf).withColumn("prediction", (F.col("flag") != "SF").cast("int"))
    return records.live_events(scored, "nsl", labels.BINARY_CLASSES, ["seq", "ts_us"])


@query
def live_events(spark, sf):
    return event_rows(spark, sf)


@query
def attack_filter(spark, sf):
    return records.attack_log_rows(event_rows(spark, sf)).drop("logged_at", "log_date")


@query
def packet_normalize(spark, sf):
    return packets.normalize_packets(header_view(spark, sf))


@query
def own_traffic_filter(spark, sf):
    return packets.drop_own_traffic(packet_view(spark, sf), *COLLECTOR)


@query
def flow_meta(spark, sf):
    meta = connection_view(spark, sf).select("seq", records.flow_meta().alias("meta"))
    return meta.select("seq", "meta.*")


@query
def pipeline_counters(spark, sf):
    """Counters as of the time when four fifths of the capture have passed."""
    captured = header_view(spark, sf)
    now_us = captured.agg(F.max("us")).first()[0] * 4 // 5
    headers = captured.where(F.coalesce(F.col("us"), F.lit(0)) <= now_us)
    kept = packets.drop_own_traffic(packets.normalize_packets(headers), *COLLECTOR)
    seen = flows.flow_aggregates(flows.assign_flows(kept, "tcp"))
    # A first packet never closes its own connection.
    ended = (F.col("orig_fin") & F.col("resp_fin")) | F.col("orig_rst") | F.col("resp_rst")
    closed = (F.col("proto") == "tcp") & ended & (F.col("fwd_pkts") + F.col("bwd_pkts") > 1)
    conns = seen.select("proto", F.col("last_us").alias("ts_us"), closed.alias("closed"))
    return packets.pipeline_counters(headers, conns, *COLLECTOR, now_us, flows.IDLE_US)


# --- packets to connections ---------------------------------------------------


@query
def canonical_tuple(spark, sf):
    return flows.canonical_tuple(packet_view(spark, sf)).select("seq", "up", *flows.TUPLE).drop("sensor")


def idle_flows(spark, sf) -> DataFrame:
    return flows.flow_aggregates(flows.assign_flows(packet_view(spark, sf), "idle"))


@query
def idle_sessions(spark, sf):
    return flows.assign_flows(packet_view(spark, sf), "idle").select("seq", "flow_seq", "flow_us", "flow_up")


@query
def tcp_flows(spark, sf):
    return flows.assign_flows(packet_view(spark, sf), "tcp").select("seq", "flow_seq", "flow_us", "flow_up")


@query
def tcp_flows_by_sensor(spark, sf):
    """Two sensors that see the same addresses."""
    seen = packet_view(spark, sf).withColumn("sensor", F.expr("concat('s', seq div 7 % 2)"))
    return flows.assign_flows(seen, "tcp").select("sensor", "seq", "flow_seq", "flow_us", "flow_up")


@query
def flow_bytes(spark, sf):
    return idle_flows(spark, sf).select(
        "flow_seq", "fwd_pkts", "bwd_pkts", "src_bytes", "dst_bytes", "fwd_bytes", "bwd_bytes", "wrong_fragment", "urgent"
    )


@query
def flow_len_stats(spark, sf):
    sides = [f"{d}_pkt_len" for d in ("fwd", "bwd")]
    exact = [f"{s}_{m}" for s in sides for m in ("max", "min", "mean")]
    spread = [F.round(f"{s}_std", 6).alias(f"{s}_std") for s in sides]
    return idle_flows(spark, sf).select("flow_seq", *exact, *spread)


@query
def flow_iat(spark, sf):
    named = idle_flows(spark, sf).withColumns(
        {c: v for c, v in flows.flow_features().items() if c in ("fwd_iat_mean", "bwd_iat_mean")}
    )
    exact = ["flow_iat_max", "flow_iat_min", "flow_iat_mean", "fwd_iat_mean", "bwd_iat_mean"]
    return named.select("flow_seq", *exact, F.round("flow_iat_std", 3).alias("flow_iat_std"))


@query
def flow_flags(spark, sf):
    return idle_flows(spark, sf).select(
        "flow_seq", *[f"n_{c}" for c in "fsrpau"], "init_win_bytes_fwd", "init_win_bytes_bwd"
    )


@query
def conn_state(spark, sf):
    return idle_flows(spark, sf).select("flow_seq", flows.connection_state().alias("flag"))


CONNECTION_COLUMNS = [
    "conn_id", "ts_us", "duration", "proto", "service", "flag", "src_ip", "src_port", "dst_ip", "dst_port",
    "src_bytes", "dst_bytes", "land", "wrong_fragment", "urgent",
]


@query
def connections(spark, sf):
    return flows.connections(packet_view(spark, sf)).select(*CONNECTION_COLUMNS)


@query
def flow_features32(spark, sf):
    rows = flows.connections(packet_view(spark, sf), "idle").select("conn_id", "features.*")
    inexact = [c for c in FLOW_FEATURES if c.endswith("_std") or c.endswith("per_s")]
    return rows.withColumns({c: F.round(c, 3) for c in inexact})


# --- rolling features ---------------------------------------------------------


@query
def conn_seq(spark, sf):
    rows = connection_view(spark, sf).select(F.col("seq").alias("event_seq"), "src_ip", "ts_us")
    numbered = rolling.completion_sequence(rows, by=["src_ip"], order=["ts_us", "event_seq"])
    return numbered.select("event_seq", "src_ip", "seq")


def _rates(counts: DataFrame, rates: dict[str, tuple[str, str]], names: list[str], kept: list[str]) -> DataFrame:
    chosen = {n: rates[n] for n in names}
    return rolling.with_rates(counts, chosen, digits=None).select("seq", *kept, *names)


@query
def feat_2s_host(spark, sf):
    counts = rolling.rolling_counts(connection_view(spark, sf), host_frame=False)
    names = ["serror_rate", "rerror_rate", "same_srv_rate", "diff_srv_rate"]
    return _rates(counts, rolling.TIME_RATES, names, ["count", "host_serr", "host_rerr", "host_srv"])


@query
def feat_2s_srv(spark, sf):
    counts = rolling.rolling_counts(connection_view(spark, sf), host_frame=False)
    names = ["srv_serror_rate", "srv_rerror_rate", "srv_diff_host_rate"]
    return _rates(counts, rolling.TIME_RATES, names, ["srv_count", "srv_serr", "srv_rerr"])


@query
def feat_100_host(spark, sf):
    counts = rolling.rolling_counts(connection_view(spark, sf), time_frame=False)
    names = [
        "dst_host_same_srv_rate", "dst_host_diff_srv_rate", "dst_host_same_src_port_rate",
        "dst_host_serror_rate", "dst_host_rerror_rate",
    ]
    return _rates(counts, rolling.HOST_RATES, names, ["dst_host_count", "dst_host_srv_count"])


@query
def feat_100_srv(spark, sf):
    counts = rolling.rolling_counts(connection_view(spark, sf), time_frame=False)
    names = ["dst_host_srv_diff_host_rate", "dst_host_srv_serror_rate", "dst_host_srv_rerror_rate"]
    return _rates(counts, rolling.HOST_RATES, names, ["dh_srv_all", "dh_srv_serr", "dh_srv_rerr"])


@query
def feat_2s_exact(spark, sf):
    """Arrival order: every seventh connection is finalized late, with an end time 31 s back."""
    late = connection_view(spark, sf).withColumn(
        "ts_us", F.col("ts_us") - F.when(F.col("seq") % 7 == 0, 31_000_000).otherwise(0)
    )
    rows = late.select("seq", "ts_us", "dst_ip", "service", "flag", "src_port")
    return rolling.rolling_counts_arrival(rows).select("seq", *rolling.TIME_COUNTS)


@query
def conn_features41(spark, sf):
    return rolling.connection_features(connection_view(spark, sf), digits=None)


@query
def conn_features41_rounded(spark, sf):
    """As a sensor sends them: rates of two places."""
    return rolling.connection_features(connection_view(spark, sf))


@query
def packet_features41(spark, sf):
    """Packets all the way to the 41 features."""
    rows = flows.connections(packet_view(spark, sf)).drop("features")
    numbered = rolling.completion_sequence(materialize(rows, "connections"))
    return rolling.connection_features(numbered, digits=None)


# --- source windows -----------------------------------------------------------


def window_rows(spark, sf, digits: bool = False) -> DataFrame:
    return windows.source_windows(connection_view(spark, sf), digits=digits)


@query
def source_windows(spark, sf):
    return window_rows(spark, sf).select("src_ip", "window_start_us", *WINDOW_FEATURES)


@query
def source_windows_rounded(spark, sf):
    return window_rows(spark, sf, digits=True).select("src_ip", "window_start_us", *WINDOW_FEATURES)


@query
def closed_windows(spark, sf):
    rows = windows.closed_windows(window_rows(spark, sf), NOW_US)
    return rows.select("src_ip", "window_start_us", *WINDOW_FEATURES)


@query
def open_windows(spark, sf):
    return windows.open_window_count(connection_view(spark, sf), NOW_US)


# --- encoding and sampling ----------------------------------------------------

CATEGORICAL, NUMERIC = ["l_returnflag", "l_linestatus"], ["quantity", "price", "discount", "tax"]


@query
def onehot(spark, sf):
    rows = feature_view(spark, sf)
    encoder = encode.FeatureEncoder(NUMERIC, CATEGORICAL).fit(rows)
    return encoder.transform(rows).select("row_id", "vector")


@query
def onehot_long(spark, sf):
    rows = feature_view(spark, sf)
    # Fitted on part of the flags, so that unknown values give no item.
    seen = encode.fitted_categories(rows.where("l_returnflag <> 'N'"), CATEGORICAL)
    return encode.onehot_long(rows, seen, CATEGORICAL, "row_id")


@query
def scale_population(spark, sf):
    rows = feature_view(spark, sf)
    scaled = encode.scale(rows, encode.scaling_parameters(rows, NUMERIC))
    return scaled.select("row_id", *[F.round(c, 6).alias(c) for c in NUMERIC])


@query
def stratified_split(spark, sf):
    rows = connection_view(spark, sf).select("seq", "label")
    return sampling.with_split(rows, "label", "seq").select("seq", "label", F.col("taken").alias("is_test"))


@query
def fixed_sample(spark, sf):
    return sampling.fixed_sample(connection_view(spark, sf).select("seq", "label"), 10_000, "seq")


# --- models -------------------------------------------------------------------


def vector_rows(spark, sf) -> DataFrame:
    rows = embedding_view(spark, sf)
    return rows.select(
        "vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"), F.col("label").cast("int")
    )


@query
def nb_class_stats(spark, sf):
    stats = models.class_statistics(embedding_view(spark, sf), "embedding")
    return stats.select("label", "feature", "n", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


def _fit_predict(spark, sf, model: str, phase: str, **sizes: int) -> DataFrame:
    rows = vector_rows(spark, sf)
    if phase == "binary":
        rows = rows.withColumn("label", (F.col("label") >= 5).cast("int"))
    fitted = models.make_classifier(model, phase, **sizes).fit(rows)
    return fitted.transform(rows).select("vec_id", "label", F.col("prediction").cast("int").alias("prediction"))


@query
def nb_predict(spark, sf):
    return _fit_predict(spark, sf, "nb", "multiclass")


@query
def dt_predict(spark, sf):
    return _fit_predict(spark, sf, "dt", "multiclass")


@query
def rf_predict(spark, sf):
    return _fit_predict(spark, sf, "rf", "multiclass")


@query
def gbt_predict(spark, sf):
    return _fit_predict(spark, sf, "gbt", "binary")


@query
def gbt_multiclass(spark, sf):
    """One boosted model over five classes."""
    rows = vector_rows(spark, sf).withColumn("label", F.col("label") % 5)
    fitted = models.make_classifier("gbt", "multiclass").fit(rows)
    return fitted.transform(rows).select("vec_id", "label", F.col("prediction").cast("int").alias("prediction"))


def labelled_features(spark, sf) -> DataFrame:
    """The feature table that training jobs read: written once."""
    return materialize(rolling.connection_features(connection_view(spark, sf), keep=["label"]), "features")


@query
def model_metrics(spark, sf):
    """All models and phases at their full sizes."""
    train, test = sampling.stratified_split(labelled_features(spark, sf), "label", "seq")
    return models.train_models(train, test, encode.connection_encoder(), "nsl")


@query
def flow_model_metrics(spark, sf):
    """The 32-feature path: seven classes of flow labels, one boosted model for all of them."""
    rows = records.flow_records(flows.connections(packet_view(spark, sf), "tcp"), ["conn_id"])
    # Labels that the features tell: who talked, how often, how it went.
    kind = F.expr(
        "case when rst_flag_cnt > 1 then 'DoS Hulk' when syn_flag_cnt > 2 then 'PortScan' when fin_flag_cnt > 1 then 'Bot'"
        " when dst_port = 22 then 'SSH-Patator' when dst_port = 80 then 'Web Attack - XSS' when dst_port = 53 then 'Heartbleed' else 'BENIGN' end"
    )
    named = materialize(rows.select("conn_id", *FLOW_FEATURES, kind.alias("label")), "labelled-flows")
    train, test = sampling.stratified_split(named, "label", "conn_id")
    return models.train_models(train, test, encode.flow_encoder(), "cic", models=("dt", "gbt"), phases=("multiclass",))


@query
def predict_batch(spark, sf):
    """Encoder and model are saved and read back before they predict."""
    rows = labelled_features(spark, sf)
    store = ArtifactStore(spark, f"{run_dir(spark)}/store-{uuid.uuid4().hex}")
    store.save_encoder(encode.connection_encoder().fit(rows))
    target = models.labelled(rows, "nsl", "multiclass")
    fitted = models.make_classifier("dt", "multiclass").fit(store.load_encoder().transform(target))
    store.save_model(fitted, "dt", "multiclass")
    scored = models.predict(
        rows.select("seq", *CONNECTION_FEATURES), store.load_encoder(), store.load_model("dt", "multiclass"), "nsl", "multiclass"
    )
    return scored.select("seq", "prediction", "label", "is_attack")


@query
def kmeans_sweep(spark, sf):
    sweep, _, _ = clusters.kmeans_sweep(vector_rows(spark, sf), "vec_id")
    return sweep


@query
def inertia_given_centers(spark, sf):
    rows = embedding_view(spark, sf)
    # One center per label: a mean per (label, feature), gathered in feature order.
    means = rows.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    centers = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    centers = centers.select("label", F.col("c.m").alias("center"))
    total = clusters.inertia(rows.join(small_side(materialize(centers, "centers")), "label"), F.col("embedding"), F.col("center"))
    return total.select(F.round("inertia", 6).alias("inertia"))


@query
def silhouette_euclid(spark, sf):
    rows = embedding_view(spark, sf).select("vec_id", F.col("embedding").alias("point"), F.col("label").alias("cluster"))
    return clusters.silhouette_rows(rows, "vec_id").withColumn("silhouette", F.round("silhouette", 6))


def baseline_rows(spark, sf) -> DataFrame:
    """The baseline table that fitting reads several times: written once."""
    rows = window_rows(spark, sf, digits=True)
    return materialize(rows.withColumn("window_id", F.xxhash64("src_ip", "window_start_us")), "baseline")


@query
def iforest_nodes(spark, sf):
    return iforest.WindowAnomalyModel.fit(baseline_rows(spark, sf)).nodes


@query
def anomaly_scores(spark, sf):
    rows = baseline_rows(spark, sf)
    return iforest.WindowAnomalyModel.fit(rows).score(rows).select(
        "src_ip", "window_start_us", "anomaly_score", "is_anomaly"
    )


@query
def contamination_flag(spark, sf):
    rows = window_rows(spark, sf).select(
        "src_ip", "window_start_us", (-(F.col("total_bytes") / F.col("flow_count"))).alias("raw_score")
    )
    return iforest.flag_by_share(rows)


# --- evaluation and summaries -------------------------------------------------


@query
def metrics_binary(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))
    return evaluate.binary_metrics(rows)


def _nine_places(rows: DataFrame) -> DataFrame:
    # Class means add up in no fixed order.
    return rows.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


@query
def metrics_macro(spark, sf):
    return _nine_places(evaluate.macro_metrics(prediction_view(spark, sf).where("model = 'a'")))


@query
def metrics_by_model(spark, sf):
    return _nine_places(evaluate.macro_metrics(prediction_view(spark, sf), ["model"]))


@query
def dataset_counts(spark, sf):
    return evaluate.dataset_counts(table(spark, sf, "events"), "train")


@query
def class_distribution(spark, sf):
    return evaluate.class_distribution(connection_view(spark, sf).select("label"))


@query
def label_distribution(spark, sf):
    return evaluate.label_distribution(connection_view(spark, sf))


@query
def category_rollup(spark, sf):
    return evaluate.category_rollup(connection_view(spark, sf))


# --- patterns -----------------------------------------------------------------


@query
def transactions(spark, sf):
    rows = patterns.transactions(connection_view(spark, sf), ["seq"])
    return rows.select("seq", F.array_join("items", ", ").alias("items"))


@query
def frequent_itemsets(spark, sf):
    rows = patterns.frequent_itemsets(connection_view(spark, sf))
    return rows.select(F.array_join("items", ", ").alias("items"), "rows", "support")


@query
def frequent_itemsets_baskets(spark, sf):
    rows = patterns.frequent_itemsets_general(patterns.transactions(connection_view(spark, sf)))
    return rows.select(F.array_join("items", ", ").alias("items"), "rows", "support")


@query
def association_rules(spark, sf):
    return patterns.association_rules(patterns.frequent_itemsets(connection_view(spark, sf)))


@query
def rules_top50(spark, sf):
    return patterns.mine_rules(connection_view(spark, sf))


# --- alerts and views ---------------------------------------------------------


def alert_events(spark, sf) -> DataFrame:
    """Scored connections in 10 s batches of three tenants."""
    return connection_view(spark, sf).selectExpr(
        "concat('t', src_port % 3) as tenant",
        f"ts_us div {BATCH_US} as batch_id",
        f"cast((ts_us div {BATCH_US} + 1) * {BATCH_US // 1_000_000} as double) as now",
        "src_ip",
        "label <> 'normal' as is_attack",
    )


def scored_windows(spark, sf) -> DataFrame:
    """Source windows with a score made from their fan-out, in the batch after they close."""
    host = F.substring_index("src_ip", ".", -1).cast("bigint")
    closed = F.expr(f"(window_start_us + 60000000) div {BATCH_US}")
    return window_rows(spark, sf).select(
        F.concat(F.lit("t"), (40000 + host) % 3).alias("tenant"),
        closed.alias("batch_id"),
        ((closed + 1) * (BATCH_US // 1_000_000)).cast("double").alias("now"),
        (F.expr("window_start_us div 60000000") * 32 + host).alias("seq"),
        "src_ip",
        "window_start_us",
        "flow_count",
        (F.col("distinct_dst_ports") / 100 - 0.11).alias("score"),
    ).withColumn("anomaly_score", F.round("score", 4)).withColumn("is_anomaly", F.col("anomaly_score") > 0).drop("score")


@query
def alert_inputs(spark, sf):
    rows = alerts.attack_inputs(alert_events(spark, sf), sets=True)
    return rows.withColumn("sources", F.array_join("sources", ","))


@query
def worst_anomaly(spark, sf):
    return alerts.anomaly_inputs(scored_windows(spark, sf).where("is_anomaly"))


def alert_rows(spark, sf) -> DataFrame:
    events, scored = alert_events(spark, sf), scored_windows(spark, sf).where("is_anomaly")
    batches = alerts.alert_batches(alerts.attack_inputs(events), alerts.anomaly_inputs(scored))
    keys = ["tenant", "batch_id", "src_ip"]
    sources = events.where("is_attack").select(*keys).unionByName(scored.select(*keys))
    return alerts.alerts(alerts.throttle(batches), sources)


@query
def alert_replay(spark, sf):
    rows = alert_rows(spark, sf)
    return rows.withColumn("listed", F.array_join("listed", ","))


@query
def alert_message(spark, sf):
    return alert_rows(spark, sf).select("tenant", "alert_no", alerts.alert_message().alias("message"))


@query
def alert_payload(spark, sf):
    box = alerts.outbox(alert_rows(spark, sf), alerts.CHANNEL_KINDS)
    return box.select("tenant", "alert_no", "kind", "payload")


@query
def alert_status(spark, sf):
    box = alerts.outbox(alert_rows(spark, sf), ["ntfy", "slack"])
    failed = (F.col("kind") == "slack") & (F.col("alert_no") % 4 == 0)
    return alerts.alert_status(box.withColumn("delivered", ~failed))


@query
def live_recent(spark, sf):
    return views.live_recent(event_rows(spark, sf).select("seq", "service", "flag", "label", "is_attack"), 50)


@query
def attack_log(spark, sf):
    log = event_rows(spark, sf).where("is_attack").select("seq", "service", "flag", "has_file_activity")
    return views.attack_log(log, 100, files_only=True)


@query
def anomalies_recent(spark, sf):
    return views.anomalies_recent(scored_windows(spark, sf).drop("tenant", "now"), 50, anomalies_only=True)


@query
def live_counts(spark, sf):
    return views.view_counts(views.live_recent(event_rows(spark, sf), 50), "is_attack", "attacks")


@query
def anomaly_counts(spark, sf):
    return views.view_counts(views.anomalies_recent(scored_windows(spark, sf), 200), "is_anomaly", "anomalies")


@query
def anomaly_status(spark, sf):
    conns = connection_view(spark, sf)
    closed = windows.closed_windows(windows.source_windows(conns), NOW_US)
    still = windows.open_window_count(conns, NOW_US)
    return views.anomaly_status(closed, still, False, windows.WINDOW_SECONDS)


from packetloom.plans import round_trips  # noqa: E402, F401  registers its queries
