"""Column lists and struct types shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and order of the labelled-connection files
# (the public NSL-KDD layout: 41 features, label, difficulty).
CONNECTION_FEATURES = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes",
    "land", "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in",
    "num_compromised", "root_shell", "su_attempted", "num_root",
    "num_file_creations", "num_shells", "num_access_files", "num_outbound_cmds",
    "is_host_login", "is_guest_login", "count", "srv_count", "serror_rate",
    "srv_serror_rate", "rerror_rate", "srv_rerror_rate", "same_srv_rate",
    "diff_srv_rate", "srv_diff_host_rate", "dst_host_count", "dst_host_srv_count",
    "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate",
    "dst_host_serror_rate", "dst_host_srv_serror_rate", "dst_host_rerror_rate",
    "dst_host_srv_rerror_rate",
]
CATEGORICAL_FEATURES = ["protocol_type", "service", "flag"]
NUMERIC_FEATURES = [c for c in CONNECTION_FEATURES if c not in CATEGORICAL_FEATURES]
CONTENT_FEATURES = CONNECTION_FEATURES[9:22]

# Flow feature -> header text in the daily flow files (the
# public CIC-IDS2017 layout).
FLOW_COLUMN_NAMES = {
    "dst_port": "Destination Port",
    "flow_duration": "Flow Duration",
    "tot_fwd_pkts": "Total Fwd Packets",
    "tot_bwd_pkts": "Total Backward Packets",
    "tot_fwd_bytes": "Total Length of Fwd Packets",
    "tot_bwd_bytes": "Total Length of Bwd Packets",
    "fwd_pkt_len_max": "Fwd Packet Length Max",
    "fwd_pkt_len_min": "Fwd Packet Length Min",
    "fwd_pkt_len_mean": "Fwd Packet Length Mean",
    "fwd_pkt_len_std": "Fwd Packet Length Std",
    "bwd_pkt_len_max": "Bwd Packet Length Max",
    "bwd_pkt_len_min": "Bwd Packet Length Min",
    "bwd_pkt_len_mean": "Bwd Packet Length Mean",
    "bwd_pkt_len_std": "Bwd Packet Length Std",
    "flow_bytes_per_s": "Flow Bytes/s",
    "flow_pkts_per_s": "Flow Packets/s",
    "flow_iat_mean": "Flow IAT Mean",
    "flow_iat_std": "Flow IAT Std",
    "flow_iat_max": "Flow IAT Max",
    "flow_iat_min": "Flow IAT Min",
    "fwd_iat_mean": "Fwd IAT Mean",
    "bwd_iat_mean": "Bwd IAT Mean",
    "fin_flag_cnt": "FIN Flag Count",
    "syn_flag_cnt": "SYN Flag Count",
    "rst_flag_cnt": "RST Flag Count",
    "psh_flag_cnt": "PSH Flag Count",
    "ack_flag_cnt": "ACK Flag Count",
    "urg_flag_cnt": "URG Flag Count",
    "down_up_ratio": "Down/Up Ratio",
    "avg_pkt_size": "Average Packet Size",
    "init_win_bytes_fwd": "Init_Win_bytes_forward",
    "init_win_bytes_bwd": "Init_Win_bytes_backward",
}
FLOW_FEATURES = list(FLOW_COLUMN_NAMES)

# The per-source window features, in model order.
WINDOW_FEATURES = [
    "flow_count", "distinct_dst_ports", "distinct_dst_hosts", "failed_ratio",
    "ports_per_host", "total_bytes", "mean_bytes",
]

# Host-impact counts that live events carry along.
FILE_ACTIVITY_COLUMNS = [
    "num_file_creations", "num_access_files", "num_shells", "num_root",
    "root_shell", "num_compromised", "hot",
]

REQUIRED_FEATURES = {"nsl": CONNECTION_FEATURES, "cic": FLOW_FEATURES}


def _fields(names: list[str], kinds: dict[str, T.DataType], default: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kinds.get(n, default)) for n in names]


_TEXT = {c: T.StringType() for c in CATEGORICAL_FEATURES}

CONNECTION_FEATURE_SCHEMA = T.StructType(_fields(CONNECTION_FEATURES, _TEXT, T.DoubleType()))

LABELLED_CONNECTION_SCHEMA = T.StructType(
    CONNECTION_FEATURE_SCHEMA.fields
    + [T.StructField("label", T.StringType()), T.StructField("difficulty", T.IntegerType())]
)

META_SCHEMA = T.StructType(
    [
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("flag", T.StringType()),
        T.StructField("bytes", T.LongType()),
    ]
)

PACKET_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("us", T.LongType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("proto", T.StringType()),
        T.StructField("payload_len", T.LongType()),
        T.StructField("ip_len", T.LongType()),
        T.StructField("tcp_flags", T.StringType()),
        T.StructField("tcp_window", T.IntegerType()),
        T.StructField("icmp_type", T.IntegerType()),
        T.StructField("icmp_code", T.IntegerType()),
        T.StructField("is_fragment", T.BooleanType()),
    ]
)

WINDOW_SCHEMA = T.StructType(
    [T.StructField("src_ip", T.StringType()), T.StructField("window_start", T.DoubleType())]
    + _fields(
        WINDOW_FEATURES,
        {c: T.LongType() for c in ("flow_count", "distinct_dst_ports", "distinct_dst_hosts")},
        T.DoubleType(),
    )
)


def live_record_schema(dataset: str) -> T.StructType:
    """Schema of the live record stream for one feature set, ``meta`` included."""
    if dataset == "nsl":
        features = CONNECTION_FEATURE_SCHEMA.fields
    elif dataset == "cic":
        features = _fields(FLOW_FEATURES, {}, T.DoubleType()) + _fields(CATEGORICAL_FEATURES, _TEXT, T.StringType())
    else:
        raise ValueError(f"unknown dataset {dataset!r}; expected one of {sorted(REQUIRED_FEATURES)}")
    return T.StructType(features + [T.StructField("meta", META_SCHEMA)])
