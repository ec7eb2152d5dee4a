"""Binds the generic operator inputs to the supplied tables.

``events`` becomes connections and packets (time runs 1000 times faster so
that windows hold several rows), ``lineitem`` and ``embeddings`` become
feature tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.services import service_name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_REL_US = "timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 1000"


def connection_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled connections from ``events``: one per event, ``seq`` dense in time order."""
    base = table(spark, sf_dir, "events").selectExpr(
        "event_id as seq",
        f"{_REL_US} as ts_us",
        "user_id",
        "event_type",
        "cast(floor(value * 100) as bigint) as bytes",
        "cast(get_json_object(props, '$.k') as int) as k",
    )
    rows = base.selectExpr(
        "seq",
        "ts_us",
        "concat('10.0.0.', user_id % 32) as src_ip",
        "cast(40000 + user_id % 32 as int) as src_port",
        "concat('192.168.0.', (user_id + k) % 16) as dst_ip",
        "k as dst_port",
        "case when seq % 10 = 0 then 'icmp' when seq % 10 < 3 then 'udp' else 'tcp' end as proto",
        "case event_type when 'click' then 'SF' when 'view' then 'SF' when 'purchase' then 'RSTR'"
        " when 'signup' then 'S0' else 'REJ' end as flag",
        "case when event_type in ('click', 'view') then 'normal' when event_type = 'purchase' then 'guess_passwd'"
        " when event_type = 'signup' then 'neptune' else 'satan' end as label",
        "bytes",
    )
    service = service_name(F.col("proto"), F.col("dst_port"), F.col("dst_port") % 16, F.col("dst_port") % 4)
    return rows.withColumns(
        {
            "service": service,
            "duration": F.expr("bytes div 1000"),
            "src_bytes": F.expr("bytes - bytes div 3"),
            "dst_bytes": F.expr("bytes div 3"),
            "land": ((F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") == F.col("dst_port"))).cast("int"),
            "wrong_fragment": F.expr("cast(seq % 97 = 0 as int)"),
            "urgent": F.expr("cast(seq % 89 = 0 as int)"),
            "protocol_type": F.col("proto"),
            "logged_in": (F.col("flag") == "SF").cast("int"),
            "is_guest_login": F.expr("cast(seq % 5 = 0 as int)"),
            "num_file_creations": F.expr("cast(bytes % 7 as int)"),
            "num_access_files": F.expr("cast(bytes % 3 as int)"),
        }
    )


def packet_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets from ``events`` in which every connection state occurs."""
    base = table(spark, sf_dir, "events").selectExpr(
        "event_id as seq",
        f"{_REL_US} as us",
        "user_id % 32 as t",
        "event_id % 2 = 0 as fwd",
        "event_type as et",
        "case when event_type = 'click' then cast(floor(value) as bigint) else 0 end as size",
    )
    ends = base.selectExpr(
        "*",
        "case when t % 8 = 1 then 'icmp' when t % 8 = 0 then 'udp' else 'tcp' end as proto",
        "concat('10.0.0.', t) as cip",
        "concat('192.168.0.', t % 16) as sip",
        "cast(case when t % 8 = 1 then 0 else 40000 + t end as int) as cport",
        "case when t % 8 = 1 then 0 when t % 8 = 0 then 53 when t % 4 = 2 then 80"
        " when t % 4 = 3 then 443 when t % 8 = 4 then 22 else 25 end as sport",
    )
    return ends.selectExpr(
        "seq",
        "us",
        "case when fwd then cip else sip end as src_ip",
        "case when fwd then sip else cip end as dst_ip",
        "case when fwd then cport else sport end as src_port",
        "case when fwd then sport else cport end as dst_port",
        "proto",
        "size as payload_len",
        "40 + size as ip_len",
        "case when proto <> 'tcp' then '' when et = 'signup' then (case when fwd then 'S' else 'SA' end)"
        " when et = 'view' then 'A' when et = 'click' then 'PA' when et = 'purchase' then 'FA'"
        " when fwd then 'R' else 'RA' end as tcp_flags",
        "cast(case when proto = 'tcp' then 64240 - seq % 1000 else -1 end as int) as tcp_window",
        "case when proto = 'icmp' then (case when fwd then 8 else 0 end) else -1 end as icmp_type",
        "case when proto = 'icmp' then 0 else -1 end as icmp_code",
        "seq % 97 = 0 as is_fragment",
    )


def header_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded header rows: the packets plus rows that normalisation drops or repairs."""
    packets = packet_view(spark, sf_dir)
    return packets.selectExpr(
        "seq",
        "case when seq % 103 = 0 then null else us end as us",
        "case when seq % 19 = 0 then 6 else 4 end as ip_version",
        "case when seq % 23 = 0 then 47 when proto = 'tcp' then 6 when proto = 'udp' then 17 else 1 end as ip_proto",
        "case when seq % 101 = 0 then null else src_ip end as src_ip",
        "case when seq % 107 = 0 then null else dst_ip end as dst_ip",
        "src_port",
        "dst_port",
        "40 as header_len",
        "payload_len",
        "case when seq % 11 = 0 then null else ip_len end as ip_len",
        "case when is_fragment then 185 else 0 end as frag_offset",
        "seq % 89 = 0 as more_fragments",
        "tcp_flags",
        "tcp_window",
        "icmp_type",
        "icmp_code",
    )


def raw_number_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text features with the faults of raw flow files, from ``lineitem``."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "case when l_partkey % 13 = 0 then 'Infinity' when l_partkey % 17 = 0 then 'n/a'"
        " when l_partkey % 19 = 0 then '5d' when l_partkey % 23 = 0 then '2.5F'"
        " else cast(cast(l_extendedprice * 100 as bigint) as string) end as price",
        "case when l_suppkey % 11 = 0 then 'NaN' else cast(cast(l_quantity as bigint) as string) end as quantity",
        "cast(l_linenumber - 2 as string) as flow_duration",
        "concat(' ', l_returnflag, char(9)) as label",
    )


def feature_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed features with a rule-made label, from ``lineitem``."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber as row_id",
        "l_returnflag",
        "l_linestatus",
        "l_quantity as quantity",
        "l_extendedprice as price",
        "l_discount as discount",
        "l_tax as tax",
        "case when l_quantity > 25 and l_discount > 0.05 then 1 else 0 end as label",
    )


def embedding_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def prediction_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-class truth and predictions of three rule-based models over connections."""
    rows = connection_view(spark, sf_dir).selectExpr(
        "seq",
        "case label when 'normal' then 0 when 'neptune' then 1 when 'satan' then 2 else 3 end as label",
        "case when flag = 'SF' then 0 when bytes % 3 = 0 then 1 when flag = 'REJ' then 2 else 4 end as m_a",
        "case when dst_port < 50 then 0 when flag = 'S0' then 1 else 3 end as m_b",
        "0 as m_c",
    )
    return rows.selectExpr("seq", "label", "stack(3, 'a', m_a, 'b', m_b, 'c', m_c) as (model, prediction)")
