"""Decoded header rows to packet rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# IP protocol numbers that are assembled.
PROTOCOLS = {1: "icmp", 6: "tcp", 17: "udp"}


def is_supported() -> Column:
    return (F.col("ip_version") == 4) & F.col("ip_proto").isin(list(PROTOCOLS))


def is_broken() -> Column:
    """Rows without time or addresses."""
    return F.col("us").isNull() | F.col("src_ip").isNull() | F.col("dst_ip").isNull()


def normalize_packets(headers: DataFrame) -> DataFrame:
    """Packet rows of the supported header rows that have a time and addresses.

    ``headers``: seq, us, ip_version, ip_proto, src_ip, dst_ip, src_port,
    dst_port, header_len, payload_len, ip_len (null when the header has none),
    frag_offset, more_fragments, tcp_flags, tcp_window, icmp_type, icmp_code.
    """
    name = F.element_at(F.create_map(*[F.lit(x) for kv in PROTOCOLS.items() for x in kv]), F.col("ip_proto").cast("int"))
    is_tcp, is_icmp = F.col("proto") == "tcp", F.col("proto") == "icmp"
    return headers.where(is_supported() & ~is_broken()).withColumn("proto", name).select(
        "seq",
        "us",
        "src_ip",
        "dst_ip",
        F.when(is_icmp, 0).otherwise(F.col("src_port")).alias("src_port"),
        F.when(is_icmp, 0).otherwise(F.col("dst_port")).alias("dst_port"),
        "proto",
        "payload_len",
        F.coalesce("ip_len", F.col("header_len") + F.col("payload_len")).alias("ip_len"),
        F.when(is_tcp, F.coalesce("tcp_flags", F.lit(""))).otherwise("").alias("tcp_flags"),
        F.when(is_tcp, F.col("tcp_window")).otherwise(-1).alias("tcp_window"),
        F.when(is_icmp, F.col("icmp_type")).otherwise(-1).alias("icmp_type"),
        F.when(is_icmp, F.col("icmp_code")).otherwise(-1).alias("icmp_code"),
        ((F.col("frag_offset") > 0) | F.col("more_fragments")).alias("is_fragment"),
    )


def is_own_traffic(host: str, port: int) -> Column:
    """The collector's own connections to its API."""
    return (
        (F.col("proto") == "tcp")
        & ((F.col("src_port") == port) | (F.col("dst_port") == port))
        & ((F.col("src_ip") == host) | (F.col("dst_ip") == host))
    )


def drop_own_traffic(packets: DataFrame, host: str, port: int) -> DataFrame:
    return packets.where(~is_own_traffic(host, port))


def packet_counts(host: str, port: int) -> dict[str, Column]:
    """packets, non_ip, own and errors (broken rows) of header rows, as aggregates for ``agg`` or ``observe``."""
    broken = is_broken()
    own = (
        (F.col("ip_proto") == 6)
        & ((F.col("src_port") == port) | (F.col("dst_port") == port))
        & ((F.col("src_ip") == host) | (F.col("dst_ip") == host))
    )
    return {
        "packets": F.count(F.lit(1)),
        "non_ip": F.count_if(~broken & ~is_supported()),
        "own": F.count_if(~broken & is_supported() & own),
        "errors": F.count_if(broken),
    }


def packet_counters(headers: DataFrame, host: str, port: int) -> DataFrame:
    """The counts of a table in one pass."""
    return headers.agg(*[c.alias(n) for n, c in packet_counts(host, port).items()])


def connection_counters(conns: DataFrame, now_us: int, idle_us: dict[str, int]) -> DataFrame:
    """open and finalized connections at ``now_us``.

    ``closed`` marks TCP connections ended by FIN or RST; the others are open
    until they have been silent for longer than the timeout.
    """
    limit = F.when(F.col("proto") == "tcp", idle_us["tcp"]).when(F.col("proto") == "udp", idle_us["udp"])
    silent = F.lit(now_us) - F.col("ts_us") > limit.otherwise(idle_us["icmp"])
    done = F.col("closed") | silent
    return conns.agg(F.count_if(~done).alias("open"), F.count_if(done).alias("finalized"))


def pipeline_counters(
    headers: DataFrame, conns: DataFrame, host: str, port: int, now_us: int, idle_us: dict[str, int]
) -> DataFrame:
    """All counters as one row (two one-row aggregates side by side)."""
    first = packet_counters(headers, host, port).withColumn("at", F.lit(0))
    second = connection_counters(conns, now_us, idle_us).withColumn("at", F.lit(0))
    return first.join(second, "at").drop("at")
