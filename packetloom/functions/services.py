"""Service names of connections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.literals import literal_map

# Responder port -> service name.
TCP_SERVICES = {
    7: "echo", 9: "discard", 11: "systat", 13: "daytime", 15: "netstat",
    20: "ftp_data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp",
    37: "time", 42: "name", 43: "whois", 53: "domain", 57: "mtp",
    70: "gopher", 77: "rje", 79: "finger", 80: "http", 84: "ctf",
    87: "link", 95: "supdup", 101: "hostnames", 102: "iso_tsap",
    105: "csnet_ns", 109: "pop_2", 110: "pop_3", 111: "sunrpc",
    113: "auth", 117: "uucp_path", 119: "nntp", 139: "netbios_ssn",
    143: "imap4", 150: "sql_net", 179: "bgp", 210: "Z39_50",
    389: "ldap", 433: "nnsp", 443: "http_443", 512: "exec",
    513: "login", 514: "shell", 515: "printer", 530: "courier",
    540: "uucp", 543: "klogin", 544: "kshell", 2784: "http_2784",
    5190: "aol", 6000: "X11", 6667: "IRC", 8001: "http_8001",
}
UDP_SERVICES = {53: "domain_u", 69: "tftp_u", 123: "ntp_u", 137: "netbios_ns", 138: "netbios_dgm"}
# ICMP message type -> service name.
ICMP_SERVICES = {0: "ecr_i", 5: "red_i", 8: "eco_i", 11: "tim_i", 13: "tim_i", 14: "tim_i"}


def _lookup(names: dict[int, str], key: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(literal_map(names), key.cast("int")), F.lit(default))


def service_name(proto: Column, port: Column, icmp_type: Column, icmp_code: Column) -> Column:
    """Service of a connection from its responder port, or from the ICMP message."""
    unreachable = F.when(icmp_code == 3, "urp_i").otherwise("urh_i")
    icmp = F.when(icmp_type == 3, unreachable).otherwise(_lookup(ICMP_SERVICES, icmp_type, "oth_i"))
    return (
        F.when(proto == "icmp", icmp)
        .when(proto == "tcp", _lookup(TCP_SERVICES, port, "private"))
        .when(proto == "udp", _lookup(UDP_SERVICES, port, "private"))
        .otherwise("other")
    )
