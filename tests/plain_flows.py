"""A plain-Python account of connection assembly, to check the Spark one against."""

IDLE = {"tcp": 30_000_000, "udp": 10_000_000, "icmp": 5_000_000}


def assemble(packets):
    """{seq: seq of its connection's first packet, or None when absorbed}."""
    owner, tuples = {}, {}
    for p in sorted(packets, key=lambda p: (p["us"], p["seq"])):
        ends = frozenset([(p["src_ip"], p["src_port"]), (p["dst_ip"], p["dst_port"])])
        t = tuples.setdefault((p["proto"], ends), {"conn": None, "closed": None})
        conn, flags = t["conn"], p["tcp_flags"] or ""
        if conn and p["us"] - conn["last"] > IDLE[p["proto"]]:
            conn = t["conn"] = None
            t["closed"] = None
        if conn is None:
            residue = t["closed"] is not None and p["us"] - t["closed"] <= 2_000_000
            if residue and not ("S" in flags and "A" not in flags):
                owner[p["seq"]] = None
                continue
            conn = t["conn"] = {"id": p["seq"], "from": (p["src_ip"], p["src_port"]), "fins": set(), "rst": False, "n": 0}
        side = (p["src_ip"], p["src_port"]) == conn["from"]
        conn["last"] = p["us"]
        conn["n"] += 1
        owner[p["seq"]] = conn["id"]
        if p["proto"] != "tcp":
            continue
        if "F" in flags:
            conn["fins"].add(side)
        conn["rst"] |= "R" in flags
        if conn["n"] > 1 and (conn["rst"] or len(conn["fins"]) == 2):
            t["conn"], t["closed"] = None, p["us"]
    return owner
