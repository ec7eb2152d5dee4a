"""Connection assembly over a packet stream.

Packets wait in state until the watermark has passed them and are then taken in (time, arrival) order, as a table's
packets are, so files out of order give the same connections as long as no packet is later than the delay.  Per tuple
the state holds those packets by slices of time, the summary of one open connection (or the time of the last close) and
one timer.  A batch reads and writes the slices that its packets fall into, a timer those that came due, so neither
depends on how many packets wait.

The close rule is ``next_state`` of the batch operator.  The packets of a connection that come due together are
summed up by column operations, and summaries are merged; completed connections leave with the columns of
``flow_aggregates``, so the same projections turn them into records.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from packetloom.operators.flows import FRESH, GRACE_US, IDLE_US, TUPLE, Tuple5State, canonical_tuple, connection_records, next_state, of_sensors

FLAG_COUNTS = {f"n_{c.lower()}": c for c in "FSRPAU"}
BITS = ["syn_seen", "synack_seen", "orig_fin", "resp_fin", "orig_rst", "resp_rst"]
COUNTERS = [
    "fwd_pkts", "bwd_pkts", "src_bytes", "dst_bytes", "fwd_bytes", "bwd_bytes", "wrong_fragment", "urgent", *FLAG_COUNTS,
]
SPREADS = ["fwd_pkt_len", "bwd_pkt_len", "flow_iat"]
MARKS = ["flow_us", "flow_seq", "last_us", "prev_us", "icmp_type", "icmp_code", "init_win_bytes_fwd", "init_win_bytes_bwd"]
SPANS = ["fwd_first", "fwd_last", "bwd_first", "bwd_last"]

STATE_SCHEMA = T.StructType(
    [T.StructField("is_open", T.BooleanType()), T.StructField("closed_us", T.LongType()), T.StructField("timer_ms", T.LongType())]
    + [T.StructField("flow_up", T.BooleanType())]
    + [T.StructField(c, T.LongType()) for c in MARKS + SPANS + COUNTERS]
    + [T.StructField(f"{s}_{m}", T.DoubleType()) for s in SPREADS for m in ("n", "sum", "sq", "max", "min")]
    + [T.StructField(b, T.BooleanType()) for b in BITS]
)
STATE_NAMES = STATE_SCHEMA.names

OUTPUT_SCHEMA = T.StructType(
    [
        T.StructField("sensor", T.StringType()),
        T.StructField("proto", T.StringType()),
        T.StructField("lo_ip", T.StringType()),
        T.StructField("lo_port", T.IntegerType()),
        T.StructField("hi_ip", T.StringType()),
        T.StructField("hi_port", T.IntegerType()),
        T.StructField("flow_us", T.LongType()),
        T.StructField("flow_seq", T.LongType()),
        T.StructField("flow_up", T.BooleanType()),
        T.StructField("last_us", T.LongType()),
        T.StructField("icmp_type", T.IntegerType()),
        T.StructField("icmp_code", T.IntegerType()),
        *[T.StructField(c, T.LongType()) for c in COUNTERS],
        *[T.StructField(f"{s}_{m}", T.DoubleType()) for s in SPREADS for m in ("max", "min", "mean", "std")],
        T.StructField("fwd_span", T.LongType()),
        T.StructField("bwd_span", T.LongType()),
        T.StructField("init_win_bytes_fwd", T.IntegerType()),
        T.StructField("init_win_bytes_bwd", T.IntegerType()),
        *[T.StructField(b, T.BooleanType()) for b in BITS],
    ]
)


# Width of a slice of waiting packets.
SLICE_US = 1_000_000
SLICE_KEY = T.StructType([T.StructField("slice", T.LongType())])
SLICE_VALUE = T.StructType([T.StructField("packets", T.BinaryType())])

PENDING_SCHEMA = T.StructType(
    [
        T.StructField("us", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("up", T.BooleanType()),
        T.StructField("payload_len", T.LongType()),
        T.StructField("ip_len", T.LongType()),
        T.StructField("tcp_flags", T.StringType()),
        T.StructField("tcp_window", T.IntegerType()),
        T.StructField("icmp_type", T.IntegerType()),
        T.StructField("icmp_code", T.IntegerType()),
        T.StructField("is_fragment", T.BooleanType()),
    ]
)


def _blank(closed_us: int | None = None, timer_ms: int | None = None) -> dict:
    c = dict.fromkeys(STATE_NAMES)
    return c | {"is_open": False, "closed_us": closed_us, "timer_ms": timer_ms}


def _cuts(c: dict, packets: pd.DataFrame, tcp: bool, idle: int) -> Iterator[tuple[int, int, int | None, bool]]:
    """Runs of packets of one connection each, in order: (begin, end, time of its close, whether it ended).

    The first run may go on with the open connection of the state; an empty run tells that silence ended it.
    """
    state = FRESH._replace(closed_us=c["closed_us"])
    last = None
    if c["is_open"]:
        reset = bool(c["orig_rst"] or c["resp_rst"])
        state = Tuple5State(c["flow_us"], c["flow_seq"], c["flow_up"], bool(c["orig_fin"]), bool(c["resp_fin"]), reset, None)
        last = c["last_us"]
    flags = packets["tcp_flags"].fillna("") if tcp else pd.Series("", index=packets.index)
    has = {letter: flags.str.contains(letter, regex=False).to_numpy() for letter in "SAFR"}
    rows = zip(packets["us"], packets["seq"], packets["up"], has["S"] & ~has["A"], has["F"], has["R"])
    begin = 0
    for i, (us, seq, up, syn, fin, rst) in enumerate(rows):
        if state.flow_seq is not None and us - last > idle:
            yield begin, i, None, True
            state = FRESH
        opened = state.flow_seq is None
        state, kept = next_state(state, us, seq, up, bool(syn), bool(fin), bool(rst))
        if not kept:
            continue
        begin, last = (i, us) if opened else (begin, max(last, us))
        if state.flow_seq is None:
            yield begin, i + 1, state.closed_us, True
    if state.flow_seq is not None:
        yield begin, len(packets), None, False


def _summary(packets: pd.DataFrame, flow_up: bool, before_us: int | None, tcp: bool) -> dict:
    """What a run of packets adds to its connection, by whole columns."""
    forward = (packets["up"] == flow_up).to_numpy(bool)
    us, size = packets["us"].to_numpy(), packets["ip_len"].to_numpy(float)
    flags = packets["tcp_flags"].fillna("") if tcp else pd.Series("", index=packets.index)
    has = {letter: flags.str.contains(letter, regex=False).to_numpy() for letter in "FSRPAU"}
    window = packets["tcp_window"].to_numpy() if tcp else np.full(len(us), -1)
    gaps = np.diff(us if before_us is None else np.append(before_us, us)).astype(float)
    out = {"prev_us": int(us[-1]), "last_us": int(us.max()), "wrong_fragment": int(packets["is_fragment"].fillna(False).sum())}
    out |= {name: int(has[letter].sum()) for name, letter in FLAG_COUNTS.items()} | {"urgent": int(has["U"].sum())}
    for side, origin, of in (("fwd", "src", forward), ("bwd", "dst", ~forward)):
        out[f"{side}_pkts"] = int(of.sum())
        out[f"{side}_bytes"] = int(size[of].sum())
        out[f"{origin}_bytes"] = int(packets["payload_len"].to_numpy()[of].sum())
        out[f"{side}_first"], out[f"{side}_last"] = (int(us[of][0]), int(us[of][-1])) if of.any() else (None, None)
        known = window[of & (window >= 0)]
        out[f"init_win_bytes_{side}"] = int(known[0]) if len(known) else -1
    for name, values in (("fwd_pkt_len", size[forward]), ("bwd_pkt_len", size[~forward]), ("flow_iat", gaps)):
        out |= {f"{name}_n": float(len(values)), f"{name}_sum": float(values.sum()), f"{name}_sq": float((values**2).sum())}
        out |= {f"{name}_max": float(values.max(initial=-math.inf)), f"{name}_min": float(values.min(initial=math.inf))}
    ends = {"orig": forward, "resp": ~forward}
    out |= {f"{who}_fin": bool((has["F"] & of).any()) for who, of in ends.items()}
    out |= {f"{who}_rst": bool((has["R"] & of).any()) for who, of in ends.items()}
    out["syn_seen"] = bool((forward & has["S"] & ~has["A"]).any())
    out["synack_seen"] = bool((~forward & has["S"] & has["A"]).any())
    return out


def _merged(c: dict, more: dict) -> dict:
    """A connection's summary with a later one of its packets."""
    out = dict(c)
    for name in [*COUNTERS, *(f"{s}_{m}" for s in SPREADS for m in ("n", "sum", "sq"))]:
        out[name] = c[name] + more[name]
    for s in SPREADS:
        out[f"{s}_max"], out[f"{s}_min"] = max(c[f"{s}_max"], more[f"{s}_max"]), min(c[f"{s}_min"], more[f"{s}_min"])
    for name in BITS:
        out[name] = c[name] or more[name]
    for side in ("fwd", "bwd"):
        win, first, last = f"init_win_bytes_{side}", f"{side}_first", f"{side}_last"
        out[win] = c[win] if c[win] >= 0 else more[win]
        out[first] = c[first] if c[first] is not None else more[first]
        out[last] = more[last] if more[last] is not None else c[last]
    out["last_us"], out["prev_us"] = max(c["last_us"], more["last_us"]), more["prev_us"]
    return out


def _advance(key: tuple, c: dict, packets: pd.DataFrame, idle: int) -> tuple[dict, list[dict]]:
    """The state after packets that came due (in order), and the connections they completed."""
    tcp, done = key[1] == "tcp", []
    for begin, end, closed_us, ended in _cuts(c, packets, tcp, idle):
        run = packets.iloc[begin:end]
        if len(run) and c["is_open"]:
            c = _merged(c, _summary(run, c["flow_up"], c["prev_us"], tcp))
        elif len(run):
            head = run.iloc[0]
            found = _summary(run, bool(head["up"]), None, tcp)
            c = _blank(timer_ms=c["timer_ms"]) | found | {
                "is_open": True, "flow_us": int(head["us"]), "flow_seq": int(head["seq"]), "flow_up": bool(head["up"]),
                "icmp_type": int(head["icmp_type"]), "icmp_code": int(head["icmp_code"]),
            }
        if ended:
            done.append(_finished(key, c))
            c = _blank(closed_us, c["timer_ms"])
    return c, done


def _finished(key: tuple, c: dict) -> dict:
    row = dict(zip(TUPLE, key)) | {n: c[n] for n in OUTPUT_SCHEMA.names if n in c}
    for s in SPREADS:
        n = c[f"{s}_n"]
        mean = c[f"{s}_sum"] / n if n else 0.0
        row |= {
            f"{s}_max": c[f"{s}_max"] if n else 0.0,
            f"{s}_min": c[f"{s}_min"] if n else 0.0,
            f"{s}_mean": mean,
            f"{s}_std": math.sqrt(max(c[f"{s}_sq"] / n - mean * mean, 0.0)) if n else 0.0,
        }
    for side in ("fwd", "bwd"):
        first, last = c[f"{side}_first"], c[f"{side}_last"]
        row[f"{side}_span"] = last - first if first is not None else 0
    return row


class ConnectionAssembler(StatefulProcessor):
    """Follows one tuple."""

    def __init__(self, idle_us: dict[str, int], slice_us: int = SLICE_US):
        self.idle_us, self.slice_us = idle_us, slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("connection", STATE_SCHEMA)
        self.pending = handle.getMapState("pending", SLICE_KEY, SLICE_VALUE)

    def _load(self) -> dict:
        return dict(zip(STATE_NAMES, self.state.get())) if self.state.exists() else _blank()

    def _store(self, idle: int, c: dict, now_ms: int, waiting_us: int | None) -> None:
        """Keep the state while a packet could still touch it; one timer wakes it."""
        due = [] if waiting_us is None else [waiting_us]
        if c["is_open"]:
            due.append(c["last_us"] + idle)
        elif c["closed_us"] is not None:
            due.append(c["closed_us"] + GRACE_US)
        if not due:
            self.state.clear()
            return
        # Strictly later than what it waits for, and never in the past.
        wake = max(min(due) // 1000 + 1, now_ms + 1)
        if c["timer_ms"] is None or wake < c["timer_ms"]:
            c["timer_ms"] = wake
            self.handle.registerTimer(wake)
        self.state.update(tuple(c[n] for n in STATE_NAMES))

    def _slice(self, number: int) -> list[tuple]:
        return pickle.loads(self.pending.getValue((number,))[0]) if self.pending.containsKey((number,)) else []

    def _keep(self, number: int, packets: list[tuple]) -> None:
        self.pending.updateValue((number,), (pickle.dumps(packets),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first_us = None
        for frame in rows:
            for number, part in frame.groupby(frame["us"] // self.slice_us):
                more = list(part[PENDING_SCHEMA.names].astype(object).itertuples(index=False, name=None))
                self._keep(int(number), self._slice(int(number)) + more)
            low = int(frame["us"].min())
            first_us = low if first_us is None else min(first_us, low)
        idle = self.idle_us.get(key[1], self.idle_us["icmp"])
        self._store(idle, self._load(), timerValues.getCurrentWatermarkInMs(), first_us)
        yield pd.DataFrame([], columns=OUTPUT_SCHEMA.names)

    def _due(self, now_us: int) -> tuple[pd.DataFrame, int | None]:
        """The packets that the watermark has passed, in order, and when the next ones may come due."""
        numbers = sorted(k[0] for k in self.pending.keys())
        ready, waiting_us = [], None
        for number in numbers:
            if number * self.slice_us >= now_us:
                waiting_us = number * self.slice_us
                break
            packets = self._slice(number)
            rest = [p for p in packets if p[0] >= now_us]
            ready += [p for p in packets if p[0] < now_us]
            if rest:
                self._keep(number, rest)
                waiting_us = min(p[0] for p in rest)
                break
            self.pending.removeKey((number,))
        found = pd.DataFrame(ready, columns=PENDING_SCHEMA.names)
        return found.sort_values(["us", "seq"], ignore_index=True), waiting_us

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now_ms = timerValues.getCurrentWatermarkInMs()
        c = self._load()
        if c["timer_ms"] is not None and c["timer_ms"] <= now_ms:
            c["timer_ms"] = None
        idle, done = self.idle_us.get(key[1], self.idle_us["icmp"]), []
        packets, waiting_us = self._due(now_ms * 1000)
        if len(packets):
            c, done = _advance(key, c, packets, idle)
        if c["is_open"] and now_ms * 1000 > c["last_us"] + idle:
            done.append(_finished(key, c))
            c = _blank(timer_ms=c["timer_ms"])
        elif not c["is_open"] and c["closed_us"] is not None and now_ms * 1000 > c["closed_us"] + GRACE_US:
            c = _blank(timer_ms=c["timer_ms"])
        self._store(idle, c, now_ms, waiting_us)
        yield pd.DataFrame(done, columns=OUTPUT_SCHEMA.names)

    def close(self) -> None:
        pass


def stream_flows(packets: DataFrame, delay: str, idle_us: dict[str, int] = IDLE_US) -> DataFrame:
    """Completed connections of a packet stream with event time ``ts``, as aggregate rows.

    Packets may come out of order by up to ``delay``; later ones are dropped by the watermark, so it must be given.
    """
    keyed = canonical_tuple(packets.withWatermark("ts", delay)).groupBy(*TUPLE)
    return keyed.transformWithStateInPandas(
        statefulProcessor=ConnectionAssembler(idle_us),
        outputStructType=OUTPUT_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )


def stream_connections(packets: DataFrame, delay: str, idle_us: dict[str, int] = IDLE_US) -> DataFrame:
    """Connection records of a packet stream, as ``connections`` gives them for a table."""
    return of_sensors(connection_records(stream_flows(packets, delay, idle_us)), packets)


def stream_sessions(packets: DataFrame, delay: str, idle_us: dict[str, int] = IDLE_US) -> DataFrame:
    """Idle sessions of the protocols without a close rule (all but TCP), by Spark's own session windows.

    No Python worker takes part and the state of a session is one row, whatever its packets.  A session ends when the
    watermark has passed its last packet by more than the protocol's timeout.  Gives the tuple, the first packet
    (``flow_us``, ``flow_seq``, ``flow_up``), ``last_us`` and packets and bytes by direction.
    """
    keyed = canonical_tuple(packets.where("proto <> 'tcp'").withWatermark("ts", delay))
    # A packet after exactly the timeout still belongs to the session.
    gap = lambda kind: F.lit(f"{idle_us[kind]} microseconds")
    session = F.session_window("ts", F.when(F.col("proto") == "udp", gap("udp")).otherwise(gap("icmp")))
    sums = {f"{side}_{name}": value for side in ("up", "down") for name, value in (("pkts", F.lit(1)), ("payload", F.col("payload_len")), ("bytes", F.col("ip_len")))}
    is_side = {"up": F.col("up"), "down": ~F.col("up")}
    rows = keyed.groupBy(session, *TUPLE).agg(
        F.min(F.struct("us", "seq", "up")).alias("first"),
        F.max("us").alias("last_us"),
        *[F.sum(F.when(is_side[c.split("_")[0]], v).otherwise(0)).alias(c) for c, v in sums.items()],
    )
    up = F.col("first.up")
    pick = lambda name, forward: F.when(up == forward, F.col(f"up_{name}")).otherwise(F.col(f"down_{name}"))
    return rows.select(
        *TUPLE,
        F.col("first.us").alias("flow_us"),
        F.col("first.seq").alias("flow_seq"),
        up.alias("flow_up"),
        "last_us",
        pick("pkts", True).alias("fwd_pkts"),
        pick("pkts", False).alias("bwd_pkts"),
        pick("payload", True).alias("src_bytes"),
        pick("payload", False).alias("dst_bytes"),
        pick("bytes", True).alias("fwd_bytes"),
        pick("bytes", False).alias("bwd_bytes"),
    )
