"""Packets to bidirectional connections.

A connection is keyed by the undirected 5-tuple; the sender of its first packet
is the originator.  It ends when the tuple stays silent for longer than the
protocol's timeout and, for TCP, at a reset or once both sides sent FIN.

Idle cuts, directions, moments and states are windows and aggregates.  Only the
TCP close rule with its grace period depends on everything before it in the
tuple; that one column is found by a streaming pass over sorted rows
(``split="tcp"``).  ``split="idle"`` leaves it out.

Order within a tuple is (us, seq): event time, then arrival.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.rounding import ratio
from packetloom.functions.services import service_name
from packetloom.operators.layout import MAX_GROUP_ROWS, small_side, split_hot_keys
from packetloom.session import materialize
from packetloom.schemas import FLOW_FEATURES

# Idle timeouts and the grace period after a TCP close.
IDLE_US = {"tcp": 30_000_000, "udp": 10_000_000, "icmp": 5_000_000}
GRACE_US = 2_000_000

TUPLE = ["sensor", "proto", "lo_ip", "lo_port", "hi_ip", "hi_port"]
PACKET_COLUMNS = [
    "us", "seq", "up", "payload_len", "ip_len", "tcp_flags", "tcp_window", "icmp_type", "icmp_code", "is_fragment",
]
ORDER_BITS = 36


def canonical_tuple(packets: DataFrame) -> DataFrame:
    """Add the undirected tuple and ``up``: whether the packet runs from lo to hi.

    When both ends are equal every packet runs from lo to hi.  The tuple holds the ``sensor`` that saw the packet, so
    equal private addresses behind two sensors stay apart; without such a column all packets are of one sensor.
    """
    sensor = F.coalesce(F.col("sensor"), F.lit("")) if "sensor" in packets.columns else F.lit("")
    packets = packets.withColumn("sensor", sensor)
    src, dst = F.struct("src_ip", "src_port"), F.struct("dst_ip", "dst_port")
    up = src <= dst
    return packets.select(
        "*",
        up.alias("up"),
        F.when(up, F.col("src_ip")).otherwise(F.col("dst_ip")).alias("lo_ip"),
        F.when(up, F.col("src_port")).otherwise(F.col("dst_port")).alias("lo_port"),
        F.when(up, F.col("dst_ip")).otherwise(F.col("src_ip")).alias("hi_ip"),
        F.when(up, F.col("dst_port")).otherwise(F.col("src_port")).alias("hi_port"),
    )


def _has(letter: str) -> Column:
    return F.contains(F.coalesce(F.col("tcp_flags"), F.lit("")), F.lit(letter))


def _timeout(idle_us: dict[str, int]) -> Column:
    limit = F.when(F.col("proto") == "tcp", idle_us["tcp"]).when(F.col("proto") == "udp", idle_us["udp"])
    return limit.otherwise(idle_us["icmp"])


def _group(hot: DataFrame | None) -> list[str]:
    """Keys of an ordered group; without hot tuples there is one block per tuple."""
    return TUPLE if hot is None else [*TUPLE, "block"]


def with_idle_sessions(
    packets: DataFrame, idle_us: dict[str, int] = IDLE_US, max_rows: int = MAX_GROUP_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """Add ``prev_us``, ``ord`` and the first packet of the idle session (``sess_*``).

    Runs per (tuple, block).  Blocks of hot tuples are joined up with one
    summary row per block; all other tuples are a single block.  Returns the
    rows and the hot tuples, if any.
    """
    placed, hot = split_hot_keys(canonical_tuple(packets), TUPLE, "us", max_rows)
    group = _group(hot)
    in_block = Window.partitionBy(*group).orderBy("us", "seq")
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.select(
        "*",
        F.lag("us").over(in_block).alias("prev_us"),
        # Rises with (us, seq) inside a tuple.
        (F.shiftleft(F.col("block").cast("bigint"), ORDER_BITS) + F.row_number().over(in_block)).alias("ord"),
    )
    if hot is not None:
        ends = _block_summary(placed, hot, group, {"end_us": F.max("us")}, "block-ends")
        earlier = Window.partitionBy(*TUPLE).orderBy("block")
        ends = ends.select(*group, F.lag("end_us").over(earlier).alias("carry_us"))
        rows = rows.join(small_side(ends), group, "left")
        rows = rows.withColumn("prev_us", F.coalesce("prev_us", "carry_us")).drop("carry_us")
    starts = F.col("prev_us").isNull() | (F.col("us") - F.col("prev_us") > _timeout(idle_us))
    rows = rows.withColumn("starts", starts)
    first = F.when(F.col("starts"), F.struct("us", "seq", "up"))
    rows = rows.withColumn("sess", F.last(first, ignorenulls=True).over(so_far))
    if hot is not None:
        opened = _block_summary(
            rows, hot, group, {"opened": F.max_by(first, F.when(F.col("starts"), F.col("ord")))}, "block-sessions"
        )
        before = Window.partitionBy(*TUPLE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        opened = opened.select(*group, F.last("opened", ignorenulls=True).over(before).alias("carry"))
        rows = rows.join(small_side(opened), group, "left").withColumn("sess", F.coalesce("sess", "carry")).drop("carry")
    rows = rows.select(
        "*",
        F.col("sess.us").alias("sess_us"),
        F.col("sess.seq").alias("sess_seq"),
        F.col("sess.up").alias("sess_up"),
    )
    return rows.drop("sess"), hot


def _block_summary(
    rows: DataFrame, hot: DataFrame, group: list[str], values: dict[str, Column], name: str
) -> DataFrame:
    """One row per block of a hot tuple: at most total rows / max_rows in all."""
    of_hot = rows.join(small_side(hot), TUPLE, "left_semi")
    return materialize(of_hot.groupBy(*group).agg(*[v.alias(k) for k, v in values.items()]), name)


# --- TCP close and grace ------------------------------------------------------


class Tuple5State(NamedTuple):
    """What earlier packets of a tuple leave behind; ``flow_seq`` None means no open connection."""

    flow_us: int | None = None
    flow_seq: int | None = None
    flow_up: bool | None = None
    orig_fin: bool = False
    resp_fin: bool = False
    reset: bool = False
    closed_us: int | None = None


FRESH = Tuple5State()
STATE_TYPE = T.StructType(
    [
        T.StructField("flow_us", T.LongType()),
        T.StructField("flow_seq", T.LongType()),
        T.StructField("flow_up", T.BooleanType()),
        T.StructField("orig_fin", T.BooleanType()),
        T.StructField("resp_fin", T.BooleanType()),
        T.StructField("reset", T.BooleanType()),
        T.StructField("closed_us", T.LongType()),
    ]
)


def next_state(
    state: Tuple5State, us: int, seq: int, up: bool, syn: bool, fin: bool, rst: bool
) -> tuple[Tuple5State, bool]:
    """State after one TCP packet, and whether the packet belongs to a connection."""
    if state.flow_seq is None:
        if not syn and state.closed_us is not None and us - state.closed_us <= GRACE_US:
            return state, False
        # The first packet never closes its own connection.
        return Tuple5State(us, seq, up, fin, False, rst, None), True
    if not (fin or rst or state.reset):
        return state, True
    from_orig = up == state.flow_up
    orig_fin, resp_fin = state.orig_fin or (fin and from_orig), state.resp_fin or (fin and not from_orig)
    if rst or state.reset or (orig_fin and resp_fin):
        return FRESH._replace(closed_us=us), True
    return state._replace(orig_fin=orig_fin, resp_fin=resp_fin), True


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow each tuple through sorted rows, one batch in memory at a time.

    ``head`` marks the first row of a group, where ``entry`` (null for a fresh
    tuple) is the state to start from.  While a connection is open, rows up to the next that may change that (a FIN,
    a reset, the start of a session or tuple) are its own and filled in together.
    """
    state = FRESH
    for batch in batches:
        names, n = batch.schema.names, batch.num_rows
        flag = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("up", "syn", "fin", "rst", "head", "starts")}
        times, numbers = (batch.column(c).to_numpy().tolist() for c in ("us", "seq"))
        up, syn, fin, rst, head, starts = (flag[c].tolist() for c in ("up", "syn", "fin", "rst", "head", "starts"))
        entry = batch.column("entry")
        turns = np.append(np.flatnonzero(flag["fin"] | flag["rst"] | flag["head"] | flag["starts"]), n).tolist()
        flow_us, flow_seq = np.zeros(n, np.int64), np.zeros(n, np.int64)
        flow_up, owned = np.zeros(n, bool), np.zeros(n, bool)
        i = turn = 0
        while i < n:
            if head[i]:
                known = entry[i].as_py()
                state = Tuple5State(**known) if known else FRESH
            if starts[i]:
                state = FRESH
            opened = state
            state, kept = next_state(state, times[i], numbers[i], up[i], syn[i], fin[i], rst[i])
            end = i + 1
            if state.flow_seq is not None and not state.reset:
                while turns[turn] <= i:
                    turn += 1
                end = turns[turn]
            if kept:
                owner = state if opened.flow_seq is None else opened
                flow_us[i:end], flow_seq[i:end], flow_up[i:end], owned[i:end] = owner.flow_us, owner.flow_seq, owner.flow_up, True
            i = end
        extra = [pa.array(values, mask=~owned) for values in (flow_us, flow_seq, flow_up)]
        kept_names = [c for c in names if c not in ("syn", "fin", "rst", "head", "entry")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(c) for c in kept_names] + extra, names=kept_names + [f.name for f in STATE_TYPE.fields[:3]]
        )


def _run_walk(rows: DataFrame, group: list[str]) -> DataFrame:
    fields = STATE_TYPE.fields[:3]
    dropped = ("syn", "fin", "rst", "head", "entry")
    schema = T.StructType([f for f in rows.schema.fields if f.name not in dropped] + fields)
    ordered = rows.repartition(*group).sortWithinPartitions(*group, "us", "seq")
    return ordered.mapInArrow(_walk, schema)


def _tcp_flows(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Add ``flow_us``, ``flow_seq``, ``flow_up`` to TCP rows; null on absorbed packets."""
    group = _group(hot)
    in_block = Window.partitionBy(*group).orderBy("us", "seq")
    marked = rows.select(
        "*",
        (_has("S") & ~_has("A")).alias("syn"),
        _has("F").alias("fin"),
        _has("R").alias("rst"),
        (F.row_number().over(in_block) == 1).alias("head"),
    )
    if hot is None:
        marked = marked.withColumn("entry", F.lit(None).cast(STATE_TYPE))
    else:
        entries = _entry_states(marked.join(small_side(hot), TUPLE, "left_semi"))
        marked = marked.join(small_side(entries), group, "left")
    return _run_walk(marked, group)


def _entry_states(hot_rows: DataFrame) -> DataFrame:
    """State of each hot tuple at the start of each of its blocks.

    Every block is read on its own, for all states it may begin with, and reduced to one row: which state each of
    them ends in.  Following the blocks of a tuple then takes one small row per block, and no task reads more packets
    than a block has, whatever they are.
    """
    group = [*TUPLE, "block"]
    rows = hot_rows.select(*group, "us", "seq", "up", "syn", "fin", "rst", "starts", "head")
    ordered = rows.repartition(*group).sortWithinPartitions(*group, "us", "seq")
    kinds = {f.name: f for f in rows.schema.fields}
    schema = T.StructType([*(kinds[c] for c in group), T.StructField("ends", T.StringType())])
    ends = materialize(ordered.mapInArrow(_block_ends, schema), "block-ends")

    entry = T.StructType([*(kinds[c] for c in group), T.StructField("entry", STATE_TYPE)])

    def follow(blocks: pd.DataFrame) -> pd.DataFrame:
        state, entries = FRESH, []
        blocks = blocks.sort_values("block")
        for text in blocks["ends"]:
            entries.append(None if state == FRESH else state._asdict())
            state = _after_block(state, json.loads(text))
        return blocks[group].assign(entry=entries)

    return materialize(ends.groupBy(*TUPLE).applyInPandas(follow, entry), "entry-states")


class _BlockWalk:
    """All states a block may begin with, followed together.

    States that can be told apart by what they do next are few: a connection is open with one of twelve combinations
    of direction, FINs and a reset, or closed at some time.  ``open`` and ``closed`` list, for each of these, who is
    in it: names of begin states, with the connection they are in (None: the one the block began with).  Begin states
    closed at time c are named by an upper bound: those with c below ``us - GRACE_US`` open at the first packet that
    is late enough, so each such packet takes the next interval of c.  Once two begin states meet they stay together
    but for the name of their connection.
    """

    def __init__(self):
        combinations = [(up, *fins, reset) for up in (False, True) for fins in ((0, 0), (1, 0), (0, 1)) for reset in (0, 1)]
        self.open = {c: [(["open", *map(int, c)], None)] for c in combinations}
        self.closed: dict[int | None, list] = {None: [["fresh"]]}
        self.first_us: int | None = None
        self.below: int | None = None  # begin states closed before this have opened
        self.all_opened = False

    def step(self, us: int, seq: int, up: bool, syn: bool, fin: bool, rst: bool, starts: bool) -> None:
        self.first_us = us if self.first_us is None else self.first_us
        if starts:
            names = [n for members in self.open.values() for n, _ in members]
            names += [n for members in self.closed.values() for n in members]
            if not self.all_opened:
                names.append(["closed", None])
            self.open, self.closed, self.all_opened = {}, {None: names}, True
        opening = [n for c in [c for c in self.closed if syn or c is None or us - c > GRACE_US] for n in self.closed.pop(c)]
        if not self.all_opened:
            bound = us - GRACE_US
            if syn or bound > self.first_us:  # no begin state closed later than the block begins
                opening.append(["closed", None])
                self.all_opened = True
            elif self.below is None or bound > self.below:
                opening.append(["closed", bound])
                self.below = bound
        if fin or rst or any(c[3] for c in self.open):
            after: dict[tuple, list] = {}
            for (flow_up, orig_fin, resp_fin, reset), members in self.open.items():
                if not (fin or rst or reset):
                    after.setdefault((flow_up, orig_fin, resp_fin, reset), []).extend(members)
                    continue
                orig_fin, resp_fin = orig_fin or int(fin and up == flow_up), resp_fin or int(fin and up != flow_up)
                if rst or reset or (orig_fin and resp_fin):
                    self.closed.setdefault(us, []).extend(n for n, _ in members)
                else:
                    after.setdefault((flow_up, orig_fin, resp_fin, reset), []).extend(members)
            self.open = after
        if opening:
            self.open.setdefault((up, int(fin), 0, int(rst)), []).extend((n, (us, seq)) for n in opening)

    def ends(self) -> str:
        """JSON: [name of a begin state, the state it ends in]; begin states closed later than all bounds stay as they are."""
        found = []
        for (up, orig_fin, resp_fin, reset), members in self.open.items():
            found += [(n, ["open", flow, bool(up), bool(orig_fin), bool(resp_fin), bool(reset)]) for n, flow in members]
        for at, members in self.closed.items():
            found += [(n, ["closed", at]) for n in members]
        bounds = sorted((x for x in found if x[0][0] == "closed"), key=lambda x: (x[0][1] is None, x[0][1] or 0))
        # Neighbouring intervals with the same end are one.
        kept = [x for x, following in zip(bounds, [*bounds[1:], None]) if following is None or following[1] != x[1]]
        return json.dumps([x for x in found if x[0][0] != "closed"] + kept)


def _block_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group = [*TUPLE, "block"]
    walk, key = None, None
    kinds = None
    done: list[tuple] = []
    for batch in batches:
        kinds = [batch.schema.field(c).type for c in group]
        columns = [batch.column(c).to_pylist() for c in (*group, "head", "us", "seq", "up", "syn", "fin", "rst", "starts")]
        for *names, head, us, seq, up, syn, fin, rst, starts in zip(*columns):
            if head:
                if walk is not None:
                    done.append((*key, walk.ends()))
                walk, key = _BlockWalk(), names
            walk.step(us, seq, up, syn, fin, rst, starts)
    if walk is not None:
        done.append((*key, walk.ends()))
    if done:
        columns = [pa.array(list(v), k) for v, k in zip(zip(*done), [*kinds, pa.string()])]
        yield pa.RecordBatch.from_arrays(columns, [*group, "ends"])


def _after_block(state: Tuple5State, ends: list) -> Tuple5State:
    """The state in which a block ends that began with ``state``."""
    if state.flow_seq is not None:
        name = ["open", int(state.flow_up), int(state.orig_fin), int(state.resp_fin), int(state.reset)]
        end = next(e for n, e in ends if n == name)
    elif state.closed_us is None:
        end = next(e for n, e in ends if n == ["fresh"])
    else:
        # The interval with the least bound above the time of the close; None is above all.
        later = [(n[1], e) for n, e in ends if n[0] == "closed" and (n[1] is None or state.closed_us < n[1])]
        if not later:
            return state
        end = min(later, key=lambda x: (x[0] is None, x[0] or 0))[1]
    if end[0] == "closed":
        return FRESH._replace(closed_us=end[1])
    flow = end[1] or (state.flow_us, state.flow_seq)
    return Tuple5State(flow[0], flow[1], end[2], end[3], end[4], end[5], None)


def assign_flows(
    packets: DataFrame, split: str = "tcp", idle_us: dict[str, int] = IDLE_US, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Give each packet the first packet of its connection (``flow_us, flow_seq, flow_up``).

    Packets absorbed after a close carry nulls there.
    """
    rows, hot = with_idle_sessions(packets, idle_us, max_rows)
    # The addresses live on in the tuple and ``up``; fewer columns pass the walk.
    rows = rows.select(*TUPLE, *PACKET_COLUMNS, "block", "prev_us", "ord", "starts", "sess_us", "sess_seq", "sess_up")
    whole = {"flow_us": F.col("sess_us"), "flow_seq": F.col("sess_seq"), "flow_up": F.col("sess_up")}
    if split == "idle":
        return rows.withColumns(whole)
    if split != "tcp":
        raise ValueError(f"unknown split {split!r}; expected 'idle' or 'tcp'")
    others = rows.where(F.col("proto") != "tcp").withColumns(whole)
    return _tcp_flows(rows.where(F.col("proto") == "tcp"), hot).unionByName(others)


# --- per-connection aggregates ------------------------------------------------


def _moments(name: str, value: Column) -> list[Column]:
    zero = F.lit(0.0)
    return [
        F.coalesce(F.max(value).cast("double"), zero).alias(f"{name}_max"),
        F.coalesce(F.min(value).cast("double"), zero).alias(f"{name}_min"),
        F.coalesce(F.avg(value), zero).alias(f"{name}_mean"),
        F.coalesce(F.stddev_pop(value), zero).alias(f"{name}_std"),
    ]


def flow_aggregates(assigned: DataFrame) -> DataFrame:
    """One row per connection with every counter, moment and state bit.

    A plain grouped aggregate: it combines before the shuffle, so connections
    of any length and tuples of any heat reduce early.
    """
    fwd = F.col("up") == F.col("flow_up")
    tcp = F.col("proto") == "tcp"
    iat = F.when(F.col("seq") != F.col("flow_seq"), F.col("us") - F.col("prev_us"))
    # Packet order of the tuple; ties cannot occur.
    window_at = lambda side: F.min_by(
        "tcp_window", F.when(side & tcp & (F.col("tcp_window") >= 0), F.col("ord"))
    )
    seen = lambda cond: F.coalesce(F.bool_or(tcp & cond), F.lit(False))
    counted = lambda cond: F.count_if(tcp & cond)
    kept = assigned.where(F.col("flow_seq").isNotNull())
    return kept.groupBy(*TUPLE, "flow_us", "flow_seq", "flow_up").agg(
        F.max("us").alias("last_us"),
        F.min_by("icmp_type", "ord").alias("icmp_type"),
        F.min_by("icmp_code", "ord").alias("icmp_code"),
        F.count_if(fwd).alias("fwd_pkts"),
        F.count_if(~fwd).alias("bwd_pkts"),
        F.sum(F.when(fwd, F.col("payload_len")).otherwise(0)).alias("src_bytes"),
        F.sum(F.when(~fwd, F.col("payload_len")).otherwise(0)).alias("dst_bytes"),
        F.sum(F.when(fwd, F.col("ip_len")).otherwise(0)).alias("fwd_bytes"),
        F.sum(F.when(~fwd, F.col("ip_len")).otherwise(0)).alias("bwd_bytes"),
        F.count_if("is_fragment").alias("wrong_fragment"),
        counted(_has("U")).alias("urgent"),
        *_moments("fwd_pkt_len", F.when(fwd, F.col("ip_len"))),
        *_moments("bwd_pkt_len", F.when(~fwd, F.col("ip_len"))),
        *_moments("flow_iat", iat),
        # Gaps of one direction add up to its span, so no second ordering is needed.
        F.coalesce(F.max(F.when(fwd, F.col("us"))) - F.min(F.when(fwd, F.col("us"))), F.lit(0)).alias("fwd_span"),
        F.coalesce(F.max(F.when(~fwd, F.col("us"))) - F.min(F.when(~fwd, F.col("us"))), F.lit(0)).alias("bwd_span"),
        *[counted(_has(c)).alias(f"n_{c.lower()}") for c in "FSRPAU"],
        F.coalesce(window_at(fwd), F.lit(-1)).alias("init_win_bytes_fwd"),
        F.coalesce(window_at(~fwd), F.lit(-1)).alias("init_win_bytes_bwd"),
        seen(fwd & _has("S") & ~_has("A")).alias("syn_seen"),
        seen(~fwd & _has("S") & _has("A")).alias("synack_seen"),
        seen(fwd & _has("F")).alias("orig_fin"),
        seen(~fwd & _has("F")).alias("resp_fin"),
        seen(fwd & _has("R")).alias("orig_rst"),
        seen(~fwd & _has("R")).alias("resp_rst"),
    )


def connection_state() -> Column:
    """State name from the handshake, FIN and RST bits of a connection."""
    refused = (
        F.when(F.col("resp_rst"), "REJ").when(F.col("orig_rst"), "RSTOS0").when(F.col("orig_fin"), "SH").otherwise("S0")
    )
    ended = (
        F.when(F.col("orig_rst"), "RSTO")
        .when(F.col("resp_rst"), "RSTR")
        .when(F.col("orig_fin") & F.col("resp_fin"), "SF")
        .when(F.col("orig_fin"), "S2")
        .when(F.col("resp_fin"), "S3")
        .otherwise("S1")
    )
    return (
        F.when(F.col("proto") != "tcp", "SF")
        .when(~F.col("syn_seen"), "OTH")
        .otherwise(F.when(F.col("synack_seen"), ended).otherwise(refused))
    )


def _endpoints() -> dict[str, Column]:
    up = F.col("flow_up")
    return {
        "src_ip": F.when(up, F.col("lo_ip")).otherwise(F.col("hi_ip")),
        "src_port": F.when(up, F.col("lo_port")).otherwise(F.col("hi_port")),
        "dst_ip": F.when(up, F.col("hi_ip")).otherwise(F.col("lo_ip")),
        "dst_port": F.when(up, F.col("hi_port")).otherwise(F.col("lo_port")),
    }


def flow_features() -> dict[str, Column]:
    """The 32 per-connection features over the columns of ``flow_aggregates``."""
    span = F.col("last_us") - F.col("flow_us")
    seconds = F.nullif(span, F.lit(0)).cast("double") / 1e6
    packets = F.col("fwd_pkts") + F.col("bwd_pkts")
    size = F.col("fwd_bytes") + F.col("bwd_bytes")
    special = {
        "dst_port": F.col("dst_port"),
        "flow_duration": span,
        "tot_fwd_pkts": F.col("fwd_pkts"),
        "tot_bwd_pkts": F.col("bwd_pkts"),
        "tot_fwd_bytes": F.col("fwd_bytes"),
        "tot_bwd_bytes": F.col("bwd_bytes"),
        "flow_bytes_per_s": F.coalesce(size / seconds, F.lit(0.0)),
        "flow_pkts_per_s": F.coalesce(packets / seconds, F.lit(0.0)),
        "fwd_iat_mean": ratio(F.col("fwd_span"), F.greatest(F.col("fwd_pkts") - 1, F.lit(0))),
        "bwd_iat_mean": ratio(F.col("bwd_span"), F.greatest(F.col("bwd_pkts") - 1, F.lit(0))),
        "fin_flag_cnt": F.col("n_f"),
        "syn_flag_cnt": F.col("n_s"),
        "rst_flag_cnt": F.col("n_r"),
        "psh_flag_cnt": F.col("n_p"),
        "ack_flag_cnt": F.col("n_a"),
        "urg_flag_cnt": F.col("n_u"),
        "down_up_ratio": ratio(F.col("bwd_pkts"), F.col("fwd_pkts")),
        "avg_pkt_size": ratio(size, packets),
    }
    return {name: special.get(name, F.col(name)) for name in FLOW_FEATURES}


def connections(
    packets: DataFrame, split: str = "tcp", idle_us: dict[str, int] = IDLE_US, max_rows: int = MAX_GROUP_ROWS
) -> DataFrame:
    """Connection records with their 32 features nested in ``features``.

    ``conn_id`` is the ``seq`` of the first packet; ``ts_us`` is the end time.
    """
    return of_sensors(connection_records(flow_aggregates(assign_flows(packets, split, idle_us, max_rows))), packets)


def of_sensors(records: DataFrame, packets: DataFrame) -> DataFrame:
    """The records with their sensor if the packets had one."""
    return records if "sensor" in packets.columns else records.drop("sensor")


def connection_records(flows: DataFrame) -> DataFrame:
    """Records of aggregate rows, with the ``sensor`` that saw them."""
    named = flows.withColumns(_endpoints())
    features = F.struct(*[c.cast("double").alias(n) for n, c in flow_features().items()])
    return named.select(
        "sensor",
        F.col("flow_seq").alias("conn_id"),
        F.col("last_us").alias("ts_us"),
        F.call_function("div", F.col("last_us") - F.col("flow_us"), F.lit(1_000_000)).alias("duration"),
        "proto",
        service_name(F.col("proto"), F.col("dst_port"), F.col("icmp_type"), F.col("icmp_code")).alias("service"),
        connection_state().alias("flag"),
        "src_ip",
        "src_port",
        "dst_ip",
        "dst_port",
        "src_bytes",
        "dst_bytes",
        ((F.col("src_ip") == F.col("dst_ip")) & (F.col("src_port") == F.col("dst_port"))).cast("int").alias("land"),
        "wrong_fragment",
        "urgent",
        features.alias("features"),
    )
