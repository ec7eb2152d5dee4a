"""SQL (DuckDB) statements of the registered queries, written from their definitions.

They favour the plainest form over speed: frames are range joins, the TCP close
rule and the alert throttle are recursive queries.
"""

from __future__ import annotations

from packetloom.functions.labels import ATTACK_CATEGORY, ATTACK_CLASSES, FLOW_CATEGORY, FLOW_CLASSES
from packetloom.functions.services import ICMP_SERVICES, TCP_SERVICES, UDP_SERVICES
from packetloom.operators.windows import FAILED_FLAGS
from packetloom.schemas import CONNECTION_FEATURES, CONTENT_FEATURES, FILE_ACTIVITY_COLUMNS, NUMERIC_FEATURES, WINDOW_FEATURES


def _case(value: str, names: dict, default: str) -> str:
    quote = lambda k: f"'{k}'" if isinstance(k, str) else str(k)
    arms = " ".join(f"when {quote(k)} then '{v}'" for k, v in names.items())
    return f"(case {value} {arms} else {default} end)"


def _index(value: str, classes: list[str]) -> str:
    arms = " ".join(f"when '{c}' then {i}" for i, c in enumerate(classes))
    return f"(case {value} {arms} end)"


_SERVICE = f"""(case proto
  when 'icmp' then (case when itype = 3 and icode = 3 then 'urp_i' when itype = 3 then 'urh_i'
                    else {_case('itype', ICMP_SERVICES, "'oth_i'")} end)
  when 'tcp' then {_case('dst_port', TCP_SERVICES, "'private'")}
  when 'udp' then {_case('dst_port', UDP_SERVICES, "'private'")}
  else 'other' end)"""

_REL = "((epoch_us(ts) - 1704067200000000) // 1000)"

CONN = f"""ev as (select event_id as seq, {_REL} as ts_us, user_id, event_type,
    cast(floor(value * 100) as bigint) as bytes, (props->>'$.k')::int as k from events),
c0 as (select seq, ts_us, '10.0.0.' || (user_id % 32) as src_ip, (40000 + user_id % 32)::int as src_port,
    '192.168.0.' || ((user_id + k) % 16) as dst_ip, k as dst_port,
    case when seq % 10 = 0 then 'icmp' when seq % 10 < 3 then 'udp' else 'tcp' end as proto,
    case event_type when 'click' then 'SF' when 'view' then 'SF' when 'purchase' then 'RSTR'
                    when 'signup' then 'S0' else 'REJ' end as flag,
    case when event_type in ('click', 'view') then 'normal' when event_type = 'purchase' then 'guess_passwd'
         when event_type = 'signup' then 'neptune' else 'satan' end as label, bytes from ev),
conn as (select *, proto as protocol_type, {_SERVICE} as service, bytes // 1000 as duration,
    bytes - bytes // 3 as src_bytes, bytes // 3 as dst_bytes,
    (src_ip = dst_ip and src_port = dst_port)::int as land, (seq % 97 = 0)::int as wrong_fragment,
    (seq % 89 = 0)::int as urgent, (flag = 'SF')::int as logged_in, (seq % 5 = 0)::int as is_guest_login,
    (bytes % 7)::int as num_file_creations, (bytes % 3)::int as num_access_files
  from (select *, dst_port % 16 as itype, dst_port % 4 as icode from c0))"""

PACKETS = f"""b as (select event_id as seq, {_REL} as us, user_id % 32 as t, event_id % 2 = 0 as fwd, event_type as et,
    case when event_type = 'click' then cast(floor(value) as bigint) else 0 end as size from events),
e as (select *, case when t % 8 = 1 then 'icmp' when t % 8 = 0 then 'udp' else 'tcp' end as proto,
    '10.0.0.' || t as cip, '192.168.0.' || (t % 16) as sip, (case when t % 8 = 1 then 0 else 40000 + t end)::int as cport,
    case when t % 8 = 1 then 0 when t % 8 = 0 then 53 when t % 4 = 2 then 80 when t % 4 = 3 then 443
         when t % 8 = 4 then 22 else 25 end as sport from b),
pkt as (select seq, us, case when fwd then cip else sip end as src_ip, case when fwd then sip else cip end as dst_ip,
    case when fwd then cport else sport end as src_port, case when fwd then sport else cport end as dst_port, proto,
    size as payload_len, 40 + size as ip_len,
    case when proto <> 'tcp' then '' when et = 'signup' then (case when fwd then 'S' else 'SA' end)
         when et = 'view' then 'A' when et = 'click' then 'PA' when et = 'purchase' then 'FA'
         when fwd then 'R' else 'RA' end as tcp_flags,
    (case when proto = 'tcp' then 64240 - seq % 1000 else -1 end)::int as tcp_window,
    case when proto = 'icmp' then (case when fwd then 8 else 0 end) else -1 end as icmp_type,
    case when proto = 'icmp' then 0 else -1 end as icmp_code, seq % 97 = 0 as is_fragment from e)"""

HEADERS = """hdr as (select seq, case when seq % 103 = 0 then null else us end as us, case when seq % 19 = 0 then 6 else 4 end as ip_version,
    case when seq % 23 = 0 then 47 when proto = 'tcp' then 6 when proto = 'udp' then 17 else 1 end as ip_proto,
    case when seq % 101 = 0 then null else src_ip end as src_ip, case when seq % 107 = 0 then null else dst_ip end as dst_ip,
    src_port, dst_port, 40 as header_len, payload_len,
    case when seq % 11 = 0 then null else ip_len end as ip_len, case when is_fragment then 185 else 0 end as frag_offset,
    seq % 89 = 0 as more_fragments, tcp_flags, tcp_window, icmp_type, icmp_code from pkt),
norm as (select seq, us, src_ip, dst_ip, case when ip_proto = 1 then 0 else src_port end as src_port,
    case when ip_proto = 1 then 0 else dst_port end as dst_port,
    case ip_proto when 1 then 'icmp' when 6 then 'tcp' else 'udp' end as proto, payload_len,
    coalesce(ip_len, header_len + payload_len) as ip_len,
    case when ip_proto = 6 then coalesce(tcp_flags, '') else '' end as tcp_flags,
    case when ip_proto = 6 then tcp_window else -1 end as tcp_window,
    case when ip_proto = 1 then icmp_type else -1 end as icmp_type,
    case when ip_proto = 1 then icmp_code else -1 end as icmp_code,
    frag_offset > 0 or more_fragments as is_fragment
  from hdr where ip_version = 4 and ip_proto in (1, 6, 17) and us is not null and src_ip is not null and dst_ip is not null)"""

_OWN = "(proto = 'tcp' and 443 in (src_port, dst_port) and '192.168.0.3' in (src_ip, dst_ip))"

_IDLE = "(case proto when 'tcp' then 30000000 when 'udp' then 10000000 else 5000000 end)"
_TUPLE = "proto, lo_ip, lo_port, hi_ip, hi_port"


def _tuples(source: str = "pkt") -> str:
    return f"""ct as (select *, src_ip < dst_ip or (src_ip = dst_ip and src_port <= dst_port) as up from {source}),
tp as (select *, case when up then src_ip else dst_ip end as lo_ip, case when up then src_port else dst_port end as lo_port,
    case when up then dst_ip else src_ip end as hi_ip, case when up then dst_port else src_port end as hi_port from ct)"""


def _idle_assign(source: str = "pkt") -> str:
    return f"""{_tuples(source)},
g as (select *, lag(us) over w as prev_us from tp window w as (partition by {_TUPLE} order by us, seq)),
s as (select *, sum(case when prev_us is null or us - prev_us > {_IDLE} then 1 else 0 end) over w as n
      from g window w as (partition by {_TUPLE} order by us, seq rows unbounded preceding)),
asg as (select *, first_value(seq) over w as flow_seq, first_value(us) over w as flow_us, first_value(up) over w as flow_up
      from s window w as (partition by {_TUPLE}, n order by us, seq))"""


# One step per packet of each tuple: idle reset, grace, opening, closing.
_TCP_WALK = """r as (select *, contains(tcp_flags, 'S') and not contains(tcp_flags, 'A') as syn, contains(tcp_flags, 'F') as fin,
        contains(tcp_flags, 'R') as rst, dense_rank() over (order by @TUPLE@) as tid,
        row_number() over (partition by @TUPLE@ order by us, seq) as rn from tp),
walk as (
  select tid, 0::bigint as rn, null::bigint as seq, null::bigint as at, null::bigint as flow_seq, null::bigint as flow_us,
         null::boolean as flow_up, false as is_open, false as of, false as rf, false as rs, null::bigint as closed
  from (select distinct tid from r)
  union all
  select tid, rn, seq, us, case when absorbed then null when opens then seq else flow_seq end,
         case when absorbed then null when opens then us else flow_us end,
         case when absorbed then null when opens then up else flow_up end,
         not absorbed and not closes, not absorbed and nof, not absorbed and nrf, not absorbed and nrs,
         case when closes then us when absorbed then closed end
  from (
    select *, not opens and not absorbed and proto = 'tcp' and (nrs or (nof and nrf)) as closes
    from (
      select *, case when opens then fin else of or (fin and up = flow_up) end as nof,
             case when opens then false else rf or (fin and up <> flow_up) end as nrf,
             case when opens then rst else rs or rst end as nrs
      from (
        select *, not was_open and absorbable as absorbed, not was_open and not absorbable as opens
        from (
          select r.tid, r.rn, r.seq, r.us, r.up, r.proto, r.syn, r.fin, r.rst, w.flow_seq, w.flow_us, w.flow_up,
                 w.of, w.rf, w.rs, w.closed,
                 w.is_open and not (r.us - w.at > (case r.proto when 'tcp' then 30000000 when 'udp' then 10000000 else 5000000 end)) as was_open,
                 coalesce(not r.syn and r.us - w.closed <= 2000000, false) as absorbable
          from walk w join r on r.tid = w.tid and r.rn = w.rn + 1))))
),
asg as (select tp.*, w.flow_seq, w.flow_us, w.flow_up from tp join walk w on w.seq = tp.seq)""".replace("@TUPLE@", _TUPLE)


def _tcp_assign(source: str = "pkt") -> str:
    return f"{_tuples(source)},\n{_TCP_WALK}"


_TCP_ASSIGN = _tcp_assign()


def _flag(letter: str) -> str:
    return f"(proto = 'tcp' and contains(tcp_flags, '{letter}'))"


_FLOWS = f"""d as (select *, up = flow_up as fwd, lag(us) over (partition by flow_seq order by us, seq) as p_any,
      lag(us) over (partition by flow_seq, up = flow_up order by us, seq) as p_dir from asg where flow_seq is not null),
fl as (select flow_seq, any_value(flow_us) as flow_us, any_value(flow_up) as flow_up, any_value(proto) as proto,
    any_value(lo_ip) as lo_ip, any_value(lo_port) as lo_port, any_value(hi_ip) as hi_ip, any_value(hi_port) as hi_port,
    max(us) as last_us, arg_min(icmp_type, seq) filter (seq = flow_seq) as itype,
    arg_min(icmp_code, seq) filter (seq = flow_seq) as icode,
    count(*) filter (fwd) as fwd_pkts, count(*) filter (not fwd) as bwd_pkts,
    coalesce(sum(payload_len) filter (fwd), 0)::bigint as src_bytes,
    coalesce(sum(payload_len) filter (not fwd), 0)::bigint as dst_bytes,
    coalesce(sum(ip_len) filter (fwd), 0)::bigint as fwd_bytes, coalesce(sum(ip_len) filter (not fwd), 0)::bigint as bwd_bytes,
    count(*) filter (is_fragment) as wrong_fragment, count(*) filter ({_flag('U')}) as urgent,
    {', '.join(
        f"coalesce({fn}(ip_len) filter ({cond}), 0)::double as {side}_pkt_len_{name}"
        for side, cond in (('fwd', 'fwd'), ('bwd', 'not fwd'))
        for fn, name in (('max', 'max'), ('min', 'min'), ('avg', 'mean'), ('stddev_pop', 'std'))
    )},
    {', '.join(
        f"coalesce({fn}(us - p_any), 0)::double as flow_iat_{name}"
        for fn, name in (('max', 'max'), ('min', 'min'), ('avg', 'mean'), ('stddev_pop', 'std'))
    )},
    coalesce(avg(us - p_dir) filter (fwd), 0)::double as fwd_iat_mean,
    coalesce(avg(us - p_dir) filter (not fwd), 0)::double as bwd_iat_mean,
    {', '.join(f"count(*) filter ({_flag(c)}) as n_{c.lower()}" for c in 'FSRPAU')},
    coalesce(arg_min(tcp_window, us * 1000000 + seq) filter (fwd and proto = 'tcp' and tcp_window >= 0), -1) as init_win_bytes_fwd,
    coalesce(arg_min(tcp_window, us * 1000000 + seq) filter (not fwd and proto = 'tcp' and tcp_window >= 0), -1) as init_win_bytes_bwd,
    coalesce(bool_or(fwd and {_flag('S')} and not {_flag('A')}), false) as syn_seen,
    coalesce(bool_or(not fwd and {_flag('S')} and {_flag('A')}), false) as synack_seen,
    coalesce(bool_or(fwd and {_flag('F')}), false) as ofin, coalesce(bool_or(not fwd and {_flag('F')}), false) as rfin,
    coalesce(bool_or(fwd and {_flag('R')}), false) as orst, coalesce(bool_or(not fwd and {_flag('R')}), false) as rrst
  from d group by flow_seq),
fs as (select *, case when proto <> 'tcp' then 'SF' when not syn_seen then 'OTH'
      when not synack_seen and rrst then 'REJ' when not synack_seen and orst then 'RSTOS0'
      when not synack_seen and ofin then 'SH' when not synack_seen then 'S0'
      when orst then 'RSTO' when rrst then 'RSTR' when ofin and rfin then 'SF' when ofin then 'S2' when rfin then 'S3'
      else 'S1' end as flag,
    case when flow_up then lo_ip else hi_ip end as src_ip, case when flow_up then lo_port else hi_port end as src_port,
    case when flow_up then hi_ip else lo_ip end as dst_ip, case when flow_up then hi_port else lo_port end as dst_port,
    last_us - flow_us as span from fl)"""

_IDLE_FLOWS = f"with {PACKETS}, {_idle_assign()}, {_FLOWS}"

_PAIR_CTES = f"""p as (select s.seq, c.ts_us >= s.ts_us - 2000000 as t, c.seq > s.seq - 100 as h, c.dst_ip = s.dst_ip as host,
    c.service = s.service as srv, c.src_port = s.src_port as port, c.flag in ('S0', 'S1', 'S2', 'S3') as se, c.flag = 'REJ' as re
  from {{source}} s join {{source}} c on c.seq between s.seq - 999 and s.seq),
f as (select seq,
    {', '.join(f"count(*) filter ({cond}) as {name}" for name, cond in {
        'n_host': 't and host', 'n_srv': 't and srv', 'host_serr': 't and host and se', 'host_rerr': 't and host and re',
        'srv_serr': 't and srv and se', 'srv_rerr': 't and srv and re', 'host_srv': 't and host and srv',
        'host_other_srv': 't and host and not srv', 'srv_other_host': 't and srv and not host',
        'dh': 'h and host', 'dhs': 'h and host and srv', 'dh_other': 'h and host and not srv',
        'dh_port': 'h and host and port', 'hs': 'h and srv', 'hs_other': 'h and srv and not host',
        'dh_se': 'h and host and se', 'dh_re': 'h and host and re', 'dhs_se': 'h and host and srv and se',
        'dhs_re': 'h and host and srv and re',
    }.items())} from p group by seq)"""
_PAIRS = f"with {CONN}, {_PAIR_CTES}"

_RATES = """n_host as count, n_srv as srv_count, host_serr / n_host as serror_rate, srv_serr / n_srv as srv_serror_rate,
    host_rerr / n_host as rerror_rate, srv_rerr / n_srv as srv_rerror_rate, host_srv / n_host as same_srv_rate,
    host_other_srv / n_host as diff_srv_rate, srv_other_host / n_srv as srv_diff_host_rate, dh as dst_host_count,
    dhs as dst_host_srv_count, dhs / dh as dst_host_same_srv_rate, dh_other / dh as dst_host_diff_srv_rate,
    dh_port / dh as dst_host_same_src_port_rate, hs_other / hs as dst_host_srv_diff_host_rate,
    dh_se / dh as dst_host_serror_rate, dhs_se / dhs as dst_host_srv_serror_rate, dh_re / dh as dst_host_rerror_rate,
    dhs_re / dhs as dst_host_srv_rerror_rate"""

_FAILED = ", ".join(f"'{f}'" for f in FAILED_FLAGS)
WINDOWS = f"""win as (select src_ip, ts_us - ts_us % 60000000 as window_start_us, count(*) as flow_count,
    count(distinct dst_port) as distinct_dst_ports, count(distinct dst_ip) as distinct_dst_hosts,
    count(*) filter (flag in ({_FAILED})) / count(*) as failed_ratio,
    count(distinct dst_port) / greatest(count(distinct dst_ip), 1) as ports_per_host,
    sum(bytes)::bigint as total_bytes, sum(bytes)::bigint / count(*) as mean_bytes
  from conn where src_ip <> '' group by 1, 2)"""

_EVENTS = f"""evt as (select seq, ts_us, 'nsl' as dataset, protocol_type, service, flag,
    {', '.join(f"{c}::double as {c}" if c in ('num_file_creations', 'num_access_files') else f"null::double as {c}" for c in FILE_ACTIVITY_COLUMNS)},
    num_file_creations > 0 or num_access_files > 0 as has_file_activity, (flag <> 'SF')::int as prediction,
    case when flag = 'SF' then 'normal' else 'attack' end as label, flag <> 'SF' as is_attack from conn)"""

_RAW = """raw as (select l_orderkey, l_linenumber,
    case when l_partkey % 13 = 0 then 'Infinity' when l_partkey % 17 = 0 then 'n/a'
         when l_partkey % 19 = 0 then '5d' when l_partkey % 23 = 0 then '2.5F'
         else cast(cast(trunc(l_extendedprice * 100) as bigint) as varchar) end as price,
    case when l_suppkey % 11 = 0 then 'NaN' else cast(cast(trunc(l_quantity) as bigint) as varchar) end as quantity,
    cast(l_linenumber - 2 as varchar) as flow_duration, l_returnflag as label from lineitem),
num as (select l_orderkey, l_linenumber, try_cast(price as double) as price, try_cast(quantity as double) as quantity,
    try_cast(flow_duration as double) as flow_duration, label from raw)"""

_FEATURES = """feat as (select l_orderkey * 8 + l_linenumber as row_id, l_returnflag, l_linestatus, l_quantity as quantity,
    l_extendedprice as price, l_discount as discount, l_tax as tax from lineitem)"""

_FLOW_LABELS = """fll as (select seq, case label when 'normal' then 'BENIGN' when 'neptune' then 'DoS Hulk'
    when 'satan' then 'PortScan' else (case when bytes % 2 = 0 then 'SSH-Patator' else 'Web Attack - XSS' end) end as label
  from conn)"""

_PREDICTIONS = """pr0 as (select seq, case label when 'normal' then 0 when 'neptune' then 1 when 'satan' then 2 else 3 end as label,
    case when flag = 'SF' then 0 when bytes % 3 = 0 then 1 when flag = 'REJ' then 2 else 4 end as m_a,
    case when dst_port < 50 then 0 when flag = 'S0' then 1 else 3 end as m_b from conn),
pr as (select label, 'a' as model, m_a as prediction from pr0 union all select label, 'b', m_b from pr0
       union all select label, 'c', 0 from pr0),
cls as (select distinct model, label as k from pr union select model, prediction from pr),
per as (select cls.model, cls.k, count(*) filter (label = k and prediction = k) as tp,
    count(*) filter (label = k) as nl, count(*) filter (prediction = k) as np
  from cls join pr on pr.model = cls.model group by 1, 2),
mac as (select model, avg(case when np = 0 then 0 else tp / np end) as precision,
    avg(case when nl = 0 then 0 else tp / nl end) as recall,
    avg(case when nl + np = 0 then 0 else 2 * tp / (nl + np) end) as f1 from per group by 1),
acc as (select model, count(*) filter (label = prediction) / count(*) as accuracy from pr group by 1)"""

_CATEGORY = _case("label", ATTACK_CATEGORY, "null")
_ITEMS = ["protocol_type", "service", "flag", "logged_in", "is_guest_login"]
_ITEM_LIST = ", ".join(f"'{c}=' || {c}" for c in _ITEMS) + f", 'label=' || {_CATEGORY}"

# Itemsets by definition: every sub-list of a row's items with up to four members.
_ITEMSETS = f"""it as (select seq, unnest([{_ITEM_LIST}]) as i from conn),
i1 as (select seq, i as a from it),
i2 as (select i1.seq, i1.a, it.i as b from i1 join it on it.seq = i1.seq and it.i > i1.a),
i3 as (select i2.seq, i2.a, i2.b, it.i as c from i2 join it on it.seq = i2.seq and it.i > i2.b),
i4 as (select i3.seq, i3.a, i3.b, i3.c, it.i as d from i3 join it on it.seq = i3.seq and it.i > i3.c),
lists as (select [a] as l from i1 union all select [a, b] from i2 union all select [a, b, c] from i3
          union all select [a, b, c, d] from i4),
tot as (select count(*) as n from conn),
freq as (select l, count(*) as rows, count(*) / any_value(n) as support from lists, tot group by l
         having count(*) / any_value(n) >= 0.01)"""

_RULES = f"""{_ITEMSETS},
rules as (select array_to_string(list_filter(w.l, lambda x: not starts_with(x, 'label=')), ', ') as antecedents,
    r.l[1] as consequents, w.support, w.rows / a.rows as confidence, (w.rows / a.rows) / r.support as lift
  from freq w
  join freq a on a.l = list_filter(w.l, lambda x: not starts_with(x, 'label='))
  join freq r on r.l = list_filter(w.l, lambda x: starts_with(x, 'label='))
  where len(w.l) - len(a.l) = 1 and w.rows / a.rows >= 0.7)"""

_ALERT_INPUT = f"""{WINDOWS},
ae as (select 't' || (src_port % 3) as tenant, ts_us // 10000000 as batch_id, ((ts_us // 10000000 + 1) * 10)::double as now,
    src_ip, label <> 'normal' as is_attack from conn),
sw as (select 't' || ((40000 + host) % 3) as tenant, (window_start_us + 60000000) // 10000000 as batch_id,
    (((window_start_us + 60000000) // 10000000 + 1) * 10)::double as now, (window_start_us // 60000000) * 32 + host as seq,
    src_ip, window_start_us, flow_count, round(distinct_dst_ports / 100 - 0.11, 4) as anomaly_score
  from (select *, split_part(src_ip, '.', 4)::bigint as host from win)),
sa as (select *, anomaly_score > 0 as is_anomaly from sw)"""

_ALERT_BATCHES = f"""{_ALERT_INPUT},
ab as (select tenant, batch_id, max(now) as now, count(*) filter (is_attack) as attacks from ae group by 1, 2),
an as (select tenant, batch_id, max(now) as now, count(*) as anomalies from sa where is_anomaly group by 1, 2),
bt as (select tenant, batch_id, coalesce(ab.now, an.now) as now, coalesce(attacks, 0) as attacks,
    coalesce(anomalies, 0) as anomalies,
    row_number() over (partition by tenant order by coalesce(ab.now, an.now), batch_id) as rn
  from ab full join an using (tenant, batch_id)),
fold as (
  select tenant, 0::bigint as rn, null::bigint as batch_id, null::double as now, 1::bigint as alert_no, 1::bigint as next_no,
         0::double as last, 0::bigint as pa, 0::bigint as pn, false as emits from (select distinct tenant from bt)
  union all
  select tenant, rn, batch_id, now, next_no, next_no + emits::int, case when emits then now else last end,
         case when emits then 0 else qa end, case when emits then 0 else qn end, emits
  from (select *, (qn > 0 or qa >= 5) and now - last >= 60 as emits
        from (select bt.tenant, bt.rn, bt.batch_id, bt.now, f.next_no, f.last, f.pa + bt.attacks as qa, f.pn + bt.anomalies as qn
              from fold f join bt on bt.tenant = f.tenant and bt.rn = f.rn + 1))
),
due as (select tenant, alert_no, max(now) as now from fold where emits group by 1, 2),
sig as (select fold.tenant, alert_no, 'a' as kind, src_ip, null::double as score, null::bigint as b, null::bigint as seq
        from ae join fold using (tenant, batch_id) where is_attack
        union all
        select fold.tenant, alert_no, 'n', src_ip, anomaly_score, batch_id, sa.seq
        from sa join fold using (tenant, batch_id) where is_anomaly),
al as (select due.tenant, due.alert_no, any_value(due.now) as now, count(*) filter (kind = 'a') as attacks,
    count(*) filter (kind = 'n') as anomalies, coalesce(max(score), 0) as worst_score,
    first(src_ip order by score desc, b, seq) filter (score > 0) as worst_src, count(distinct src_ip) as n_sources,
    list_sort(list(distinct src_ip))[1:3] as listed
  from due join sig using (tenant, alert_no) group by 1, 2),
msg as (select *, concat_ws('; ', case when attacks > 0 then attacks || ' attack flows flagged' end,
      case when anomalies > 0 then anomalies || ' anomalous source-window(s)' ||
        case when worst_src <> '' then ' (worst: ' || worst_src || ' score ' || printf('%.2f', worst_score) || ')' else '' end end)
    || ' — sources: ' || array_to_string(listed, ', ')
    || case when n_sources > 3 then ' (+' || (n_sources - 3) || ' more)' else '' end as message from al)"""

_NINE = ", ".join(f"round({c}, 9) as {c}" for c in ("accuracy", "precision", "recall", "f1"))
_TITLE = "Network attack alert"
_GREY = "list_transform(embedding, lambda x: x::double)"

_SPLIT = """n as (select label, count(*) as n from conn group by 1),
q as (select label, n, (sum(n) over ())::bigint as total from n),
k0 as (select *, (n * ceil(total * 0.3)::bigint) // total as k, (n * ceil(total * 0.3)::bigint) % total as rest from q),
k1 as (select label, k + (row_number() over (order by rest desc, label)
       <= ceil(total * 0.3)::bigint - (sum(k) over ())::bigint)::int as k from k0)"""

_WINDOW_COLUMNS = (
    "src_ip, window_start_us, flow_count, distinct_dst_ports, distinct_dst_hosts, failed_ratio, ports_per_host,"
    " total_bytes, mean_bytes"
)



def _rounded(columns: list[str], digits: int) -> str:
    """Rounds the exact binary value, halves to the even digit."""
    return ", ".join(f"format('{{:.{digits}f}}', {c}::double)::double as {c}" for c in columns)


ORACLES: dict[str, str] = {
    "verify_shape": " union all ".join(
        f"select '{t}' as name, 10000::bigint as expected_rows, count(*) as rows, {c} as expected_cols,"
        f" (select count(*) from information_schema.columns where table_name = '{t}')::int as cols,"
        f" count(*) = 10000 as ok from {t}"
        for t, c in (("events", 6), ("lineitem", 11), ("embeddings", 3), ("labels", 3))
    ),
    "clean_numeric": f"""with {_RAW}, txt as (select l_orderkey, l_linenumber, price as p, quantity as q from num)
select l_orderkey, l_linenumber,
  case when isnan(p) then 'nan' when isinf(p) then 'inf' else p::bigint::varchar end as price,
  case when isnan(q) then 'nan' when isinf(q) then 'inf' else q::bigint::varchar end as quantity from txt""",
    "clean_flows": f"""with {_RAW} select * from num where isfinite(price) and isfinite(quantity) and flow_duration >= 0""",
    "log_retention": f"""with {CONN}, l as (select seq, src_ip as log, label,
  row_number() over (partition by src_ip order by seq desc) as r from conn where label <> 'normal')
select seq, log, label from l where r <= 10000""",
    "rules_top20": f"with {CONN}, {_RULES} select * from rules order by lift desc, confidence desc, antecedents, consequents limit 20",
    "label_binary": f"with {CONN} select seq, (label <> 'normal')::int as target from conn",
    "label_multiclass": f"""with {CONN} select seq, label, {_CATEGORY} as category,
  {_index(_CATEGORY, ATTACK_CLASSES)} as class_index from conn""",
    "unknown_labels": f"""with {CONN}, l as (select distinct case when bytes % 50 = 0 then label || '_' || (bytes % 7) else label end as label from conn)
select label from l where {_CATEGORY} is null""",
    "label_binary_cic": f"with {CONN}, {_FLOW_LABELS} select seq, (label <> 'BENIGN')::int as target from fll",
    "label_cic_category": f"""with {CONN}, {_FLOW_LABELS}, c as (select seq, {_case('label', FLOW_CATEGORY, "'webattack'")} as category from fll)
select seq, category, {_index('category', FLOW_CLASSES)} as class_index from c""",
    "prediction_names": f"""with {CONN} select seq, (bytes % 5)::int as prediction,
  [{', '.join(f"'{c}'" for c in ATTACK_CLASSES)}][bytes % 5 + 1] as label, bytes % 5 <> 0 as is_attack from conn""",
    "service_name": f"with {CONN} select seq, proto, dst_port, service from conn",
    "file_activity": f"with {CONN} select seq, num_file_creations > 0 or num_access_files > 0 as has_file_activity from conn",
    "live_events": f"with {CONN}, {_EVENTS} select * from evt",
    "attack_filter": f"with {CONN}, {_EVENTS} select * from evt where is_attack",
    "packet_normalize": f"with {PACKETS}, {HEADERS} select * from norm",
    "own_traffic_filter": f"with {PACKETS} select * from pkt where not {_OWN}",
    "flow_meta": f"with {CONN} select seq, src_ip, dst_ip, dst_port, flag, bytes from conn",
    "pipeline_counters": f"""with recursive {PACKETS}, {HEADERS}, as_of as (select max(us) * 4 // 5 as now_us from hdr), seen as (select * from hdr where coalesce(us, 0) <= (select now_us from as_of)),
good as (select * from norm where us <= (select now_us from as_of)), own as (select * from good where not {_OWN}), {_tcp_assign('own')},
lastp as (select flow_seq, any_value(proto) as proto, max(us) as last_us, count(*) > 1 and any_value(proto) = 'tcp' and (
    count(*) filter (contains(tcp_flags, 'R')) > 0 or (count(*) filter (contains(tcp_flags, 'F') and up = flow_up) > 0
    and count(*) filter (contains(tcp_flags, 'F') and up <> flow_up) > 0)) as closed
  from asg where flow_seq is not null group by 1),
o as (select count(*) filter (not closed and (select now_us from as_of) - last_us <= {_IDLE}) as open,
  count(*) filter (closed or (select now_us from as_of) - last_us > {_IDLE}) as finalized from lastp),
bad as (select *, us is null or src_ip is null or dst_ip is null as broken from seen)
select (select count(*) from seen) as packets,
  (select count(*) from bad where not broken and not (ip_version = 4 and ip_proto in (1, 6, 17))) as non_ip,
  (select count(*) from good where {_OWN}) as own, (select count(*) from bad where broken) as errors, open, finalized from o""",
    "canonical_tuple": f"with {PACKETS}, {_tuples()} select seq, up, {_TUPLE} from tp",
    "idle_sessions": f"with {PACKETS}, {_idle_assign()} select seq, flow_seq, flow_us, flow_up from asg",
    "tcp_flows": f"with recursive {PACKETS}, {_TCP_ASSIGN} select seq, flow_seq, flow_us, flow_up from asg",
    "tcp_flows_by_sensor": f"with recursive {PACKETS}, {_tcp_assign()} select sensor, seq, flow_seq, flow_us, flow_up from asg".replace(
        _TUPLE, f"sensor, {_TUPLE}"
    ).replace("pkt as (select seq, us,", "pkt as (select 's' || (seq // 7 % 2) as sensor, seq, us,"),
    "flow_bytes": f"""{_IDLE_FLOWS} select flow_seq, fwd_pkts, bwd_pkts, src_bytes, dst_bytes, fwd_bytes, bwd_bytes,
  wrong_fragment, urgent from fs""",
    "flow_len_stats": f"""{_IDLE_FLOWS} select flow_seq, fwd_pkt_len_max, fwd_pkt_len_min, fwd_pkt_len_mean, bwd_pkt_len_max,
  bwd_pkt_len_min, bwd_pkt_len_mean, round(fwd_pkt_len_std, 6) as fwd_pkt_len_std, round(bwd_pkt_len_std, 6) as bwd_pkt_len_std from fs""",
    "flow_iat": f"""{_IDLE_FLOWS} select flow_seq, flow_iat_max, flow_iat_min, flow_iat_mean, fwd_iat_mean, bwd_iat_mean,
  round(flow_iat_std, 3) as flow_iat_std from fs""",
    "flow_flags": f"{_IDLE_FLOWS} select flow_seq, n_f, n_s, n_r, n_p, n_a, n_u, init_win_bytes_fwd, init_win_bytes_bwd from fs",
    "conn_state": f"{_IDLE_FLOWS} select flow_seq, flag from fs",
    "connections": f"""with recursive {PACKETS}, {_TCP_ASSIGN}, {_FLOWS}
select flow_seq as conn_id, last_us as ts_us, span // 1000000 as duration, proto, {_SERVICE} as service, flag, src_ip, src_port,
  dst_ip, dst_port, src_bytes, dst_bytes, (src_ip = dst_ip and src_port = dst_port)::int as land, wrong_fragment, urgent from fs""",
    "flow_features32": f"""{_IDLE_FLOWS}
select flow_seq as conn_id, dst_port::double as dst_port, span::double as flow_duration, fwd_pkts::double as tot_fwd_pkts,
  bwd_pkts::double as tot_bwd_pkts, fwd_bytes::double as tot_fwd_bytes, bwd_bytes::double as tot_bwd_bytes,
  fwd_pkt_len_max, fwd_pkt_len_min, fwd_pkt_len_mean, round(fwd_pkt_len_std, 3) as fwd_pkt_len_std,
  bwd_pkt_len_max, bwd_pkt_len_min, bwd_pkt_len_mean, round(bwd_pkt_len_std, 3) as bwd_pkt_len_std,
  round(case when span > 0 then (fwd_bytes + bwd_bytes) / (span / 1000000) else 0 end, 3) as flow_bytes_per_s,
  round(case when span > 0 then (fwd_pkts + bwd_pkts) / (span / 1000000) else 0 end, 3) as flow_pkts_per_s,
  flow_iat_mean, round(flow_iat_std, 3) as flow_iat_std, flow_iat_max, flow_iat_min, fwd_iat_mean, bwd_iat_mean,
  n_f::double as fin_flag_cnt, n_s::double as syn_flag_cnt, n_r::double as rst_flag_cnt, n_p::double as psh_flag_cnt,
  n_a::double as ack_flag_cnt, n_u::double as urg_flag_cnt,
  case when fwd_pkts > 0 then bwd_pkts / fwd_pkts else 0 end as down_up_ratio,
  (fwd_bytes + bwd_bytes) / (fwd_pkts + bwd_pkts) as avg_pkt_size,
  init_win_bytes_fwd::double as init_win_bytes_fwd, init_win_bytes_bwd::double as init_win_bytes_bwd from fs""",
    "conn_seq": f"""with {CONN} select seq as event_seq, src_ip,
  row_number() over (partition by src_ip order by ts_us, seq) - 1 as seq from conn""",
    "feat_2s_host": f"""{_PAIRS.format(source='conn')} select seq, n_host as count, host_serr, host_rerr, host_srv,
  host_serr / n_host as serror_rate, host_rerr / n_host as rerror_rate, host_srv / n_host as same_srv_rate,
  host_other_srv / n_host as diff_srv_rate from f""",
    "feat_2s_srv": f"""{_PAIRS.format(source='conn')} select seq, n_srv as srv_count, srv_serr, srv_rerr,
  srv_serr / n_srv as srv_serror_rate, srv_rerr / n_srv as srv_rerror_rate, srv_other_host / n_srv as srv_diff_host_rate from f""",
    "feat_100_host": f"""{_PAIRS.format(source='conn')} select seq, dh as dst_host_count, dhs as dst_host_srv_count,
  dhs / dh as dst_host_same_srv_rate, dh_other / dh as dst_host_diff_srv_rate, dh_port / dh as dst_host_same_src_port_rate,
  dh_se / dh as dst_host_serror_rate, dh_re / dh as dst_host_rerror_rate from f""",
    "feat_100_srv": f"""{_PAIRS.format(source='conn')} select seq, hs as dh_srv_all, dhs_se as dh_srv_serr, dhs_re as dh_srv_rerr,
  hs_other / hs as dst_host_srv_diff_host_rate, dhs_se / dhs as dst_host_srv_serror_rate,
  dhs_re / dhs as dst_host_srv_rerror_rate from f""",
    "feat_2s_exact": _PAIRS.format(
        source="(select * replace (ts_us - (case when seq % 7 = 0 then 31000000 else 0 end) as ts_us) from conn)"
    )
    + " select seq, n_host as count, n_srv as srv_count, host_serr, host_rerr, srv_serr, srv_rerr, host_srv from f",
    "conn_features41": f"""{_PAIRS.format(source='conn')} select seq, duration, protocol_type, service, flag, src_bytes, dst_bytes,
  land, wrong_fragment, urgent, {', '.join(f'0 as {c}' for c in CONTENT_FEATURES)}, {_RATES} from f join conn using (seq)""",
    "packet_features41": f"""with recursive {PACKETS}, {_TCP_ASSIGN}, {_FLOWS},
conn as (select row_number() over (order by last_us, flow_seq) - 1 as seq, last_us as ts_us, span // 1000000 as duration,
  proto as protocol_type, {_SERVICE} as service, flag, src_ip, src_port, dst_ip, dst_port, src_bytes, dst_bytes,
  (src_ip = dst_ip and src_port = dst_port)::int as land, wrong_fragment, urgent from fs),
{_PAIR_CTES.format(source='conn')} select seq, duration, protocol_type, service, flag, src_bytes, dst_bytes,
  land, wrong_fragment, urgent, {', '.join(f'0 as {c}' for c in CONTENT_FEATURES)}, {_RATES} from f join conn using (seq)""",
    "source_windows": f"with {CONN}, {WINDOWS} select {_WINDOW_COLUMNS} from win",
    "source_windows_rounded": f"""with {CONN}, {WINDOWS} select {_WINDOW_COLUMNS} from (select * replace (
  {_rounded(['failed_ratio', 'ports_per_host'], 4)}, {_rounded(['mean_bytes'], 2)}) from win)""",
    "closed_windows": f"with {CONN}, {WINDOWS} select {_WINDOW_COLUMNS} from win where window_start_us + 60000000 <= 1200000000",
    "open_windows": f"with {CONN}, {WINDOWS} select count(*) as open_windows from win where window_start_us + 60000000 > 1200000000",
    "onehot_long": f"""with {_FEATURES}, seen as (select distinct unnest(['l_returnflag=' || l_returnflag, 'l_linestatus=' || l_linestatus]) as item
  from feat where l_returnflag <> 'N'),
l as (select row_id, unnest(['l_returnflag=' || l_returnflag, 'l_linestatus=' || l_linestatus]) as item from feat)
select row_id, item, 1 as hot from l where item in (select item from seen)""",
    "scale_population": f"""with {_FEATURES}, m as (select
  {', '.join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in ('quantity', 'price', 'discount', 'tax'))} from feat)
select row_id, {', '.join(f"round(({c} - m_{c}) / case when s_{c} = 0 then 1 else s_{c} end, 6) as {c}" for c in ('quantity', 'price', 'discount', 'tax'))}
from feat, m""",
    "stratified_split": f"""with {CONN}, {_SPLIT} select seq, label,
  row_number() over (partition by label order by md5('42:' || seq)) <= k as is_test from conn join k1 using (label)""",
    "fixed_sample": f"with {CONN} select seq, label from conn order by md5('42:' || seq) limit 10000",
    "nb_class_stats": """with l as (select label, unnest(range(len(embedding))) as feature, unnest(embedding)::double as v from embeddings)
select label, feature, count(*) as n, round(avg(v), 6) as mean, round(var_pop(v), 6) as variance from l group by 1, 2""",
    "nb_predict": """with l as (select vec_id, label, unnest(range(len(embedding))) as i, unnest(embedding)::double as v from embeddings),
eps as (select 1e-9 * max(s) as e from (select var_pop(v) as s from l group by i)),
st as (select label as k, i, avg(v) as m, var_pop(v) + any_value(e) as s from l, eps group by 1, 2),
prior as (select label as k, ln(count(*) / (select count(*) from embeddings)) as p from embeddings group by 1),
sc as (select vec_id, any_value(label) as label, k, sum(-0.5 * (ln(2 * pi() * s) + (v - m) * (v - m) / s)) as ll
  from l join st using (i) group by vec_id, k)
select vec_id, any_value(label) as label, arg_max(k, ll + p)::int as prediction from sc join prior using (k) group by vec_id""",
    "inertia_given_centers": """with l as (select vec_id, label, unnest(range(len(embedding))) as i, unnest(embedding)::double as v from embeddings),
c as (select label, i, avg(v) as m from l group by 1, 2)
select round(sum((v - m) * (v - m)), 6) as inertia from l join c using (label, i)""",
    "silhouette_euclid": f"""with e as (select vec_id, label, {_GREY} as v from embeddings),
d as (select a.vec_id, a.label, b.label as other, avg(list_distance(a.v, b.v)) as m from e a join e b on a.vec_id <> b.vec_id group by 1, 2, 3),
s as (select vec_id, any_value(label) as cluster, max(m) filter (other = label) as i, min(m) filter (other <> label) as o from d group by 1)
select vec_id, cluster, round(case when i is null then 0 else (o - i) / greatest(o, i) end, 6) as silhouette from s""",
    "contamination_flag": f"""with {CONN}, {WINDOWS}, r as (select src_ip, window_start_us, -(total_bytes / flow_count) as raw_score from win)
select *, raw_score < (select quantile_cont(raw_score, 0.02) from r) as is_anomaly from r""",
    "metrics_binary": """with c as (select count(*) as n, count(*) filter (quality = toxic) as ok, count(*) filter (quality = 1 and toxic = 1) as tp,
  count(*) filter (quality = 1) as nl, count(*) filter (toxic = 1) as np from labels)
select ok / n as accuracy, case when np = 0 then 0 else tp / np end as precision, case when nl = 0 then 0 else tp / nl end as recall,
  case when nl + np = 0 then 0 else 2 * tp / (nl + np) end as f1 from c""",
    "metrics_macro": f"with {CONN}, {_PREDICTIONS} select {_NINE} from mac join acc using (model) where model = 'a'",
    "metrics_by_model": f"with {CONN}, {_PREDICTIONS} select model, {_NINE} from mac join acc using (model)",
    "dataset_counts": """select 'train' as split, count(*) as rows,
  (select count(*) from information_schema.columns where table_name = 'events')::int as cols from events""",
    "class_distribution": f"""with {CONN} select {_CATEGORY} as category, count(*) as rows,
  count(*) / (select count(*) from conn) as share from conn group by 1""",
    "label_distribution": f"with {CONN} select label, count(*) as rows, count(*) / (select count(*) from conn) as share from conn group by 1",
    "category_rollup": f"""with {CONN}, c as (select {_CATEGORY} as category, label from conn)
select category, label, count(*) as rows, 0 as level from c group by 1, 2
union all select category, null, count(*), 1 from c group by 1""",
    "transactions": f"with {CONN} select seq, array_to_string([{_ITEM_LIST}], ', ') as items from conn",
    "frequent_itemsets": f"with {CONN}, {_ITEMSETS} select array_to_string(l, ', ') as items, rows, support from freq",
    "frequent_itemsets_baskets": f"with {CONN}, {_ITEMSETS} select array_to_string(l, ', ') as items, rows, support from freq",
    "association_rules": f"with {CONN}, {_RULES} select * from rules",
    "rules_top50": f"with {CONN}, {_RULES} select * from rules order by lift desc, confidence desc, antecedents, consequents limit 50",
    "alert_inputs": f"""with {CONN}, {_ALERT_INPUT} select tenant, batch_id, max(now) as now, count(*) filter (is_attack) as attacks,
  count(distinct src_ip) filter (is_attack) as n_sources,
  coalesce(array_to_string(list_sort(list(distinct src_ip) filter (is_attack)), ','), '') as sources from ae group by 1, 2""",
    "worst_anomaly": f"""with {CONN}, {_ALERT_INPUT} select tenant, batch_id, max(now) as now, count(*) as anomalies,
  max(anomaly_score) as worst_score, first(src_ip order by anomaly_score desc, seq) as worst_src from sa where is_anomaly group by 1, 2""",
    "alert_replay": f"""with recursive {CONN}, {_ALERT_BATCHES} select tenant, alert_no, now, attacks, anomalies, worst_score, worst_src,
  n_sources, array_to_string(listed, ',') as listed from al""",
    "alert_message": f"with recursive {CONN}, {_ALERT_BATCHES} select tenant, alert_no, message from msg",
    "alert_payload": f"""with recursive {CONN}, {_ALERT_BATCHES}, kinds as (select unnest(['ntfy', 'discord', 'slack', 'generic', 'email']) as kind)
select tenant, alert_no, kind, case kind when 'discord' then '{{"content":"**{_TITLE}**\\n' || message || '"}}'
  when 'slack' then '{{"text":"*{_TITLE}*\\n' || message || '"}}'
  when 'generic' then '{{"title":"{_TITLE}","message":"' || message || '"}}' else message end as payload from msg, kinds""",
    "alert_status": f"""with recursive {CONN}, {_ALERT_BATCHES}
select 'ntfy' as kind, true as enabled, 60.0::double as cooldown_seconds, 5 as min_attacks, count(*) as alerts_sent,
  0::bigint as dispatch_failures from al union all
select 'slack', true, 60.0::double, 5, count(*) filter (alert_no % 4 <> 0), count(*) filter (alert_no % 4 = 0) from al""",
    "live_recent": f"with {CONN}, {_EVENTS} select seq, service, flag, label, is_attack from evt order by seq desc limit 50",
    "attack_log": f"""with {CONN}, {_EVENTS} select seq, service, flag, has_file_activity from evt
  where is_attack and has_file_activity order by seq desc limit 100""",
    "anomalies_recent": f"""with {CONN}, {_ALERT_INPUT}
select batch_id, seq, src_ip, window_start_us, flow_count, anomaly_score, is_anomaly from sa where is_anomaly order by seq desc limit 50""",
    "live_counts": f"""with {CONN}, {_EVENTS}, v as (select * from evt order by seq desc limit 50)
select count(*) as count, count(*) filter (is_attack) as attacks from v""",
    "anomaly_counts": f"""with {CONN}, {_ALERT_INPUT}, v as (select * from sa order by seq desc limit 200)
select count(*) as count, count(*) filter (is_anomaly) as anomalies from v""",
    "anomaly_status": f"""with {CONN}, {WINDOWS} select false as model_loaded, 60 as window_seconds,
  count(*) filter (window_start_us + 60000000 <= 1200000000) as baseline_windows_captured,
  count(*) filter (window_start_us + 60000000 > 1200000000) as windows_open from win""",
}

ORACLES["conn_features41_rounded"] = (
    f"select * replace ({_rounded([c for c in CONNECTION_FEATURES if c.endswith('_rate')], 2)}) from ({ORACLES['conn_features41']})"
)

# --- files, logs, models and streams ------------------------------------------------

_BASELINE_COLUMNS = "src_ip, window_start_us / 1000000 as window_start, " + ", ".join(WINDOW_FEATURES)
_ROUNDED_WINDOWS = f"""(select * replace ({_rounded(['failed_ratio', 'ports_per_host'], 4)}, {_rounded(['mean_bytes'], 2)},
  total_bytes::double as total_bytes) from win)"""
_KINDS = "case conn_id % 4 when 0 then 'BENIGN' when 1 then 'DoS Hulk' else 'PortScan' end as label"
_CATEGORIES = "protocol_type", "service", "flag"
_FITTED = "select vec_id, {0} as label, {0} as prediction from embeddings"
_TUPLES_NOT_TCP = "proto <> 'tcp'"

ORACLES |= {
    # Trees without a depth limit and boosting over all rounds fit the rows that they have learnt from.
    "dt_predict": _FITTED.format("label::int"),
    "gbt_predict": _FITTED.format("(label >= 5)::int"),
    "gbt_multiclass": _FITTED.format("(label % 5)::int"),
    "predict_batch": f"""with {CONN} select seq, {_index(_CATEGORY, ATTACK_CLASSES)} as prediction, {_CATEGORY} as label,
  label <> 'normal' as is_attack from conn""",
    "labelled_file": f"""with {CONN} select seq::double as num_root, duration::double as duration, protocol_type, service, flag,
  src_bytes::double as src_bytes, is_guest_login::double as is_guest_login, 0::double as hot, label from conn""",
    "flow_files": f"""select * exclude (conn_id), {_KINDS} from (@FLOWS@) where conn_id % 7 <> 0 and conn_id % 11 <> 0""",
    "baseline_log": f"with {CONN}, {WINDOWS} select {_BASELINE_COLUMNS} from {_ROUNDED_WINDOWS}",
    "dated_log": f"""with {CONN} select seq, label, strftime(date '2024-01-01' + (ts_us // 100000000)::int, '%Y-%m-%d') as log_date
from conn where label <> 'normal' and dst_ip = '192.168.0.3' order by ts_us // 100000000 desc, seq desc limit 70""",
    "stored_metrics": f"""with {CONN}, {_PREDICTIONS}, two as (select label > 0 as l, prediction > 0 as p from pr where model = 'a'),
c as (select count(*) filter (l and p) as tp, count(*) filter (p) as np, count(*) filter (l) as nl, count(*) filter (l = p) as hit,
  count(*) as n from two)
select 'binary' as phase, 'dt' as model, round(hit / n, 9) as accuracy, round(case when np = 0 then 0 else tp / np end, 9) as precision,
  round(case when nl = 0 then 0 else tp / nl end, 9) as recall,
  round(case when nl + np = 0 then 0 else 2 * tp / (nl + np) end, 9) as f1 from c""",
    "encoder_names": f"""with {CONN}, seen as (
  {' union all '.join(f"select distinct {i} as part, {c}::varchar as v, 'cat__{c}_' || {c} as name from conn" for i, c in enumerate(_CATEGORIES))}
  union all select 3, lpad(i::varchar, 3, '0'), 'num__' || n from (select unnest(range({len(NUMERIC_FEATURES)})) as i,
    unnest([{', '.join(f"'{c}'" for c in NUMERIC_FEATURES)}]) as n))
select (row_number() over (order by part, v) - 1)::int as i, name from seen""",
    "feature_matrix": f"""with {CONN}, {WINDOWS}, long as (
  {' union all '.join(f"select src_ip, window_start_us, {i} as i, {c}::double as v from win" for i, c in enumerate(WINDOW_FEATURES))}),
st as (select i, avg(v) as m, stddev_pop(v) as s from long group by 1)
select src_ip, window_start_us, i, round((v - m) / case when s = 0 then 1 else s end, 6) as value from long join st using (i)""",
    "trained_from_log": f"""with {CONN}, {WINDOWS}, r as (select * from {_ROUNDED_WINDOWS}), long as (
  {' union all '.join(f"select '{c}' as feature, {c}::double as v from r" for c in WINDOW_FEATURES)})
select feature, round(avg(v), 6) as mean, round(case when stddev_pop(v) = 0 then 1 else stddev_pop(v) end, 6) as deviation,
  count(*) as rows from long group by 1""",
    "iforest_trees": f"""with {CONN}, {WINDOWS}, n as (select least(count(*), 256) as n from win)
select t::int as tree, n as sample, n as leaf_rows, true as binary from range(200) r(t), n""",
    "streamed_sessions": f"""with {PACKETS}, {_idle_assign()} select flow_seq, max(us) as last_us,
  count(*) filter (up = flow_up) as fwd_pkts, count(*) filter (up <> flow_up) as bwd_pkts,
  coalesce(sum(payload_len) filter (up = flow_up), 0)::bigint as src_bytes, coalesce(sum(payload_len) filter (up <> flow_up), 0)::bigint as dst_bytes,
  coalesce(sum(ip_len) filter (up = flow_up), 0)::bigint as fwd_bytes, coalesce(sum(ip_len) filter (up <> flow_up), 0)::bigint as bwd_bytes
from asg where {_TUPLES_NOT_TCP} group by 1""",
    "streamed_windows": f"""with {CONN}, {WINDOWS} select {_BASELINE_COLUMNS} from {_ROUNDED_WINDOWS}
where window_start_us + 60000000 <= (select max(ts_us) from conn) - 1000000""",
    "streamed_scores": """with r as (select tot_fwd_pkts > 1 as bad from (@FLOWS@))
select count(*) as count, count(*) filter (bad) as attacks, count(*) filter (bad) as logged, count(*) as counted,
  count(*) filter (bad) as counted_attacks from r""",
    "late_split": f"""with {CONN}, p as (select *, case when seq % 50 = 0 then 2 else least(2, seq * 3 // (select count(*) from conn)) end as part from conn),
t as (select part, max(ts_us) as top from p group by 1), b as (select x.part, max(y.top) as top from t x join t y on y.part < x.part group by 1),
j as (select p.*, coalesce(ts_us < top - 1000000, false) as late from p left join b using (part))
select count(*) as rows, count(*) filter (late) as late, count(*) filter (not late) as in_time,
  coalesce(sum(seq) filter (late), 0)::bigint as late_seqs, count(*) filter (late) as late_rows from j""",
    "observed_counters": f"""with {PACKETS}, {HEADERS}, k as (select *, us is null or src_ip is null or dst_ip is null as broken,
  ip_version = 4 and ip_proto in (1, 6, 17) as ok, ip_proto = 6 and 443 in (src_port, dst_port) and '192.168.0.3' in (src_ip, dst_ip) as own from hdr)
select count(*) as packets, count(*) filter (not broken and not ok) as non_ip, count(*) filter (not broken and ok and own) as own,
  count(*) filter (broken) as errors, count(*) filter (not broken and ok and not own) as kept from k""",
    "hour_windows": f"""with {CONN} select src_ip, ts_us - ts_us % 600000000 as window_start_us, count(*) as flow_count,
  sum(bytes)::bigint as total_bytes, count(*) filter (flag in ({_FAILED})) as failed, true as ports_near, true as hosts_near
from conn where src_ip <> '' group by 1, 2""",
}
ORACLES["streamed_connections"] = ORACLES["connections"]
for _name in ("flow_files", "streamed_scores"):
    ORACLES[_name] = ORACLES[_name].replace("@FLOWS@", ORACLES["flow_features32"])
