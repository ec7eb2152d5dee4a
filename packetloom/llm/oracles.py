"""SQL (DuckDB) for queries of this subpackage, written from their definitions in the plainest form."""

from __future__ import annotations

from packetloom.llm import licenses, secrets


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# What a match must pass beyond its pattern.
_KEPT = {
    "assign": "length(value) >= 6",
    "account": "length(value) >= 3",
    "random": "regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Z]') and regexp_matches(value, '[a-z]')",
}


def _part(p: secrets.Part) -> str:
    pattern = _text(p.pattern)
    return f"""select rid, '{p.kind}' as kind, '{p.role}' as role, {p.strong} as strong, e - n as a, e as b from (
  select rid, value, n, sum(gap + coalesce(n, 0)) over (partition by rid order by i) as e from (
    select rid, i, length(piece) as gap, length(hit) as n, value from (
      select rid, generate_subscripts(string_split_regex(t, {pattern}), 1) as i, unnest(string_split_regex(t, {pattern})) as piece,
        unnest(regexp_extract_all(t, {pattern}, 0)) as hit, unnest(regexp_extract_all(t, {pattern}, {p.value})) as value from d)))
where n is not null and {_KEPT.get(p.kind, 'true')}"""


_NEAR = f"""o.a - w.b <= {secrets.SCOPE} and w.a - o.b <= {secrets.SCOPE} and (o.a >= w.b or o.b <= w.a
    or o.kind <> w.kind and 'address' in (o.kind, w.kind))"""
_RANKS = " ".join(f"when '{p.kind}' then {i}" for i, p in enumerate(secrets.PARTS))
_LISTED = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, rank){}, '')"
_STRONG = " filter (where strong)"
_COUNTS = ", ".join(f"count(*) filter (where kind = '{p.kind}') as n_{p.kind}" for p in secrets.PARTS if p.strong)

SECRETS = f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
part as ({' union all '.join(map(_part, secrets.PARTS))}),
near as (select w.rid, w.kind, w.a, w.b, bool_or(o.role = 'identifier') as i, bool_or(o.role = 'secret') as s,
    bool_or(o.role = 'address') as e
  from part w join part o on o.rid = w.rid and {_NEAR} where not w.strong group by 1, 2, 3, 4),
span as (select rid, kind, a, b, true as strong from part where strong
  union all select rid, kind, a, b, false from near
  where kind = 'account' and s or kind = 'random' and (i or e) or kind = 'address' and i and s),
ranked as (select *, case kind {_RANKS} end as rank from span)
select doc_id, {_COUNTS}, sha256({_LISTED.format(_STRONG)}) as base_sha256, {_LISTED.format('')} as spans
from d left join ranked using (rid) group by rid, doc_id"""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = r"regexp_extract_all(translate({}, " + _LETTERS + r"), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TEMPLATES = ", ".join(f"({i}, {_text(t.label)}, {_text(t.text)}, {t.whole})" for i, t in enumerate(licenses.TEMPLATES))
_GRAM = "array_to_string(w[{0} + 1:{0} + size], ' ')"

LICENSES = f"""with d as (select row_number() over () as rid, doc_id, {_WORDS.format("coalesce(text, '')")} as w from documents),
t0 as (select template, label, whole, {_WORDS.format('text')} as w from (values {_TEMPLATES}) v(template, label, text, whole)),
t as (select *, len(w) as length, least({licenses.GRAM}, len(w)) as size from t0),
tg as (select template, label, whole, length, size, pos, {_GRAM.format('pos')} as gram
  from (select *, unnest(range(length - size + 1)) as pos from t)),
dg as (select rid, size, p, {_GRAM.format('p')} as gram
  from (select rid, w, size, unnest(range(len(w) - size + 1)) as p from d, (select distinct size from t))),
hit as (select rid, template, label, whole, length, size, pos, p from dg join tg using (size, gram)),
vote as (select rid, template, label, whole, length, size, p - pos as diagonal, min(p) as a, max(p + size) as b, list(distinct pos) as ats
  from hit group by all),
step as (select *, lag(diagonal) over (partition by rid, template order by diagonal) as last from vote),
band as (select *, sum(case when whole or last is null or diagonal - last > {licenses.BAND} then 1 else 0 end)
  over (partition by rid, template order by diagonal rows unbounded preceding) as near from step),
reached as (select *, max(b) over (partition by rid, template, near order by a, diagonal
  rows between unbounded preceding and 1 preceding) as reach from band),
run as (select *, sum(case when reach is null or a - reach > {licenses.GAP} then 1 else 0 end)
  over (partition by rid, template, near order by a, diagonal rows unbounded preceding) as run from reached),
merged as (select rid, template, label, whole, length, size, near, run, min(a) as a, flatten(list(ats)) as ats from run group by all),
cover as (select *, len(list_distinct(flatten(list_transform(ats, lambda x: range(x, x + size))))) / length as coverage from merged),
span as (select * from cover where coverage >= case when whole then 1 else {licenses.COVER} end),
named as (select doc_id, d.rid, len(w) as n_words, a, label, whole, coverage from d left join span using (rid))
select doc_id, n_words, count(*) filter (where whole) as n_base, min(a) filter (where whole) as first_word,
  max(a) filter (where whole) as last_word,
  coalesce(string_agg(distinct label, ',' order by label) filter (where whole), '') as base_labels,
  coalesce(string_agg(distinct label, ',' order by label), '') as labels, coalesce(max(coverage), 0.0)::double as score
from named group by rid, doc_id, n_words"""

# Levels of each source's tree and of the tree over their roots as lists; a document climbs them one at a time.
# crc32 by its bitwise rule over the digits of the id.
MERKLE = r"""
with recursive docs as (
  select doc_id, source, text,
    array_to_string(list_transform([cast(doc_id as varchar), source, lang, cast(n_chars as varchar)],
      lambda x: case when x is null then '-' else strlen(x) || ':' || x end), '') as head,
    list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(range(8 * length(cast(doc_id as varchar))),
        lambda i: case when i % 8 = 0 then cast(256 + ascii(substr(cast(doc_id as varchar), cast(i // 8 + 1 as int), 1)) as bigint) else 0 end)),
      lambda c, x: case when (xor(c, x % 256) & 1) = 1 then xor(xor(c, x % 256) >> 1, 3988292384) else xor(c, x % 256) >> 1 end) as crc
  from documents),
hashed as (
  select *, sha256(head || case when text is null then '-' else strlen(text) || ':' || text end) as leaf,
    sha256(head || case when text is null then '-'
      else strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') end) as cut
  from docs),
placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos from hashed),
low as (
  select source, 0 as level, list(leaf order by pos) as nodes from placed group by source
  union all
  select source, level + 1, list_transform(range(0, cast((len(nodes) + 2) // 3 as bigint)),
    lambda i: sha256(array_to_string(nodes[i * 3 + 1 : i * 3 + 3], ''))) from low where len(nodes) > 1),
subroots as (
  select source, nodes[1] as subroot, row_number() over (order by source nulls first) - 1 as place
  from low where len(nodes) = 1),
high as (
  select 0 as level, list(subroot order by place) as nodes from subroots
  union all
  select level + 1, list_transform(range(0, cast((len(nodes) + 2) // 3 as bigint)),
    lambda i: sha256(array_to_string(nodes[i * 3 + 1 : i * 3 + 3], ''))) from high where len(nodes) > 1),
climb as (
  select p.doc_id, p.leaf, s.source, s.subroot, s.place, 0 as level, p.pos as own, '' as proof,
    case when ((4294967295 - crc) & 1) = 0 then cut else leaf end as folded
  from placed p join subroots s on p.source is not distinct from s.source
  union all
  select doc_id, leaf, c.source, subroot, place, c.level + 1, own // 3,
    proof || array_to_string(nodes[(own // 3) * 3 + 1 : own], '') || array_to_string(nodes[own + 2 : (own // 3) * 3 + 3], ''),
    sha256(array_to_string(nodes[(own // 3) * 3 + 1 : own], '') || folded || array_to_string(nodes[own + 2 : (own // 3) * 3 + 3], ''))
  from climb c join low l on l.source is not distinct from c.source and l.level = c.level and len(l.nodes) > 1),
above as (
  select doc_id, leaf, subroot, 0 as level, place as own, proof, folded from climb c
  where level = (select max(level) from low l where l.source is not distinct from c.source)
  union all
  select doc_id, leaf, subroot, a.level + 1, own // 3,
    proof || array_to_string(nodes[(own // 3) * 3 + 1 : own], '') || array_to_string(nodes[own + 2 : (own // 3) * 3 + 3], ''),
    sha256(array_to_string(nodes[(own // 3) * 3 + 1 : own], '') || folded || array_to_string(nodes[own + 2 : (own // 3) * 3 + 3], ''))
  from above a join high h on h.level = a.level and len(h.nodes) > 1)
select doc_id, leaf, subroot, (select nodes[1] from high where len(nodes) = 1) as root, sha256(proof) as proof_sha256,
  folded as folded_root, folded = (select nodes[1] from high where len(nodes) = 1) as verified
from above where level = (select max(level) from high)
"""

NEGATIVES = r"""
with sound as (
  select vec_id, embedding, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as (
  select vec_id, label, unnest(embedding) as x, generate_subscripts(embedding, 1) as j from sound),
whole as (select vec_id, label, j, cast(floor(256 * cast(x as double)) as bigint) as x from parts),
scores as (
  select a.vec_id as anchor, b.vec_id as id, a.label = b.label as same, cast(sum(a.x * b.x) as bigint) as score
  from whole a join whole b on a.j = b.j and a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
  group by all),
positives as (
  select anchor, id, score from scores where same
  qualify row_number() over (partition by anchor order by score desc, id) <= 5),
found as (
  select p.anchor as anchor_id, p.id as positive_id, n.id as negative_id, p.score as positive_score, n.score as negative_score,
    row_number() over (partition by p.anchor, p.id order by n.score desc, n.id) as rank
  from positives p join scores n on n.anchor = p.anchor and not n.same
    and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from found where rank <= 10
"""

SUBSTRINGS = r"""
with docs as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') as words from documents),
starts as (
  select doc_id, words, unnest(range(1, cast(len(words) - 48 as bigint))) as i from docs where len(words) >= 50),
windows as (
  select doc_id, i, sha256(array_to_string(words[i : i + 49], ' ')) as w from starts),
later as (
  select doc_id, i from windows
  qualify doc_id > min(doc_id) over (partition by w)),
gone as (
  select distinct doc_id, p from (select doc_id, unnest(range(i, i + 50)) as p from later)),
marks as (
  select doc_id, list(p) as places from gone group by doc_id)
select d.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(len(places), 0) as bigint) as n_removed,
  sha256(coalesce(array_to_string(list_filter(words, lambda x, i: not list_contains(coalesce(places, []), i)), ' '), '')) as kept_sha256
from docs d left join marks m on m.doc_id = d.doc_id
"""
