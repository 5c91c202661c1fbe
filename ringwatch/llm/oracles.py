"""Reference SQL (DuckDB) of the queries that SQL can express."""

_HOST = "coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"

SQL = {
    "op12_repeated_spans": r"""
with texts as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from documents),
places as (select doc_id, ws, unnest(generate_series(1, len(ws))) as p from texts),
windows as (
  select doc_id, p, ws[p] as w, case when p + 19 <= len(ws) then md5(array_to_string(ws[p : p + 19], ' ')) end as name from places),
firsts as (select name, min((doc_id, p)) as at from windows where name is not null group by name),
marked as (select w.doc_id, w.p, w.w, f.at <> (w.doc_id, w.p) as again from windows w left join firsts f using (name)),
covered as (
  select doc_id, p, w, coalesce(bool_or(again) over (partition by doc_id order by p rows between 19 preceding and current row), false) as gone
  from marked),
cut as (
  select doc_id, count(*) filter (where gone) as n_removed, string_agg(w, ' ' order by p) filter (where not gone) as kept from covered group by doc_id)
select t.doc_id, len(t.ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from texts t left join cut using (doc_id)
""",
    "op10_line_dedup": r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
shared as (select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
marked as (select k.*, s.key is not null as gone from keyed k left join shared s on k.key = s.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (where gone)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
""",
    "op9_chat_format": r"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn, role, text) as n,
         coalesce(role, chr(1)) as role, coalesce(text, chr(1)) as text
  from (select distinct conv_id, turn, role, text from conversations where conv_id is not null)),
pre as (
  select conv_id, n, count(*) over (partition by conv_id) as n_all,
         string_agg(role || chr(2) || text || chr(3), '') over (partition by conv_id order by n) as prefix
  from turns),
whole as (
  select prefix, n, min(conv_id) as conv_id, count(*) as n_equal from pre where n = n_all group by prefix, n),
kept as (select * from whole w where not exists (
  select 1 from pre p where p.n < p.n_all and p.n = w.n and p.prefix = w.prefix)),
texts as (
  select conv_id, string_agg('<|' || replace(role, chr(1), '') || '|>' || chr(10) || replace(text, chr(1), '') || '<|end|>' || chr(10), '' order by n) as rendered
  from turns group by conv_id)
select k.conv_id, k.n as n_turns, k.n_equal, t.rendered from kept k join texts t using (conv_id)
""",
    "op6_url_filter": rf"""
with split as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages),
parts as (
  select page_id, {_HOST} as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from split),
outcomes as (
  select doc_id as page_id, max((coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1)::int) as bad
  from labels where doc_id is not null group by doc_id),
counts as (
  select host, count(bad) as n, coalesce(sum(bad), 0) as bad from parts left join outcomes using (page_id) group by host),
named as (
  select *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as two,
         array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') as three,
         list_extract(string_split(host, '.'), -1) as one from counts),
hosts as (
  select host, n, bad, case when two in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') then three else two end as domain,
         case when two in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') then two else one end as suffix
  from named),
domains as (select domain, suffix, sum(n) as n, sum(bad) as bad from hosts group by domain, suffix),
suffixes as (select suffix, sum(n) as n, sum(bad) as bad from domains group by suffix),
levels as (
  select 'h' as level, n, bad from hosts union all select 'd', n, bad from domains union all select 's', n, bad from suffixes),
moments as (
  select level, sum(n)::double as n, sum(bad)::double as bad, count(*) as g, sum(n::double * n) as n2, sum(bad::double * bad / n) as b2
  from levels where n > 0 group by level),
rooms as (
  select *, bad / n as p, (bad / n) * (1 - bad / n) * (n - n2 / n - (g - 1)) as room from moments),
kappa as (
  select level, case when g < 2 or room <= 0 then 1.0
    else 1 / least(greatest((b2 - n * p * p - (g - 1) * p * (1 - p)) / room, 0.001), 0.9) - 1 end as k from rooms),
ks as (
  select coalesce((select k from kappa where level = 'h'), 1.0) as kh, coalesce((select k from kappa where level = 'd'), 1.0) as kd,
         coalesce((select k from kappa where level = 's'), 1.0) as ksx,
         (coalesce((select sum(bad) from suffixes), 0) + 1)::double / (coalesce((select sum(n) from suffixes), 0) + 2) as overall),
sr as (select suffix, (bad + ksx * overall) / (n + ksx) as rate from suffixes, ks),
dr as (select d.domain, d.suffix, (d.bad + kd * sr.rate) / (d.n + kd) as rate from domains d join sr using (suffix), ks),
ab as (
  select h.host, h.bad + kh * dr.rate as a, h.n - h.bad + kh * (1 - dr.rate) as b
  from hosts h join dr using (domain, suffix), ks),
bounds as (select host, a / (a + b) - 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound from ab),
ruled as (
  select *, case
    when (host = 'example.net' or suffix(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or suffix(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or suffix(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
  from parts)
select page_id, host, path, rule,
  case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
       when bound > 0.5 then 'block' else 'allow' end as verdict
from ruled join bounds using (host)
""",
    "op5_near_duplicates": r"""
with recursive docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from docs),
sized as (select doc_id, len(s)::bigint as n, s from sets),
flat as (select doc_id, n, unnest(s) as g from sized),
links as (
  select a.doc_id as a, b.doc_id as b from flat a join flat b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach as (
  select doc_id as id, doc_id as r from sized union select l.b, reach.r from reach join links l on l.a = reach.id)
select s.doc_id, s.n as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from sized s join (select id, min(r) as component_id from reach group by id) c on c.id = s.doc_id
""",
    "op7_vector_duplicates": r"""
with recursive vecs as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
good as (
  select vec_id, label, v, sqrt(list_dot_product(v, v)) as norm from vecs
  where label is not null and v is not null and list_dot_product(v, v) > 0 and list_bool_and(list_transform(v, lambda x: isfinite(x)))),
links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach as (
  select vec_id as id, vec_id as r from embeddings union select l.b, reach.r from reach join links l on l.a = reach.id)
select e.vec_id, coalesce(n.n_links, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join (select id, min(r) as component_id from reach group by id) c on c.id = e.vec_id
left join (select a, count(*) as n_links from links group by a) n on n.a = e.vec_id
""",
    "op1_decontamination": r"""
with words as (
  select 'd' as what, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
  union all
  select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') from benchmark),
parts as (
  select id, 'q' as part, case when len(w) // 2 >= 5 then w[1:len(w) // 2] else w end as w from words where what = 'b' and len(w) > 0
  union all
  select id, 'a', case when len(w) // 2 >= 5 then w[len(w) // 2 + 1:] else w end from words where what = 'b' and len(w) > 0),
wanted as (
  select id, part, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) as g from parts),
sizes as (select id, part, count(*) as n from wanted group by id, part),
have as (
  select id as doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) as g from words where what = 'd' and len(w) > 0),
shares as (
  select h.doc_id, s.id, s.part, count(*)::double / any_value(s.n) as share
  from have h join wanted w on h.g = w.g join sizes s on s.id = w.id and s.part = w.part group by h.doc_id, s.id, s.part),
hits as (select doc_id, id from shares where share >= 0.8 group by doc_id, id having count(*) = 2),
found as (select doc_id, count(*) as n, string_agg(id::varchar, ',' order by id) as items from hits group by doc_id)
select d.doc_id, f.n is not null as contaminated, coalesce(f.n, 0)::bigint as n_items, coalesce(f.items, '') as items
from documents d left join found f using (doc_id)
""",
}
