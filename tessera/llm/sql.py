"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

#: Every url against every rule, the longest fitting rule first.
OP3 = r"""
with rules(action, host, path) as (values
  ('allow','com','/'), ('block','example.com','/en/'), ('allow','www.example.com','/en/'), ('block','net','/es/'), ('block','net','/fr/')),
cut as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
fits as (select p.page_id, r.host || r.path as rule, r.action,
    row_number() over (partition by p.page_id order by length(r.host || r.path) desc, length(r.host) desc, r.action desc) as n
  from parts p join rules r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path))
select p.page_id, p.host, p.path, f.rule, coalesce(f.action, 'allow') as verdict
from parts p left join fits f on f.page_id = p.page_id and f.n = 1
"""

#: Records in the order of their keys, and the pages that the replica changes.
OP10 = r"""
with b as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages),
t as (select page_id, concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: resource', 'WARC-Record-ID: <urn:page:' || page_id || '>', 'WARC-Target-URI: ' || url, 'WARC-Date: 1970-01-01T00:00:00Z', 'Content-Type: text/html', 'Content-Length: ' || strlen(html), '', html, '', '') as text,
  html <> '' and not ends_with(html, '~') as other from b),
r as (select page_id, strlen(text)::bigint as length, sha256(text) as digest, other from t),
k as (select *, sha256(page_id || ':' || digest) as key, greatest((select case when count(*) < 16 then 0 else length(to_hex(count(*) // 16)) end from pages) - 2, 0) as cut from r),
s as (select *, substr(key, 1, cut) as segment, row_number() over (partition by substr(key, 1, cut) order by key) - 1 as seq, coalesce(sum(length) over (partition by substr(key, 1, cut) order by key rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from k)
select page_id, segment, seq, "offset", length, digest, case when page_id % 50 = 7 and other then 'damaged' when page_id % 50 = 27 then 'damaged' when page_id % 50 = 17 then 'missing' else 'intact' end as state from s
union all select -page_id, null, null, null, null, null, 'added' from pages where page_id % 50 = 37
"""

#: Turns by place, prefixes by a digest of all turns so far, and each node's ancestors by a member's prefixes.
OP11 = r"""
with t as (select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as i from conversations where conv_id is not null),
bytes as (select distinct c, list_transform(string_split(c::varchar, ''), lambda z: ascii(z)::bigint) as b from t),
heads as (select c, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda a, z: list_reduce(list_prepend(xor(a, z), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295::bigint) % 9 as h from bytes),
k as (select h.c, t.i, t.r, t.x from heads h join t on t.c = h.c - h.c % 5 and t.i < h.h union all select h.c, t.i, t.r, t.x from heads h join t on t.c = h.c and t.i >= h.h),
n as (select c, row_number() over (partition by c order by i) as d, md5(concat(strlen(r), ':', r, x)) as m, strlen(x) as bytes from k),
chained as (select c, d, bytes, md5(string_agg(m, '') over (partition by c order by d rows unbounded preceding)) as node from n
  union all select c, 0, 0, 'root' from heads),
ends as (select c, arg_max(node, d) as node from chained group by c),
digests as (select node, sha256(string_agg(c::varchar, ',' order by c)) as digest from ends group by node),
up as (select a.node, min(b.node) as parent from chained a join chained b on a.c = b.c and a.d = b.d + 1 group by a.node),
nodes as (select node, min(c) as c, max(d) as d, count(*) as n, (count(*) - 1) * max(bytes) as own from chained group by node),
kids as (select parent as node, count(*) as n from up group by parent),
under as (select b.node, sum(a.own) as saved, count(*) filter (k.n is null) as leaves from nodes a left join kids k on k.node = a.node join chained b on b.c = a.c and b.d <= a.d group by b.node)
select a.c as conv_id, a.d::bigint as depth, p.c as parent_conv_id, a.n as n_convs, coalesce(k.n, 0)::bigint as n_children, u.leaves::bigint as n_leaves, u.saved::bigint as saved_tokens, coalesce(e.digest, sha256('')) as ends_sha256
from nodes a left join up on up.node = a.node left join nodes p on p.node = up.parent left join kids k on k.node = a.node join under u on u.node = a.node left join digests e on e.node = a.node
"""

ORACLE_SQL = {"op3_urls": OP3, "op10_warc": OP10, "op11_prefixes": OP11}
