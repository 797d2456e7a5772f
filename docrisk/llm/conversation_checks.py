"""Check SQL of the conversation queries, for whole tables."""

from __future__ import annotations


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, bit by bit."""
    bit = "list_reduce(list_prepend(xor({c}, {b}), range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)"
    codes = f"list_transform(string_split({text}, ''), lambda s: cast(ascii(s) as bigint))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {codes}), lambda c, b: {bit.format(c='c', b='b')}), 4294967295)"


# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Moves over a gap: up to two inserted rows.
_GAPS = """gaps(a, b, cost, letters, lines) as (values (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''),
  (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'), (3, 2, 5, 'I', chr(10) || 'user:'),
  (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'))"""
_KEEPS = "keeps(a, initial, b) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2))"
_ROLES = "roles(a, b, role) as (values (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user'))"
_VISIBLE = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP12 = f"""with recursive {_GAPS}, {_KEEPS}, {_ROLES},
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {crc32("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as k from conversations),
damaged as (select conv_id, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then translate(text, '.!?', '') else text end as text,
    unnest(range(case when k = 3 then 2 else 1 end)) as copy from k where k <> 0),
faults as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as p, {_VISIBLE} = '' as blank,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again, right({_VISIBLE}, 1) not in ('.', '!', '?') as cut, left(role, 1) as initial from damaged),
r as (select conv_id, turn, role, text, p, initial, blank, again and not blank as again, cut and not again and not blank as cut, blank or again as goes,
    lag(initial) over (partition by conv_id order by p) as before from faults),
ids as (select distinct conv_id from conversations),
best as (
  select conv_id, 0 as p, 0 as state, struct_pack(cost := 0, audit := '', lines := '') as path from ids
  union all
  select conv_id, p, state, min(path) as path from (
    select b.conv_id, b.p + 1 as p, m.b as state, struct_pack(cost := b.path.cost + g.cost + m.cost, audit := b.path.audit || g.letters || m.letter, lines := b.path.lines || g.lines || m.line) as path
    from best b join gaps g on g.a = b.state join r on r.conv_id is not distinct from b.conv_id and r.p = b.p + 1
    join (select conv_id, p, a, a as b, 2 as cost, 'D' as letter, '' as line from r, (select distinct a from gaps)
      union all select conv_id, p, a, b, case when cut then 5 else 0 end, 'K', chr(10) || role || ':' || text from r join keeps using (initial) where not goes
      union all select conv_id, p, a, b, case when cut then 6 else 1 end, 'R', chr(10) || roles.role || ':' || text from r, roles where not goes) m
      on m.conv_id is not distinct from b.conv_id and m.p = b.p + 1 and m.a = g.b) group by 1, 2, 3),
last as (select conv_id, max(p) as p from best group by 1),
done as (select b.conv_id, min(struct_pack(cost := b.path.cost + g.cost, audit := b.path.audit || g.letters, lines := b.path.lines || g.lines)) as path
  from best b join last on last.conv_id is not distinct from b.conv_id and last.p = b.p join gaps g on g.a = b.state where g.b in (0, 3) group by 1),
told as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again) as duplicate,
    count(*) filter (cut) as truncated, count(*) filter (before || initial not in ('su', 'ua', 'au')) as illegal from r group by 1)
select d.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  cast(path.cost as bigint) as cost, path.audit as audit, sha256(substr(path.lines, 2)) as repaired_sha256
from done d left join told t on t.conv_id is not distinct from d.conv_id"""

OP13 = f"""with o as (select conv_id, md5(cast(strlen(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, '')) as id, cast(strlen(coalesce(text, '')) as bigint) as size, turn from conversations where conv_id is not null),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, id) as pos from o),
c as (select conv_id, conv_id - conv_id % 5 as block, {crc32("cast(conv_id as varchar)")} % 9 as h from (select distinct conv_id from o)),
b as (select c.conv_id, n.id, n.size, n.pos from c join n on n.conv_id = c.block and n.pos <= c.h
  union all select c.conv_id, n.id, n.size, n.pos + 100 from c join n on n.conv_id = c.conv_id and n.pos > c.h),
t as (select conv_id, id, size, row_number() over (partition by conv_id order by pos) as d from b),
p as (select conv_id, d, size, string_agg(id, '') over (partition by conv_id order by d rows unbounded preceding) as k from t union all select conv_id, 0, 0, '' from c),
z as (select conv_id, max(d) as len from p group by 1),
m as (select k, d as depth, min(p.conv_id) as conv_id, count(*) as n_convs, max(size) as size, coalesce(string_agg(cast(p.conv_id as varchar), ',' order by p.conv_id) filter (d = len), '') as ends from p join z using (conv_id) group by 1, 2),
u as (select x.k, x.depth, x.conv_id, x.n_convs, x.ends, (x.n_convs - 1) * x.size as own, y.conv_id as parent_conv_id, y.k as parent from m x left join m y on x.depth > 0 and y.depth = x.depth - 1 and y.k = left(x.k, 32 * (cast(x.depth as int) - 1))),
ch as (select parent as k, count(*) as n_children from u where parent is not null group by 1),
f as (select u.*, coalesce(n_children, 0) as n_children from u left join ch using (k)),
s as (select q.k, sum(own) as saved, count(*) filter (n_children = 0) as n_leaves from f join (select f.conv_id, f.depth, p.k from f join p on p.conv_id = f.conv_id and p.d <= f.depth) q on q.conv_id = f.conv_id and q.depth = f.depth group by 1)
select f.conv_id, cast(f.depth as bigint) as depth, f.parent_conv_id, f.n_convs, f.n_children, s.n_leaves, cast(s.saved as bigint) as saved_tokens, sha256(f.ends) as ends_sha256 from f join s using (k)"""

SQL = {"op12_repair": OP12, "op13_prefix_trie": OP13}
