"""Check SQL of the corpus queries that SQL can express, for whole tables."""

from __future__ import annotations

from docrisk.llm import conversation_checks, decontaminate, fm_dedup, line_dedup, ngram_join

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# Bits 5i to 5i+4 of a hex digest lie in two hex digits.
_DIGIT = "(strpos('0123456789abcdef', substr(h, {at}, 1)) - 1)"
_BASE32 = (
    f"array_to_string(list_transform(range(0, 32), lambda i: substr('{_ALPHABET}', 1 + cast(((16 * {_DIGIT.format(at='1 + i * 5 // 4')} + {_DIGIT.format(at='2 + i * 5 // 4')})"
    " >> (3 - i * 5 % 4)) & 31 as int), 1)), '')"
)

OP2 = f"""with p as (select page_id, url, sha1(encode(coalesce(html, ''))) as h, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes from pages),
k as (select h, max(page_id) as keeper from p group by 1)
select page_id, payload_bytes, {_BASE32.replace('substr(h,', 'substr(p.h,')} as payload_digest, case when page_id is distinct from keeper then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from keeper then keeper end as refers_to, url as target_uri from p join k on k.h = p.h"""

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"


def _shingles(words: str, n: str) -> str:
    return f"list_distinct(list_transform(range(1, len({words}) - {n} + 2), lambda i: array_to_string(list_slice({words}, i, i + {n} - 1), ' ')))"


OP3 = f"""with i as (select item_id, w, least({decontaminate.SHINGLE}, len(w)) as n from (select item_id, {_WORDS} as w from benchmark) where len(w) > 0),
s as (select item_id, n, unnest({_shingles('w', 'n')}) as g from i),
z as (select item_id, n, count(*) as n_shingles from s group by 1, 2),
d as (select doc_id, n, unnest({_shingles('w', 'n')}) as g from (select doc_id, text, {_WORDS} as w from documents), (select distinct n from i)),
h as (select d.doc_id, s.item_id, count(distinct d.g) as n_shared from d join s on s.g = d.g and s.n = d.n group by 1, 2)
select doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles as containment from h join z using (item_id) where n_shared >= {decontaminate.THRESHOLD} * n_shingles"""

_LEAD = (
    "array_to_string(list_transform(list_slice(string_split(x, ' '), 1, " + str(line_dedup.DEPTH) + "), "
    "lambda t: case when regexp_matches(t, '[0-9@]|://') then '<*>' else t end), ' ')"
)


def _leaf(x: str) -> str:
    return f"cast(len(string_split({x}, ' ')) as varchar) || '|' || {_LEAD.replace('(x,', f'({x},')}"


_KIND = "regexp_matches(token, '[0-9@]|://')"
_M = line_dedup.MIN_SOURCES
OP5 = f"""with l as (select doc_id, text, coalesce(text, '') as x, string_split(coalesce(text, ''), chr(10)) as lines from documents),
r as (select doc_id, text, x, length(replace(x, chr(10), '')) as total, unnest(lines) as raw, unnest(range(1, len(lines) + 1)) as pos from l),
q as (select *, {_leaf('line')} as leaf from (select *, trim(raw, ' ') as line from r) where line <> ''),
wide as (select leaf, length(bin(count(distinct x))) as bits from q group by 1 having count(distinct x) >= {_M}),
t as (select leaf, line, count(distinct x) as n from q where leaf in (select leaf from wide) group by 1, 2),
tok as (select leaf, line, n, unnest(string_split(line, ' ')) as token, unnest(range(1, len(string_split(line, ' ')) + 1)) as pos from t),
often as (select leaf, pos, token from tok where pos > {line_dedup.DEPTH} and not {_KIND} group by 1, 2, 3 having sum(n) >= {_M}),
m as (select leaf, line, count(*) as size, count(*) filter (pos <= {line_dedup.DEPTH} and not {_KIND}) as lead, count(*) filter (pos > {line_dedup.DEPTH} and not {_KIND}) as words,
    count(*) filter (often.token is not null) as fixed, coalesce(string_agg(pos || ' ' || token, chr(10) order by pos) filter (often.token is not null), '') as template
  from tok left join often using (leaf, pos, token) group by 1, 2),
member as (select leaf, line, template from m where fixed * 100 >= words * {line_dedup.LIKENESS} and 2 * (lead + fixed) >= size),
once as (select distinct x, total, pos, leaf, line, length(raw) as size from q where leaf in (select leaf from wide)),
held as (select leaf, template, x, total, sum(size) as own from once join member using (leaf, line) group by 1, 2, 3, 4),
tpl as (select leaf, template, length(bin(count(*))) as bits from held group by 1, 2 having count(*) >= {_M}),
spread as (select x, bits, sum(size) as chars from once join wide using (leaf) group by 1, 2),
body as (select held.leaf, held.template, held.x, max(total - own) as rest, max(total) - sum(chars) filter (spread.bits > tpl.bits - 2) as body from held join tpl using (leaf, template) join spread on spread.x = held.x group by 1, 2, 3),
found as (select leaf, template from body where body > 0 and 2 * body >= rest group by 1, 2 having count(*) >= {_M}),
bad as (select q.*, min(doc_id) over (partition by found.leaf, found.template) as keeper from q join member using (leaf, line) join found on found.leaf = q.leaf and found.template = member.template),
gone as (select doc_id, text, list(distinct pos) as gone from bad where doc_id is distinct from keeper group by 1, 2)
select l.doc_id, case when gone is null then l.text else array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda i: not list_contains(gone, i)), lambda i: lines[i]), chr(10)) end as text,
  cast(len(lines) as bigint) as n_lines, cast(coalesce(len(gone), 0) as bigint) as n_dropped
from l left join gone on gone.doc_id is not distinct from l.doc_id and gone.text is not distinct from l.text"""

OP6 = f"""with recursive t as (select coalesce(text, '') as x, min(doc_id) as first, {_WORDS} as w from documents group by coalesce(text, ''), text),
s as (select first, unnest({_shingles('w', f'least({ngram_join.SHINGLE}, len(w))')}) as g from t where len(w) > 0),
z as (select first, count(*) as n from s group by 1),
p as (select a.first as a, b.first as b, count(*) as shared from s a join s b on a.g = b.g and a.first < b.first group by 1, 2),
e as (select a, b from p join z za on za.first = a join z zb on zb.first = b where shared >= {ngram_join.THRESHOLD} * (za.n + zb.n - shared) - 1e-9),
u as (select a, b from e union all select b, a from e),
reach as (select first as node, first as other from t union select reach.node, u.b from reach join u on u.a = reach.other),
c as (select node, min(other) as class_id from reach group by 1),
k as (select a, count(*) as n_links from u group by 1)
select d.doc_id, c.class_id, coalesce(n_links, 0) as n_links from documents d join t on t.x = coalesce(d.text, '') join c on c.node = t.first left join k on k.a = t.first"""

OP9 = rf"""with w as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select r, i, md5(array_to_string(list_slice(w, i, i + {fm_dedup.WINDOW - 1}), ' ')) as g from (select r, w, unnest(range(1, len(w) - {fm_dedup.WINDOW - 2})) as i from w)),
often as (select g from s group by 1 having count(*) > 1),
starts as (select r, list(i) as starts from s where g in (select g from often) group by 1),
gone as (select r, list_distinct(flatten(list_transform(starts, lambda i: range(i, i + {fm_dedup.WINDOW})))) as gone from starts)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(len(gone), 0) as bigint) as n_removed,
  sha256(case when gone is null then array_to_string(w, ' ') else array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: not list_contains(gone, i)), lambda i: w[i]), ' ') end) as kept_sha256
from w left join gone using (r)"""

SQL = {"op2_warc": OP2, "op3_decontaminate": OP3, "op5_line_dedup": OP5, "op6_ngram_join": OP6, "op9_fm_dedup": OP9} | conversation_checks.SQL
