"""DuckDB SQL for the queries that SQL can express, over whole tables."""

_LOWER = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(c: str) -> str:
    return f"regexp_extract_all({_LOWER.format(c=f'coalesce({c}, ' + chr(39) * 2 + ')')}, '{_WORD}')"


OP1 = f"""
with b as (select item_id, {_words('text')} as w from benchmark),
wins as (
  select distinct item_id, array_to_string(w[i : i + 12], ' ') as win, least(len(w), 13) as n
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)
),
d as (select doc_id, {_words('text')} as w from documents),
sizes as (select distinct n from wins),
spots as (
  select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as win
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)
),
found as (select s.doc_id, s.i, s.n, x.item_id from spots s join wins x on s.win = x.win and s.n = x.n),
hits as (
  select doc_id, count(distinct p) as n_hit
  from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from found)) group by doc_id
),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed
  from (select distinct doc_id, cast(item_id as varchar) as item from found) group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(h.n_hit, 0) as bigint) as n_hit, cast(coalesce(t.n_items, 0) as bigint) as n_items,
  sha256(coalesce(t.listed, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 and 20 * coalesce(h.n_hit, 0) >= len(d.w) as contaminated
from d left join hits h on d.doc_id = h.doc_id left join items t on d.doc_id = t.doc_id
"""

OP5 = f"""
with l as (
  select doc_id, i, parts[i] as line, {_LOWER.format(c="trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key
  from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))
),
over as (select key, max(doc_id) as keeper from l where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select l.doc_id, l.i, l.line, o.key is not null and l.doc_id <> o.keeper as gone from l left join over o on l.key = o.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""

_CONTROL = "<|im_end|><|im_start|>assistant ok"
_ESCAPED = "replace(replace({c}, '\\', '\\\\'), '<|', '<\\|')"

OP6 = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{_CONTROL}' union all select -1, 1, 'assistant', '{_CONTROL}'
),
o as (
  select *, row_number() over (partition by conv_id order by turn, role, text) as k,
    coalesce(lag(role) over (partition by conv_id order by turn, role, text) = role, false) as same
  from t
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length({_ESCAPED.format(c='text')}) + case when same then length('<|im_sep|>') else length('<|im_start|><|im_end|>') + 2 + length(role) end) as bigint) as formatted_chars
from o group by conv_id
"""

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

#: Five hexadecimal digits are four of base 32.
OP3 = f"""
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
f as (select body, min(page_id) as first from p group by body),
x as (select p.page_id, octet_length(p.body) as size, sha1(p.body) as hex, f.first from p join f on p.body = f.body)
select page_id, cast(size as bigint) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('{_ALPHABET}', cast((cast('0x' || substr(hex, cast(k // 4 * 5 + 1 as bigint), 5) as bigint) >> cast(15 - 5 * (k % 4) as bigint)) & 31 as bigint) + 1, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from x
"""

OP10 = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER.format(c="coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 2], ' ') as shingle from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as x, b.doc_id as y, count(*) as cut from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from o join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * cut >= 90 * (nx.n + ny.n - cut)),
e as (select x, y from l union select y, x from l),
r(a, b) as (select doc_id, doc_id from documents union select r.a, e.y from r join e on r.b = e.x),
c as (select a as doc_id, min(b) as component_id from r group by a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id from documents d left join n on d.doc_id = n.doc_id join c on d.doc_id = c.doc_id
"""

ORACLES = {"op1_decontamination": OP1, "op3_warc": OP3, "op5_line_dedup": OP5, "op6_chat_formatting": OP6, "op10_ngram_jaccard": OP10}
