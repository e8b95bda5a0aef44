"""DuckDB SQL of the operators' queries, where SQL can state them."""

ORACLE = {
    "op1_secrets": r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
rules(kind, nr, re) as (values
  ('assign', 0, '(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  ('access', 1, 'AKIA[A-Z0-9]+'), ('hex', 2, '[0-9a-f]{16,}'),
  ('pem', 3, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'),
  ('jwt', 4, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}'),
  ('repo_token', 5, 'gh[pousr]_[A-Za-z0-9]{36,}')),
one as (
  select doc_id, 'assign' as kind, 0 as nr, regexp_extract_all(t, (select re from rules where nr = 0)) as m,
    string_split_regex(t, '(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+') as g
  from d
  union all select doc_id, 'access', 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') from d
  union all select doc_id, 'hex', 2, regexp_extract_all(t, '[0-9a-f]{16,}'), string_split_regex(t, '[0-9a-f]{16,}') from d
  union all select doc_id, 'pem', 3, regexp_extract_all(t, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----'),
    string_split_regex(t, '-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----') from d
  union all select doc_id, 'jwt', 4,
    regexp_extract_all(t, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}'),
    string_split_regex(t, 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}') from d
  union all select doc_id, 'repo_token', 5, regexp_extract_all(t, 'gh[pousr]_[A-Za-z0-9]{36,}'),
    string_split_regex(t, 'gh[pousr]_[A-Za-z0-9]{36,}') from d),
hit as (select doc_id, kind, nr, m, g, unnest(range(1, len(m) + 1)) as i from one where len(m) > 0),
span as (
  select doc_id, kind, nr, m[i] as s, length(m[i]) as n,
    list_sum(list_transform(g[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as start
  from hit),
good as materialized (
  select doc_id, nr, kind, start, start + n as stop from span
  where case kind when 'assign' then length(regexp_extract(s, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 12
    when 'access' then n >= 18 else true end),
agg as (
  select doc_id, count(*) filter (where nr = 0) as n_assign, count(*) filter (where nr = 1) as n_access,
    count(*) filter (where nr = 2) as n_hex,
    string_agg(concat(kind, ':', start, ':', stop), ',' order by start, nr) filter (where nr < 3) as base,
    string_agg(concat(kind, ':', start, ':', stop), ',' order by start, nr) as spans
  from good group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join agg using (doc_id)
""",
    "op5_decontamination": r"""
with dw as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as words from documents),
bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as words from benchmark),
bp as (select item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as p from bw where len(words) > 0),
tests as materialized (
  select distinct cast(item_id as varchar) as item, least(10, len(words)) as m,
    array_to_string(words[p:p + 9], ' ') as w from bp),
sizes as (select distinct m from tests),
dp as (select doc_id, words, m, unnest(range(1, len(words) - m + 2)) as p from dw, sizes where len(words) >= m),
found as materialized (
  select d.doc_id, d.m, d.p, t.item
  from (select doc_id, m, p, array_to_string(words[p:p + m - 1], ' ') as w from dp) d
  join tests t on t.m = d.m and t.w = d.w),
marked as (select doc_id, unnest(range(p, p + m)) as q from (select distinct doc_id, m, p from found)),
hits as (select doc_id, count(distinct q) as n from marked group by doc_id),
items as (
  select doc_id, count(*) as n, string_agg(item, ',' order by item) as s
  from (select distinct doc_id, item from found) group by doc_id)
select d.doc_id, len(d.words)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(i.n, 0)::bigint as n_items,
  sha256(coalesce(i.s, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
from dw d left join hits h using (doc_id) left join items i using (doc_id)
""",
    "op7_line_dedup": r"""
with ls as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as pos from ls),
k as materialized (
  select doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
shared as (
  select key, min(doc_id) as owner from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
judged as (
  select k.doc_id, k.line, k.pos, s.owner is not null and s.owner <> k.doc_id as gone
  from k left join shared s on s.key = k.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
""",
    "op11_warc": r"""
with p as (select page_id, coalesce(html, '') as t from pages),
h as (select page_id, t, strlen(t) as size, sha1(t) as hex from p),
d as (
  select page_id, t, size, array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((cast('0x' || substr(hex, cast(i // 4 * 5 + 1 as integer), 5) as bigint) >> cast(15 - i % 4 * 5 as integer)) & 31) + 1, 1)), '') as digest
  from h),
f as (select t, min(page_id) as owner from d group by t)
select page_id, size::bigint as payload_bytes, digest as payload_digest,
  case when page_id = owner then 'response' else 'revisit' end as record_type,
  case when page_id = owner then null else owner end as refers_to
from d join f using (t)
""",
    "op12_collocations": r"""
with d as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as materialized (
  select lang, ws from (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p) where len(ws) > 0),
total as (select lang, sum(len(ws))::bigint as n from w group by lang),
g as materialized (
  select lang, k, phrase, count(*) as a from (
    select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase from (
      select lang, k, ws, unnest(range(1, len(ws) - k + 2)) as i from w, (select unnest(range(1, 6)) as k) where len(ws) >= k))
  group by lang, k, phrase having count(*) >= 100),
c as materialized (select lang, k, phrase, a, string_split(phrase, ' ') as ws from g where k > 1),
cut as (select lang, k, phrase, a, ws, unnest(range(1, k)) as j from c),
scored as (
  select cut.lang, cut.phrase, cut.a, x.a as l, y.a as r, total.n, j,
    (1000::hugeint * cut.a * total.n) // (x.a::hugeint * y.a) as score
  from cut join total using (lang)
  join g x on x.lang = cut.lang and x.phrase = array_to_string(cut.ws[1:j], ' ')
  join g y on y.lang = cut.lang and y.phrase = array_to_string(cut.ws[j + 1:cut.k], ' ')),
best as (select *, row_number() over (partition by lang, phrase order by score, j) as nr from scored),
inner_ as (
  select lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, max(a) as a from (
    select lang, ws, a, m, unnest(range(1, k - m + 2)) as i from (
      select lang, ws, a, k, unnest(range(2, k)) as m from c))
  group by 1, 2),
ranks as (
  select b.lang, row_number() over (partition by b.lang order by b.score desc, b.a desc, b.phrase) as rank,
    b.phrase, b.a, b.l, b.r, b.n, b.score::bigint as score
  from best b left join inner_ i on i.lang = b.lang and i.phrase = b.phrase
  where b.nr = 1 and not coalesce(100 * i.a >= 100 * b.a, false))
select lang, rank, phrase, a, l, r, n, score from ranks where rank <= 2000
""",
    "op13_spelling": r"""
with tab as (
  select list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, x::bigint)) as crc),
o as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run from documents),
r as (select doc_id, run, count(*) as n from o where length(run) >= 6 group by doc_id, run),
s as (
  select run, n, list_reduce(
      flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x:
        case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end)),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::bigint) as c
  from r, tab),
m as (
  select case when h % 199 = 0 then concat(left(run, h % length(run)), substr(run, h % length(run) + 2)) else run end as word, n
  from (select run, n, xor(c, 4294967295) as h from s)),
v as materialized (
  select word, sum(n)::bigint as n, translate(word, '%(letters)s', '%(signs)s') as code
  from m where length(word) >= 6 group by word having sum(n) >= 5),
near as materialized (
  select a.word, a.n, b.word as other, b.n as other_n from v a join v b
  on a.word <> b.word and abs(length(a.word) - length(b.word)) <= 1 and levenshtein(a.code, b.code) = 1),
best as (
  select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by word),
j as materialized (
  select v.word, v.n, coalesce(n_near, 0)::bigint as n_near, case when other_n >= 5 * v.n then other end as form,
    case when other_n >= 5 * v.n then other_n end as form_n
  from v left join best using (word)),
walk as (
  with recursive steps as (
    select word, word as spot, 0 as k from j union all
    select steps.word, j.form, k + 1 from steps join j on j.word = steps.spot where j.form is not null)
  select word, arg_max(spot, k) as root from steps group by word)
select word, form, root, n, n_near, form_n from j join walk using (word)
""",
}
# Letters above ASCII as signs that no word holds: DuckDB's levenshtein counts bytes.
ORACLE["op13_spelling"] = ORACLE["op13_spelling"].replace("%(letters)s", "".join(map(chr, range(0xC0, 0x100)))).replace(
    "%(signs)s", "".join(c for c in map(chr, range(33, 127)) if not "a" <= c <= "z" and c != "'")[:64])
