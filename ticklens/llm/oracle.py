"""The SQL (DuckDB) that registered queries are checked against, over whole tables."""

from __future__ import annotations

from ticklens.llm import licenses, secrets

_OP9 = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from documents),
iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from benchmark),
item_windows as (
  select distinct item_id, least(10, len(w)) n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) i from iw)),
lengths as (select distinct n from item_windows),
doc_windows as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from dw, lengths where len(w) >= n)),
hits as (select doc_id, item_id, i, n from doc_windows join item_windows using (n, s)),
words as (select doc_id, count(distinct p) n_hit
  from (select doc_id, unnest(range(i, i + n)) p from hits) group by 1),
found as (select doc_id, count(*) n_items, string_agg(id, ',' order by id) ids
  from (select distinct doc_id, item_id::varchar id from hits) group by 1)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit,
  coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 contaminated
from dw left join words using (doc_id) left join found using (doc_id)
"""

_OP4 = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w
  from documents),
shingles as materialized (
  select distinct doc_id, case when len(w) < 5 then w else w[i:i + 4] end s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) i from words)),
sizes as materialized (select doc_id, count(*) n from shingles group by 1),
links as materialized (
  select a, b from (
    select x.doc_id a, y.doc_id b, count(*) c from shingles x join shingles y using (s)
    where x.doc_id <> y.doc_id group by 1, 2)
  join sizes p on p.doc_id = a join sizes q on q.doc_id = b
  where 100 * c >= 75 * (p.n + q.n - c)),
reach as (
  select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b)
select doc_id, coalesce(n, 0)::bigint n_shingles, least(doc_id, coalesce(m, doc_id)) component_id,
  least(doc_id, coalesce(m, doc_id)) = doc_id kept
from documents left join sizes using (doc_id)
  left join (select a doc_id, min(b) m from reach group by 1) using (doc_id)
"""

_OP12 = r"""
with recursive steps(k, b, x) as (
  select 0, b, b::bigint from range(256) t(b)
  union all
  select k + 1, b, case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end
  from steps where k < 8),
crc as (select list(x order by b) t from steps where k = 8),
texts as (
  select 'd' side, doc_id id, text from documents union all select 'b', null, text from benchmark),
words as materialized (
  select side, id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w
  from texts),
grams as materialized (
  select side, id, array_to_string(w[i:i + k - 1], ' ') f
  from (select side, id, w, k, unnest(range(1, len(w) - k + 2)) i from words, range(1, 4) n(k))),
bytes as (
  select f, list_transform(range(1, 2 * strlen(f), 2), lambda i: ('0x' || substr(h, i, 2))::bigint) b
  from (select f, hex(encode(f)) h from (select distinct f from grams))),
hashed as materialized (
  select f, xor(list_reduce(list_prepend(4294967295::bigint, b),
    lambda x, y: xor(x >> 8, t[(xor(x, y) & 255) + 1])), 4294967295::bigint) % 10000 bucket
  from bytes, crc),
counts as materialized (
  select bucket, count(*) filter (where side = 'b') t, count(*) filter (where side = 'd') s
  from grams join hashed using (f) group by 1),
gains as (
  select b bucket, floor(1000.0::double * ln(
    ((coalesce(t, 0) + 1.0::double) * (all_s + 10000.0::double))
    / ((coalesce(s, 0) + 1.0::double) * (all_t + 10000.0::double))))::bigint gain
  from range(10000) r(b) left join counts on b = bucket,
    (select sum(t)::double all_t, sum(s)::double all_s from counts)),
weights as (
  select id, count(*) n_features, sum(gain)::bigint weight
  from grams join hashed using (f) join gains using (bucket) where side = 'd' group by 1),
scored as (
  select id doc_id, len(w) >= 20 enough, coalesce(n_features, 0) n_features, coalesce(weight, 0)::bigint weight,
    coalesce(weight, 0)::bigint + floor(-1000.0::double * ln(-ln(
      (('0x' || substr(sha256('42:' || id), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint score
  from words left join weights using (id) where side = 'd'),
placed as (
  select *, row_number() over (partition by enough order by score desc, doc_id) place,
    count(*) filter (where enough) over () n from scored)
select doc_id, n_features, weight, score, case when enough and place <= 5 * n // 100 then place end rank
from placed
"""

# The pages of the test data mark their article; character references in it are these.
_OP13 = r"""
with articles as (
  select page_id, url, string_split_regex(
    coalesce(regexp_extract(html, '(?s)<article>(.*)</article>', 1), ''), '</?(p|h1)>') parts
  from pages),
parts as (select page_id, unnest(parts) part, unnest(range(len(parts))) i from articles),
lines as (
  select page_id, i, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(
    regexp_replace(part, '<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;?', '&', 'g'),
    '\s+', ' ', 'g')) line
  from parts),
found as (
  select page_id, string_agg(line, chr(10) order by i) as text from lines where line <> '' group by 1)
select page_id, url, coalesce(found.text, '') as text, length(coalesce(found.text, ''))::bigint n_chars
from articles left join found using (page_id)
"""


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_OP3 = f"""
with templates(license_id, size, t) as (values {
    ", ".join(
        f"('{name}', {len(licenses.template_words(text))}, {_sql_list(licenses.template_bigrams(text))})"
        for name, text in licenses.TEMPLATES.items()
    )
}),
texts as (
  select row_number() over () r, doc_id, list_transform(
    string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)),
    lambda l: list_filter(string_split(l, ' '), lambda x: x <> '')) l
  from documents),
flat as (
  select r, flatten(l) w, flatten(list_transform(l, lambda x, i: list_transform(x, lambda y: i))) line_of from texts),
units as (
  select r, 'line' unit, i line_no, i last_line, l[i] w from (select r, l, unnest(range(1, len(l) + 1)) i from texts)
  union all select r, 'text', 0, 0, w from flat join texts using (r) where len(l) > 1),
pairs as (
  select r, unit, line_no, last_line,
    list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) b
  from units where len(w) >= 2),
whole as (
  select r, unit, line_no, last_line, license_id, len(b) n, len(list_intersect(b, t)) c, len(t) m from pairs, templates),
placed as (
  select r, line_of, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) p from flat where len(w) >= 2),
windows as (
  select r, license_id, line_of, s, width, t, list_distinct(p[s + 1:s + width]) b
  from (
    select *, unnest(range(0, len(p) - width + 1)) s
    from (select *, least(size - 1, len(p)) width from placed, templates where list_has_any(p, t)))),
matching as (
  select r, license_id, line_of[s + 1] line_no, line_of[s + width + 1] last_line, s, len(b) n,
    len(list_intersect(b, t)) c, len(t) m
  from windows where 2.0::double * len(list_intersect(b, t)) / (len(b) + len(t)) >= 0.75),
rows_of as (select *, s - row_number() over (partition by r, license_id order by s) run from matching),
best as (
  select *, row_number() over (partition by r, license_id, run order by c::double / (n + m) desc, s) place from rows_of)
select doc_id, unit, line_no::integer line_no, last_line::integer last_line, license_id, n::integer n_bigrams,
  c::integer n_shared, 2.0::double * c / (n + m) dice
from (
  select r, unit, line_no, last_line, license_id, n, c, m from whole where 2.0::double * c / (n + m) >= 0.75
  union all select r, 'window', line_no, last_line, license_id, n, c, m from best where place = 1)
join texts using (r)
"""


def _marked(rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"string_split(regexp_replace(text, '({pattern})', chr(1) || '\\1' || chr(1), 'g'), chr(1))"


def _spans(place: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  select r, {place} place, '{rule.kind}' kind, list_sum(list_transform(p[1:i - 1], lambda x: length(x)))::bigint s,
    length(p[i]) n
  from (select r, p, unnest(range(2, len(p) + 1, 2)) i from (select r, {_marked(rule)} p from d))
  where length(regexp_extract(p[i], '{pattern}', {rule.group})) >= {rule.least}"""


_OP5 = f"""
with d as (select row_number() over () r, doc_id, coalesce(text, '') as text from documents),
found as ({" union all ".join(_spans(i, rule) for i, rule in enumerate(secrets.RULES))}),
listed as (
  select r, {", ".join(
    f"count(*) filter (where kind = '{rule.kind}') n_{rule.kind}" for rule in secrets.RULES
  )},
    string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, place) spans,
    string_agg(kind || ':' || s || ':' || (s + n), ',' order by s, place) filter (where place < 3) base
  from found group by 1)
select doc_id, {", ".join(f"coalesce(n_{rule.kind}, 0) n_{rule.kind}" for rule in secrets.RULES)},
  sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join listed using (r)
"""

SQL: dict[str, str] = {
    "op3_license_scan": _OP3,
    "op4_near_duplicates": _OP4,
    "op5_secret_scan": _OP5,
    "op9_decontamination": _OP9,
    "op12_importance_resampling": _OP12,
    "op13_html_main_text": _OP13,
}
