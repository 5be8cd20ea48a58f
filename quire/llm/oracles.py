"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

import re

from quire.llm.mixing import NO_SOURCE
from quire.llm.secretscan import BASE_KINDS, RULES, Rule

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LIMITS = ((5, 25), (7, 22), (10, 20))


def _covered(n: int) -> str:
    return f"""s{n} as (select doc_id, i, word, i <= total - {n - 1} as whole, string_agg(word, ' ') over (partition by doc_id order by i rows between current row and {n - 1} following) as g from tok),
g{n} as (select doc_id, i, word, case when whole then count(*) over (partition by doc_id, g, whole) else 0 end as c from s{n}),
h{n} as (select doc_id, word, max(c) over (partition by doc_id order by i rows between {n - 1} preceding and current row) as c from g{n}),
c{n} as (select doc_id, count(*) as n, sum(length(word)) as chars from h{n} where c > 1 group by doc_id)"""


REPETITION = rf"""with w as (select doc_id, text, {WORDS} as ws from documents),
tok as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word, len(ws) as total from w),
{', '.join(_covered(n) for n, _ in LIMITS)},
lines as (select doc_id, unnest(string_split(text, chr(10))) as line from w),
dups as (select doc_id, sum(c - 1) as n, sum((c - 1) * chars) as chars from (
  select doc_id, line, count(*) as c, any_value(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) as chars from lines group by doc_id, line) where chars > 0 group by doc_id),
m as (select w.doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
  length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) as n_symbols, cast(coalesce(d.n, 0) as bigint) as n_dup_lines,
  coalesce(c5.n, 0) as n_repeat_words, cast(coalesce(d.chars, 0) as bigint) as dup_line_chars,
  {', '.join(f'cast(coalesce(c{n}.chars, 0) as bigint) as dup_{n}gram_chars' for n, _ in LIMITS)}
  from w left join dups d using (doc_id) {' '.join(f'left join c{n} using (doc_id)' for n, _ in LIMITS)}),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select *, not (base_failed or 100 * dup_line_chars > 25 * word_chars or 100 * n_symbols > 30 * n_words
  or {' or '.join(f'100 * dup_{n}gram_chars > {p} * word_chars' for n, p in LIMITS)}) as kept from f"""

TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{9f}\x{a1}-\x{1fff}\x{2080}-\x{10ffff}]+')"

OVERLAPS = f"""with d as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as tok from (select doc_id, {TOKENS} as ws from documents)),
b as (select item_id, n, unnest(range(1, n + 1)) as j, unnest(ws) as tok from (select item_id, ws, len(ws) as n from (select item_id, {TOKENS} as ws from benchmark)) where n >= 8),
eq as (select doc_id, item_id, n, i - j as diagonal, i from d join b on d.tok = b.tok),
c as (select doc_id, item_id, n, count(*) over (partition by doc_id, item_id, diagonal order by i range between current row and 12 following) as matched from eq)
select doc_id, item_id, cast(max(matched) as int) as matched from c where matched >= case when n >= 13 then 10 else n - 3 * n // 13 end group by doc_id, item_id"""

UNIFORM = "((('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, 'null') || ':1'), 1, 13))::bigint)::double + 0.5e0) / 4503599627370496.0e0"

MIXING = f"""with recursive sizes as (select coalesce(source, '{NO_SOURCE.encode('unicode_escape').decode()}') as s, sum(length(coalesce(text, ''))) as size from documents group by 1),
rates as (select s, 1.0e0 * (select sum(size) from sizes) / ((select sum(1.0e0) from sizes) * size) as rate from sizes where size > 0),
cdf as (select s, rate, 0 as k, exp(-rate) as p, exp(-rate) as c from rates
  union all select s, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from cdf where k < rate + 12 * sqrt(rate) + 30),
drawn as (select doc_id, source, case when not exists (select 1 from rates where rates.s = coalesce(d.source, '{NO_SOURCE.encode('unicode_escape').decode()}')) then 1 else (select count(*) from cdf where cdf.s = coalesce(d.source, '{NO_SOURCE.encode('unicode_escape').decode()}') and cdf.c < {UNIFORM}) end as n from documents d)
select doc_id, source, cast(copy as int) as copy, md5('mix:' || coalesce(doc_id::varchar, 'null') || ':' || copy) as mix_key from (select doc_id, source, unnest(range(0, n)) as copy from drawn)"""

JACCARD = rf"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
sh as (select distinct doc_id, array_to_string(ws[i:i + 2], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, least(len(ws), 1) + 1))) as i from w)),
n as (select doc_id, count(*) as n from sh group by doc_id),
pairs as (select a.doc_id as u, b.doc_id as v, count(*) as c from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select u, v from pairs join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 90 * (x.n + y.n - c)),
both_ways as (select u, v from links union all select v, u from links),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.v from reach r join both_ways l on l.u = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id from documents d left join n using (doc_id) join (select a, min(b) as c from reach group by a) m on m.a = d.doc_id"""


def _secrets(k: int, rule: Rule) -> str:
    """Matches and what is between them, in turn; their lengths give the positions."""
    head = rule.head.replace("(", "(?:").replace("'", "''")
    if rule.any_case:
        head = re.sub(r"(?<!\\)[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", head.replace("(?:", "(")).replace("(", "(?:")
    whole = head + (f"{rule.tail}+" if rule.tail else "")
    least = f"length(regexp_replace(m, '^{head}', '')) >= {rule.least}" if rule.tail else "true"
    return f"""select r, {k} as k, '{rule.kind}' as kind, m, sum(length(gap) + length(m)) over (partition by r order by i) as stop, {least} as good
  from (select r, unnest(ms) as m, unnest(gaps[1:len(ms)]) as gap, unnest(range(len(ms))) as i from (
    select r, regexp_extract_all(t, '{whole}') as ms, regexp_split_to_array(t, '{whole}') as gaps from d))"""


_UNION = " union all ".join(_secrets(k, r) for k, r in enumerate(RULES))
_BASE = f"kind in ({', '.join(f"'{k}'" for k in BASE_KINDS)})"
SECRETS = f"""with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
found as (select r, k, kind, cast(stop - length(m) as bigint) as start, kind || ':' || cast(stop - length(m) as bigint) || ':' || cast(stop as bigint) as shown from ({_UNION}) where good),
told as (select r, {', '.join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in BASE_KINDS)}, count(*) filter (where not {_BASE}) as n_added,
  coalesce(string_agg(shown, ',' order by start, k) filter (where {_BASE}), '') as base, string_agg(shown, ',' order by start, k) as spans from found group by r)
select doc_id, {', '.join(f'coalesce(n_{k}, 0) as n_{k}' for k in BASE_KINDS)}, coalesce(n_added, 0) as n_added, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join told using (r)"""


def _nearest(k: int) -> str:
    return f"""n{k} as (select r, p.part, min(64 * list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) + e) as found from p join c{k} c on c.part = p.part group by r, p.part)"""


def _moved(k: int) -> str:
    return f"""s{k} as (select part, e, i, sum(value) as total, count(*) as n from (select n.part, n.found % 64 as e, unnest(range(1, len(x) + 1)) as i, unnest(x) as value from n{k} n join p on p.r = n.r and p.part = n.part) group by all),
c{k + 1} as (select c.part, c.e, coalesce(m.c, c.c) as c from c{k} c left join (select part, e, list(cast((total - ((total % n) + n) % n) // n as bigint) order by i) as c from s{k} group by part, e) m on m.part = c.part and m.e = c.e)"""


CODES = f"""with v as (select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select r, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] as x from v, (select unnest(range(16)) as part)),
c0 as (select part, r - 1 as e, x as c from p where r <= 64),
{', '.join(f'{_nearest(k)}, {_moved(k)}' for k in range(2))}, {_nearest(2)},
codes as (select v.r, vec_id, label, string_agg(lpad(to_hex(found % 64), 2, '0'), '' order by part) as code, cast(sum(found // 64) as bigint) as error from v join n2 using (r) group by all),
books as (select sha256(string_agg(value::varchar, ',' order by part, e, i)) as h from (select part, e, unnest(range(len(c))) as i, unnest(c) as value from c2))
select vec_id, lower(code) as code, error, cast(sum(error) over (partition by label) as bigint) as label_error, h as codebooks_sha256 from codes, books"""

NEGATIVES = """with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * x::double) as bigint)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_sum(list_transform(range(1, len(b.v) + 1), lambda i: a.v[i] * b.v[i])) as bigint) as score
  from v a join v b on b.vec_id <> a.vec_id where a.vec_id % 100 = 0),
pos as (select anchor_id, id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) as int) as rank, s.id as negative_id, positive_score, s.score as negative_score
from pos p join s on s.anchor_id = p.anchor_id and not same and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.id) <= 5"""
