"""Searches of all users at once as queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.index import WIDTH, postings, search_all, words_of
from quire.operators.search import B, K1, LEAST_IDF, WEIGHTS, library_index
from quire.operators.stems import BETWEEN, TOKEN, stem_sql
from quire.plans.views import Views, with_views
from quire.sources.scratch import written

KINDS = 5


def typed_searches(v: Views) -> DataFrame:
    """What users type who look for a page they saved: the beginning of a word, a phrase, two words without another, a tag and a word, filters alone."""
    w = lambda k: F.get("ws", F.lit(k))
    rows = v.links.select("link_id", "user_id", "site_name", words_of(F.col("title")).alias("ws")).where("size(ws) >= 4")
    texts = F.array(
        F.substr(w(0), F.lit(1), F.lit(3)),
        F.concat(F.lit('"'), w(1), F.lit(" "), w(2), F.lit('"')),
        F.concat_ws(" ", w(0), w(2), F.concat(F.lit("-"), w(3))),
        F.concat_ws(" ", F.lit("tag:t3"), w(0)),
        F.concat(F.lit("is:queued site:"), F.col("site_name")),
    )
    return rows.select("user_id", "link_id", F.posexplode(texts).alias("k", "text")).select((F.col("link_id") * KINDS + F.col("k")).alias("search_id"), "user_id", "text")


def found(v: Views) -> DataFrame:
    documents = written(library_index(v), "documents")
    index = written(postings(documents, list(WEIGHTS)), "postings")
    return search_all(typed_searches(v), documents, index)


def search_words(v: Views) -> DataFrame:
    return found(v).drop("snippet")


def search_snippets(v: Views) -> DataFrame:
    return found(v).where("score is not null").select("search_id", "id", "snippet")


QUERIES = {"search_words": search_words, "search_snippets": search_snippets}

LEAST = min(WEIGHTS.values())
FOUND = f""", docs as (select l.link_id as id, l.user_id, l.title, l.description, l.note, coalesce(t.tags, '') as tags, l.site_name as site, l.author, l.canonical_url as url,
  case when l.is_reference and a.status = 'ready' then regexp_replace(p.html, '<style.*?</style>|<script.*?</script>|<[^>]*>', ' ', 'gs') end as body, l.saved_at, l.status, coalesce(t.names, []) as names
  from links l left join (select link_id, array_to_string(list_sort(list(tag)), ' ') as tags, list(tag) as names from link_tags group by link_id) t using (link_id) left join archives a using (link_id) join pages p on p.page_id = l.link_id),
texts as ({' union all '.join(f"select id, {k} as col, coalesce({c}, '') as text, {WEIGHTS[c] / LEAST}e0 as weight from docs" for k, c in enumerate(WEIGHTS))}),
cut as (select id, col, weight, regexp_extract_all(text, '{TOKEN}') as ws from texts),
tok as (select id, col, weight, strip_accents(lower(unnest(ws))) as w, unnest(range(len(ws))) as pos from cut),
typed as (select link_id, user_id, site_name, regexp_extract_all(title, '{TOKEN}') as ws from links where len(regexp_extract_all(title, '{TOKEN}')) >= 4),
searches as (select link_id * {KINDS} + k as sid, user_id, k, site_name from typed, range({KINDS}) r(k)),
asked as (select link_id * {KINDS} + k as sid, user_id, part, excluded, prefix, x.ws from typed, lateral (values
  (0, 0, false, true, [substr(typed.ws[1], 1, 3)]), (1, 0, false, false, [typed.ws[2], typed.ws[3]]), (2, 0, false, true, [typed.ws[1]]), (2, 1, false, true, [typed.ws[3]]), (2, 2, true, false, [typed.ws[4]]), (3, 0, false, true, [typed.ws[1]])) x(k, part, excluded, prefix, ws)),
words as (select sid, user_id, part, excluded, prefix, len(ws) as size, strip_accents(lower(unnest(ws))) as w, unnest(range(len(ws))) as j from asked),
st as ({stem_sql("select distinct w from (select w from tok union all select w from words)")}),
post as (select id, col, weight, pos, s from tok join st using (w)),
terms as (select sid, user_id, part, excluded, prefix and j = size - 1 as begun, size, j, s from words join st using (w)),
met as (select t.sid, t.part, t.excluded, t.size, p.id, p.col, p.weight, p.pos - t.j as start, t.j from terms t join post p on case when t.begun then starts_with(p.s, t.s) else p.s = t.s end),
occ as (select sid, part, excluded, size, id, col, weight, start from met group by all having count(distinct j) = size),
tf as (select sid, part, excluded, id, sum(weight) as tf from occ group by all),
df as (select sid, part, count(*) as df from tf group by all),
lens as (select id, sum(len(ws)) as dl from cut group by id),
stats as (select count(*) as n, avg(dl) as mean from lens),
own as (select tf.* from tf join searches s using (sid) join docs d on d.id = tf.id and d.user_id = s.user_id),
scored as (select sid, id, count(*) as n, sum(greatest({LEAST_IDF}, ln((n - df + 0.5e0) / (df + 0.5e0))) * tf * {K1 + 1} / (tf + {K1}e0 * ({1 - B}e0 + {B}e0 * dl / mean))) as score from own join df using (sid, part) join lens using (id), stats where not excluded group by all),
needed as (select sid, count(distinct part) as n from asked where not excluded group by sid),
passed as (select s.sid, s.k, d.id, d.saved_at from searches s join docs d using (user_id) where (s.k <> 3 or list_contains(d.names, 't3'))
  and (s.k <> 4 or (d.status = 'queued' and (d.url ilike 'https://' || s.site_name || '/%' or d.url ilike 'https://' || s.site_name || ':%' or d.url ilike 'https://%.' || s.site_name || '/%' or lower(d.site) = s.site_name)))),
ranked as (select p.sid, p.id, p.saved_at, round(c.score, 6) as score from passed p join scored c using (sid, id) join needed q on q.sid = p.sid and q.n = c.n
  where not exists (select 1 from own o where o.sid = p.sid and o.id = p.id and o.excluded)),
placed as (select sid, id, score, row_number() over (partition by sid order by score desc, id desc) as place from ranked
  union all select sid, id, null, row_number() over (partition by sid order by saved_at desc, id desc) from passed where k = 4)
"""
SNIPPETS = f""", shown as (select o.* from occ o join placed p using (sid, id) where p.place <= 50 and not o.excluded),
tried as (select *, 1000 * count(distinct part) over near + count(*) over near - count(distinct part) over near as worth, max(start + size) over near as last from shown
  window near as (partition by sid, id, col order by start range between current row and {WIDTH - 1} following)),
best as (select sid, id, col, start - cast(floor(({WIDTH} - (last - start)) / 2) as bigint) as first from tried qualify row_number() over (partition by sid, id order by worth desc, col, start) = 1),
inside as (select sid, id, size, start, unnest(range(start, start + size)) as spot from shown join best using (sid, id, col)),
marks as (select sid, id, spot, max(spot < start + size - 1) as joined from inside group by all),
pieces as (select b.sid, b.id, first, regexp_extract_all(text, '{TOKEN}|{BETWEEN}') as ps from best b join texts t on t.id = b.id and t.col = b.col),
spread as (select sid, id, first, unnest(ps) as piece, unnest(range(len(ps))) as k, cast(regexp_matches(ps[1], '^{BETWEEN}') as int) as lead, len(ps) as n from pieces),
counted as (select *, (n - lead + 1) // 2 as words, greatest(0, least(first, (n - lead + 1) // 2 - {WIDTH})) as a from spread),
kept as (select *, case when (k - lead) % 2 = 0 and k >= lead then (k - lead) // 2 end as spot, least(words, a + {WIDTH}) as b from counted
  where (a = 0 or k >= 2 * a + lead) and (least(words, a + {WIDTH}) = words or k < 2 * least(words, a + {WIDTH}) - 1 + lead)),
marked as (select q.*, case when m.spot is not null and not coalesce(before.joined, false) then chr(1) else '' end || piece || case when m.spot is not null and not m.joined then chr(2) else '' end as line
  from kept q left join marks m on m.sid = q.sid and m.id = q.id and m.spot = q.spot left join marks before on before.sid = q.sid and before.id = q.id and before.spot = q.spot - 1)
select sid as search_id, id, case when a > 0 then '…' else '' end || string_agg(line, '' order by k) || case when b < words then '…' else '' end as snippet from marked group by sid, id, a, b, words"""

ORACLES = {
    "search_words": with_views(FOUND + "select sid as search_id, place, id, score from placed where place <= 50", "links", "link_tags", "archives"),
    "search_snippets": with_views(FOUND + SNIPPETS, "links", "link_tags", "archives"),
}
