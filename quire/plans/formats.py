"""Queries over feed formats, page heads, addresses, quotations and the library, and the same queries as DuckDB SQL.

Where the tables hold no such input, it is written here around their texts and numbers; the operators take any DataFrame.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import pages
from quire.functions.display import DIGITS, TONES
from quire.functions.markup import locate
from quire.functions.texts import ENTITIES, decode_named
from quire.functions.urls import web_url
from quire.operators import requests
from quire.operators.articles import read_articles
from quire.operators.jobs import stub_probabilities
from quire.operators.reading import link_words
from quire.operators.sanitize import sanitized
from quire.operators.search import filtered, parse_search
from quire.plans.views import Views, with_views
from quire.sources import feeds
from quire.sources.export import CSV_COLUMNS, escaped

BASE = "https://example.com/feed"


def glued(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def atom_body() -> Column:
    """A post as an Atom document: one entry with its text, one that has only a summary and a second address."""
    i = F.col("doc_id").cast("string")
    return glued(
        '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><link href="https://example.com/"/><entry><id>urn:', i, "</id><title>Post ", i,
        '</title><link rel="self" href="/self"/><link href="/p/', i, '"/><content type="html">', escaped(F.coalesce("text", F.lit(""))),
        "</content><updated>2024-01-01T0", (F.col("doc_id") % 10).cast("string"), ":30:00Z</updated><author><name>A. Writer</name></author></entry><entry><id>urn:", i,
        ':b</id><title>Second</title><link rel="alternate" href="https://other.example.org/', i, '"/><summary>short</summary><published>2024-01-02T00:00:00Z</published></entry></feed>',
    )


def json_body() -> Column:
    """A post as a JSON Feed: one item with its text, one in plain text that has an outside address only."""
    i = F.col("doc_id").cast("string")
    author = F.array(F.struct(F.lit("A. Writer").alias("name")))
    one = F.struct(i.alias("id"), glued("/p/", i).alias("url"), glued("Post ", i).alias("title"), F.coalesce("text", F.lit("")).alias("content_html"), F.lit("2024-01-01T08:30:00Z").alias("date_published"), author.alias("authors"))
    two = F.struct(glued(i, "-b").alias("id"), glued("https://other.example.org/", i).alias("external_url"), F.lit("one & two\n\nthree").alias("content_text"))
    return glued('{"version": "https://jsonfeed.org/version/1.1", "title": "t", "home_page_url": "https://example.com/", "items": [', F.to_json(one), ", ", F.to_json(two), "]}")


def documents_as(v: Views, body: Column) -> DataFrame:
    return v.raw("documents").select(F.col("doc_id").alias("feed_id"), F.lit(BASE).alias("feed_url"), body.alias("body"))


def atom_entries(v: Views) -> DataFrame:
    found = feeds.entries(documents_as(v, atom_body()))
    return found.select("feed_id", "guid", "url", "title", "author", "summary", "published_at")


def json_entries(v: Views) -> DataFrame:
    found = feeds.entries(documents_as(v, json_body()))
    return found.select("feed_id", "guid", "url", "title", "author", "summary", F.when(F.endswith("guid", F.lit("-b")), F.col("content")).alias("content"), "published_at")


def feed_kinds(v: Views) -> DataFrame:
    """What kind of document each body is, by its start: four formats and plain text in turn."""
    heads = F.array(F.lit('<?xml version="1.0"?>\n<rss version="2.0">'), F.lit("<feed xmlns='x'>"), F.lit("  {"), F.lit('<rdf:RDF xmlns="x">'), F.lit("<html>"))
    body = glued(F.element_at(heads, (F.col("doc_id") % 5 + 1).cast("int")), escaped(F.coalesce("text", F.lit(""))))
    rows = documents_as(v, body)
    return rows.select("feed_id", feeds.looks_like(F.col("body")).alias("kind")).join(feeds.unreadable(rows), "feed_id", "left")


def fresh_entries(v: Views) -> DataFrame:
    """Posts that a poll adds: two found ones share each identity, and those of before January are known."""
    guid = (F.col("entry_id") / 2).cast("long").alias("guid")
    found = v.entries.select("feed_id", guid, F.col("entry_id").alias("place"))
    known = v.entries.where("created_at < timestamp_ntz'2024-01-01 00:00:00'").select("feed_id", guid)
    return feeds.fresh(found, known)


LINKED = (
    '<head><link rel="stylesheet" href="/x.css"><link rel="alternate" type="application/rss+xml; charset=utf-8" href="/comments/feed">'
    '<link rel="alternate" type="application/atom+xml" href="//feeds.example.org/a"><link rel="alternate" type="application/json" href="/api">'
    "<link rel='alternate home' type='application/rss+xml' href='/rss?a=1&amp;b=2'><link rel=\"alternate\" type=\"application/rss+xml\" href=\"/rss?a=1&amp;b=2\">"
    '<!-- <link rel="alternate" type="application/rss+xml" href="/gone"> -->'
)
NAMED = (
    '<head><meta property="og:description" content="A &amp;amp; B&#39;s &#x2014; text"><meta name="description" content="later"><meta content="/img/1.png" property="og:image">'
    '<meta name="application-name" content="A  Site"><meta name="author" content="A. Writer"><link rel="shortcut icon" href="i.png"><link rel="canonical" href="/c">'
)


def with_head(v: Views, head: str) -> DataFrame:
    return v.raw("pages").select("page_id", "url", F.replace("html", F.lit("<head>"), F.lit(head)).alias("html"))


def discovered_feeds(v: Views) -> DataFrame:
    """The feeds that pages name in their heads."""
    return pages.feed_links(with_head(v, LINKED)).select("page_id", "feed", "comments")


def page_previews(v: Views) -> DataFrame:
    """Preview metadata of pages that have it."""
    return pages.metadata(with_head(v, NAMED)).select("page_id", "description", "site_name", "author", "image_url", "canonical_url")


def varied_head(k: Column) -> Column:
    """Heads that differ from page to page: which names they have, in which order, quotes and case, and what stands in them."""
    some = lambda when, *parts: F.when(when, glued(*parts)).otherwise("")
    n = k.cast("string")
    long = F.when(k % 7 == 0, F.repeat(glued("w", n, " \n"), F.lit(300))).otherwise(glued(" D &lt;", n, "&gt; "))
    return glued(
        "<HEAD>", some(k % 3 == 0, "<meta name='twitter:title' content='TW ", n, "'>"), some(k % 2 == 0, '<META content="OG &quot;', n, '&quot;" property="og:title">'), some(k % 2 == 0, '<meta property="og:title" content="second">'),
        some(k % 5 == 2, '<meta name="description" content="', long, '">'), some(k % 5 == 1, '<meta name="Twitter:Description" content="', long, '"/>'), some(k % 5 == 0, '<meta property="og:description" content="', long, '" data-x="og:title">'),
        some(k % 4 == 1, "<meta property=og:site_name content=Site-", n, ">"), some(k % 4 == 2, '<meta name="application-name" content="App ', n, '">'), some(k % 4 == 3, '<meta name="application-name" content="">'),
        some(k % 3 == 1, '<meta name="author" content="', F.when(k % 2 == 0, "https://example.com/me").otherwise(glued("Writer ", n)), '">'), "<!-- <meta property='og:image' content='/no.png'> -->",
        some(k % 4 == 0, '<meta property="og:image" content="//cdn.example.com/', n, '.png">'), some(k % 4 == 1, '<meta name="twitter:image" content="https://img.example.com/', n, '?a=1&amp;b=2">'), some(k % 4 == 2, '<meta property="og:image" content="javascript:x">'),
        some(k % 3 == 0, '<link rel="alternate" type="application/rss+xml" href="/rss/', n, '">'), some(k % 3 == 1, "<link TYPE='application/atom+xml; charset=utf-8' href='https://feeds.example.com/", n, "' rel='Alternate'>"),
        some(k % 2 == 0, '<link rel="alternate" type="application/json" href="/feed/', n, '.json">'), some(k % 2 == 1, '<link rel="alternate" type="application/json" href="/api/', n, '">'), some(k % 5 == 0, '<link rel="canonical" href="/c/', n, '">'),
        some(k % 5 == 1, '<link rel="alternate" type="text/html" href="/feed/html">'),
    )


def with_varied_head(v: Views) -> DataFrame:
    return v.raw("pages").select("page_id", "url", F.call_function("replace", F.col("html"), F.lit("<head>"), varied_head(F.col("page_id"))).alias("html"))


def varied_previews(v: Views) -> DataFrame:
    return pages.metadata(with_varied_head(v)).select("page_id", "title", "description", "site_name", "author", "image_url", "canonical_url")


def varied_feeds(v: Views) -> DataFrame:
    return pages.feed_links(with_varied_head(v)).select("page_id", "feed", "comments")


def varied_references(v: Views) -> DataFrame:
    """Every word of a post's beginning written with references: a character as a decimal or hexadecimal number, ampersands by name."""
    k = F.col("doc_id")
    code = k % 0x2000 + 33
    mark = F.when(k % 2 == 0, glued("&#", code.cast("string"), ";")).otherwise(glued("&#x", F.lower(F.hex(code)), ";"))
    text = glued(mark, "&amp;", F.coalesce("lang", F.lit("")), "&amp;lt;&hellip;", mark, "&nosuch;&#", F.repeat(F.lit("9"), (k % 8 + 1).cast("int")))
    return v.raw("documents").select("doc_id", decode_named(text).alias("text"))


def character_references(v: Views) -> DataFrame:
    """Numeric and named references decoded once."""
    text = glued("&#39;", F.col("page_id").cast("string"), "&#x27;&#8212;&#X1F600;&amp;#39;&#38;lt;&lt;&#0;&#xD800;&#9999999;& &#; &#x;")
    return v.raw("pages").select("page_id", decode_named(text).alias("text"))


def web_urls(v: Views) -> DataFrame:
    """Addresses as people type them: whole, without a scheme, of another scheme, without a dot, with a blank, a local one."""
    bare = F.regexp_replace("url", "^https?://", "")
    typed = F.array(F.col("url"), glued("  ", bare, " "), glued("ftp://", bare), F.lit("nowhere"), glued(F.col("url"), "/a b"), F.lit("localhost:8080/x"))
    return v.raw("pages").select("page_id", web_url(F.element_at(typed, (F.col("page_id") % 6 + 1).cast("int"))).alias("web_url"))


def located_quotes(v: Views) -> DataFrame:
    """Where a quotation stands in its post: its fourth to sixth word, with ASCII letters in capitals and with other blanks; every third is not there."""
    some = F.slice(F.regexp_extract_all("text", F.lit("\\S+"), F.lit(0)), 4, 3)
    quote = glued(F.translate(F.array_join(some, "\n "), ascii_lowercase, ascii_uppercase), F.when(F.col("doc_id") % 3 == 0, F.lit("∅")).otherwise(F.lit("")))
    return v.raw("documents").select("doc_id", locate(F.col("text"), quote).cast("long").alias("place"))


def stub_picks(v: Views) -> DataFrame:
    """The choice that the stand-in of a model makes for each title, and its chance."""
    best = F.array_max(stub_probabilities(F.col("title"), ["a", "b", "c", "other"]))
    return v.links.select("link_id", best["slug"].alias("slug"), F.round(best["p"], 6).alias("p"))


def queue_search(v: Views) -> DataFrame:
    """A search without a word in it gives the queue."""
    return filtered(v, parse_search("is:queue")).select("user_id", "link_id", "saved_at")


def limit_clamps(v: Views) -> DataFrame:
    """Limits of requests, good and bad."""
    k = F.col("event_id")
    asked = F.get(F.array((k % 150).cast("string"), F.lit("-5"), F.lit(" 12.0 "), F.lit("7.5"), F.lit("5d"), F.lit("1e2"), F.lit("")), (k % 8).cast("int"))
    return v.raw("events").select("event_id", requests.clamped(asked, 20, 50).alias("n"))


def question_checks(v: Views) -> DataFrame:
    """Questions of a request a user, a question a link, with every fault among them."""
    k = F.col("link_id")
    name = lambda o: F.concat(F.when((k % 11 == 0) & (o == 2), F.lit("o ")).otherwise(F.lit("o")), o.cast("string"))
    options = F.transform(F.sequence(F.lit(1).cast("long"), k % 300 + 1), name)
    asked = v.links.select(
        F.col("user_id").alias("request_id"), k.alias("place"), F.concat(F.when(k % 9 == 0, F.lit("q ")).otherwise(F.lit("q-")), k.cast("string")).alias("question_id"),
        F.when(k % 3 == 0, F.lit("noul")).otherwise(F.lit("choice")).alias("kind"), F.when(k % 7 == 0, F.lit(" \t")).otherwise(F.col("title")).alias("instructions"), options.alias("options"),
    )
    return requests.question_problems(asked)


def fenced_replies(v: Views) -> DataFrame:
    """Replies of a model: bare, in a fence, in a named fence, and no JSON."""
    body = F.to_json(F.struct(F.round("value", 2).alias("p")))
    k = F.col("event_id") % 4
    reply = F.when(k == 0, body).when(k == 1, glued("```json\n", body, "\n```")).when(k == 2, glued("  ```\n", body, "```\n")).otherwise(glued("It is ", body))
    found = requests.unfenced(reply)
    return v.raw("events").select("event_id", found.isNotNull().alias("is_json"), F.round(F.try_variant_get(found, "$.p", "double"), 2).alias("p"))


def library_page(v: Views) -> DataFrame:
    """The library of every user, as its page first shows it."""
    return requests.library(v, "")


def library_tag(v: Views) -> DataFrame:
    return requests.library(v, "tag:t3 is:queued")


def palette_links(v: Views) -> DataFrame:
    return requests.palette(v, "is:archived")


def categorized_users(v: Views) -> DataFrame:
    return requests.categorized_users(v)


def scored_articles(v: Views) -> DataFrame:
    """The article of every page as it is."""
    return read_articles(v.raw("pages"), url_col="url")


def unmarked_articles(v: Views) -> DataFrame:
    """The article of every page when nothing but boxes names its parts."""
    marks = "(?i)(</?)(?:article|main|nav|footer|header|aside)\\b[^>]*>"
    return read_articles(v.raw("pages").select("page_id", "url", F.regexp_replace("html", marks, "$1div>").alias("html")), url_col="url")


def sanitized_pages(v: Views) -> DataFrame:
    """Every page as safe markup."""
    return sanitized(v.raw("pages"), "page_id", "html", "url")


QUERIES = {
    "sanitized_pages": sanitized_pages,
    "limit_clamps": limit_clamps,
    "question_checks": question_checks,
    "fenced_replies": fenced_replies,
    "library_page": library_page,
    "library_tag": library_tag,
    "palette_links": palette_links,
    "categorized_users": categorized_users,
    "scored_articles": scored_articles,
    "unmarked_articles": unmarked_articles,
    "atom_entries": atom_entries,
    "json_entries": json_entries,
    "feed_kinds": feed_kinds,
    "fresh_entries": fresh_entries,
    "discovered_feeds": discovered_feeds,
    "page_previews": page_previews,
    "character_references": character_references,
    "varied_previews": varied_previews,
    "varied_feeds": varied_feeds,
    "varied_references": varied_references,
    "web_urls": web_urls,
    "located_quotes": located_quotes,
    "stub_picks": stub_picks,
    "queue_search": queue_search,
    "link_words": link_words,
}

LIBRARY = "select user_id, link_id, place from (select user_id, link_id, row_number() over (partition by user_id order by {1} desc, link_id desc) as place from links where {0}) where place <= {2}"
SHORT = "case when plain = '' then null when length(plain) > 400 then regexp_replace(substr(plain, 1, 400), '\\s+\\S*$', '') || '…' else plain end"
ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
SITE = "regexp_replace(lower(regexp_extract(url, '^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '')"
PLAIN = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))"


def cell_sql(column: str) -> str:
    text = f"coalesce(cast({column} as varchar), '')"
    guarded = f"case when regexp_matches({text}, '^[=+\\-@\\t\\r]') then '''' || {text} else {text} end"
    return f"case when regexp_matches({guarded}, '[\",\\n\\r]') then '\"' || replace({guarded}, '\"', '\"\"') || '\"' else {guarded} end"


def block_text_sql(html: str) -> str:
    text = html
    for tag in ("script", "style"):
        text = f"regexp_replace({text}, '<{tag}\\b.*?</{tag}>', '', 'gis')"
    for pattern, new in (("<li\\b[^>]*>", "chr(10) || '• '"), ("<br\\s*/?>", "chr(10)"), ("</(?:p|div|h[1-6]|blockquote|pre|ul|ol|table|section|figure)>", "chr(10) || chr(10)")):
        text = f"regexp_replace({text}, '{pattern}', {new}, 'gi')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for name, char in ENTITIES.items():
        text = f"""replace({text}, '&{name};', '{char.replace("'", "''")}')"""
    for pattern, new in (("[ \\t]+", "' '"), (" ?\\n ?", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)"), ("^\\n+|\\n+$", "''")):
        text = f"regexp_replace({text}, '{pattern}', {new}, 'g')"
    return f"trim({text})"


LINK_ROWS = """, ts as (select link_id, string_agg(tag, ' ' order by tag) as tags from link_tags group by link_id),
rows as (select user_id, row_number() over (partition by user_id order by links.saved_at desc, link_id desc) as place, link_id, url, title, site_name as site, author, description, note, tags, status,
  is_reference, source, strftime(links.saved_at, '%Y-%m-%dT%H:%M:%S.000Z') as saved_at, strftime(links.read_at, '%Y-%m-%dT%H:%M:%S.000Z') as read_at,
  strftime(links.starred_at, '%Y-%m-%dT%H:%M:%S.000Z') as starred_at from links left join ts using (link_id))
"""

ORACLES = {
    "atom_entries": f"""with t as (select *, {PLAIN} as plain from documents)
select doc_id as feed_id, 'urn:' || doc_id as guid, 'https://example.com/p/' || doc_id as url, 'Post ' || doc_id as title, 'A. Writer' as author, {SHORT} as summary,
  timestamp '2024-01-01 00:30:00' + to_hours(doc_id % 10) as published_at from t
union all select doc_id, 'urn:' || doc_id || ':b', 'https://other.example.org/' || doc_id, 'Second', null, 'short', timestamp '2024-01-02' from t""",
    "json_entries": f"""with t as (select *, {PLAIN} as plain from documents)
select doc_id as feed_id, cast(doc_id as varchar) as guid, 'https://example.com/p/' || doc_id as url, 'Post ' || doc_id as title, 'A. Writer' as author, {SHORT} as summary, null::varchar as content,
  timestamp '2024-01-01 08:30:00' as published_at from t
union all select doc_id, doc_id || '-b', 'https://other.example.org/' || doc_id, null, null, 'one & two three', '<p>one &amp; two</p><p>three</p>', null from t""",
    "feed_kinds": """select doc_id as feed_id, ['rss', 'atom', 'json', 'rdf', null][doc_id % 5 + 1] as kind, case when doc_id % 5 = 4 then 'not a feed' end as problem from documents""",
    "fresh_entries": with_views(
        """, found as (select feed_id, entry_id // 2 as guid, min(entry_id) as place from entries group by all)
select * from found f where not exists (select 1 from entries e where e.created_at < timestamp '2024-01-01' and e.feed_id = f.feed_id and e.entry_id // 2 = f.guid)""",
        "entries",
    ),
    "discovered_feeds": f"""select page_id, unnest([{ORIGIN} || '/comments/feed', split_part(url, '//', 1) || '//feeds.example.org/a', {ORIGIN} || '/rss?a=1&b=2']) as feed,
  unnest([true, false, false]) as comments from pages""",
    "page_previews": f"""select page_id, 'A &amp; B''s — text' as description, 'A Site' as site_name, 'A. Writer' as author, {ORIGIN} || '/img/1.png' as image_url, {ORIGIN} || '/c' as canonical_url from pages""",
    "character_references": """select page_id, '''' || page_id || '''—😀&#39;&lt;<&#0;&#xD800;&#9999999;& &#; &#x;' as text from pages""",
    "varied_previews": rf"""with p as (select page_id as k, url, trim(regexp_replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&'), '\s+', ' ', 'g')) as t,
  case when page_id % 7 = 0 then trim(repeat('w' || page_id || ' ', 300)) else 'D <' || page_id || '>' end as d from pages)
select k as page_id, case when k % 2 = 0 then 'OG "' || k || '"' when k % 3 = 0 then 'TW ' || k when t <> '' then case when length(t) > 300 then rtrim(substr(t, 1, 299)) || '…' else t end end as title,
case when k % 5 <= 2 then case when length(d) > 1000 then rtrim(substr(d, 1, 999)) || '…' else d end end as description, case k % 4 when 1 then 'Site-' || k when 2 then 'App ' || k end as site_name,
case when k % 3 = 1 and k % 2 = 1 then 'Writer ' || k end as author, case k % 4 when 0 then split_part(url, '//', 1) || '//cdn.example.com/' || k || '.png' when 1 then 'https://img.example.com/' || k || '?a=1&b=2' end as image_url,
case when k % 5 = 0 then {ORIGIN} || '/c/' || k end as canonical_url from p""",
    "varied_feeds": f"""select page_id, feed, false as comments from (
  select page_id, {ORIGIN} || '/rss/' || page_id as feed from pages where page_id % 3 = 0 union all select page_id, 'https://feeds.example.com/' || page_id from pages where page_id % 3 = 1
  union all select page_id, {ORIGIN} || '/feed/' || page_id || '.json' from pages where page_id % 2 = 0)""",
    "varied_references": """select doc_id, chr(cast(doc_id % 8192 + 33 as int)) || '&' || coalesce(lang, '') || '&lt;…' || chr(cast(doc_id % 8192 + 33 as int)) || '&nosuch;&#' || repeat('9', cast(doc_id % 8 + 1 as int)) as text from documents""",
    "web_urls": """select page_id, case page_id % 6 when 0 then url when 1 then 'https://' || regexp_replace(url, '^https?://', '') when 5 then null end as web_url from pages""",
    "located_quotes": """with t as (select doc_id, text, lower(regexp_replace(text, '\\s+', '', 'g')) as squeezed, regexp_extract_all(text, '\\S+')[4:6] as few from documents),
p as (select *, case when doc_id % 3 <> 0 and len(few) > 0 then instr(squeezed, lower(array_to_string(few, ''))) end as hit from t),
c as (select doc_id, hit, string_split(text, '') as chars from p)
select doc_id, case when hit > 0 then list_filter(range(1, len(chars) + 1), lambda i: regexp_matches(chars[i], '\\S'))[hit] - 1 end as place from c""",
    "stub_picks": with_views(
        """, p as (select link_id, coalesce(list_sum(list_transform(list_filter(string_split(title, ''), lambda c: c <> ''), lambda c: ascii(c))), 0) % 4 as k from links)
select link_id, ['a', 'b', 'c', 'other'][cast(k as bigint) + 1] as slug, 0.7e0 as p from p""",
        "links",
    ),
    "limit_clamps": """select event_id, case event_id % 8 when 0 then case when event_id % 150 = 0 then 20 else least(event_id % 150, 50) end when 2 then 12 when 5 then 50 else 20 end as n from events""",
    "question_checks": with_views(
        """, p as (select user_id as request_id, link_id, case when link_id % 9 = 0 then 'question id' when link_id % 7 = 0 or trim(title) = '' then 'instructions'
  when link_id % 3 <> 0 and link_id % 300 + 1 not between 2 and 255 then 'options' when link_id % 3 <> 0 and link_id % 11 = 0 then 'option id' end as problem from links)
select request_id, count(*) as questions, case when count(*) > 64 then 'count' else arg_min(problem, link_id) filter (where problem is not null) end as problem from p group by request_id""",
        "links",
    ),
    "fenced_replies": "select event_id, event_id % 4 < 3 as is_json, case when event_id % 4 < 3 then round(round(value, 2), 2) end as p from events",
    "library_page": with_views(LIBRARY.format("is_reference", "coalesce(starred_at, saved_at)", 200), "links"),
    "library_tag": with_views(LIBRARY.format("is_reference and status = 'queued' and link_id in (select link_id from link_tags where tag = 't3')", "coalesce(starred_at, saved_at)", 200), "links", "link_tags"),
    "palette_links": with_views(LIBRARY.format("status = 'archived'", "saved_at", 8), "links"),
    "categorized_users": with_views("select distinct user_id from item_categories", "item_categories"),
    "queue_search": with_views("select user_id, link_id, saved_at from links where status = 'queued'", "links"),
    "link_words": with_views(
        """select l.user_id, l.link_id, coalesce((select a.words from archives a where a.link_id = l.link_id and a.status = 'ready'), (select e.words from entries e where e.entry_id = l.source_entry_id)) as words
from links l""",
        "links", "archives", "entries",
    ),
    "export_links": with_views(LINK_ROWS + "select * from rows", "links", "link_tags"),
    "export_csv": with_views(
        LINK_ROWS + f"""select user_id, place, {" || ',' || ".join(cell_sql(c) for c in CSV_COLUMNS.values())} as line from rows
union all select distinct user_id, cast(0 as bigint), '{",".join(CSV_COLUMNS)}' from rows""",
        "links", "link_tags",
    ),
    "page_block_text": f"select page_id, {block_text_sql('html')} as text from pages",
    "sortable_ids": f"""select event_id, array_to_string(list_transform(range(10), lambda k: substr('{DIGITS}', cast((((epoch_us(ts) // 1000) >> cast(45 - 5 * k as bigint)) & 31) + 1 as bigint), 1)), '') as sortable,
  true as same from events""",
    "link_display": f"""with s as (select page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, {SITE} as site, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) as path from pages),
d as (select *, regexp_replace(regexp_replace(translate(lower(title), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as dashed,
  list_reduce(list_prepend(cast(0 as bigint), list_transform(string_split(site, ''), lambda c: cast(ascii(c) as bigint))), lambda h, c: (h * 31 + c) % 4294967296) as hashed from s)
select page_id as link_id, case when page_id % 4 <> 0 and title <> '' then title else site || case when path = '/' then '' else path end end as shown, site,
  [{", ".join(f"'{t}'" for t in TONES)}][hashed % {len(TONES)} + 1] as tone, case when dashed = '' then 'category' else regexp_replace(substr(dashed, 1, 40), '-+$', '') end as slug from d""",
    "budget_ledger": """with recursive r as materialized (
  select cast(ts as date) as day, cast(ceil(value) as bigint) as asked, row_number() over (partition by cast(ts as date) order by ts, event_id) as k from events),
f as (select day, k, case when asked <= 2000 then asked else 0 end as spent, case when asked <= 2000 then 1 else 0 end as taken from r where k = 1
  union all select r.day, r.k, case when f.spent + r.asked <= 2000 then f.spent + r.asked else f.spent end, case when f.spent + r.asked <= 2000 then 1 else 0 end from f join r on r.day = f.day and r.k = f.k + 1)
select day, cast(sum(taken) as bigint) as accepted, cast(sum(1 - taken) as bigint) as refused, cast(max(spent) as bigint) as spent from f group by day""",
    "token_last_used": """with recursive w as (
  select user_id, min(ts) as used from events group by user_id
  union all select w.user_id, min(e.ts) from w join events e on e.user_id = w.user_id and e.ts > w.used + interval 1 hour group by w.user_id)
select user_id, count(*) as writes, max(used) as last_used from w group by user_id""",
}
