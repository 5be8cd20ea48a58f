"""The reading queries by name, and the same queries as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.texts import first_words, strip_tags, strip_tags_sql, summary, tags
from quire.functions.urls import canonical, canonical_sql, host
from quire.operators import edits, jobs, reading, upkeep
from quire.operators.inbox import inbox
from quire.plans import changes, formats, merges, searches
from quire.plans.views import NOW, Views, with_views

SINCE = "(timestamp '" + NOW + "' - interval '{}' day)"
Plan = Callable[[Views], DataFrame]

INBOX = """, page as (
  select * from (
    select s.user_id, e.entry_id, e.feed_id, e.entry_date, st.read_at is null as unread, l.link_id,
      case when e.words > 0 then cast(greatest(1, round(e.words / 230.0e0)) as bigint) end as minutes,
      row_number() over (partition by s.user_id order by st.read_at is not null, e.entry_date desc, e.entry_id desc, l.link_id desc nulls last) as rn
    from entries e join subs s on s.feed_id = e.feed_id
    left join state st on st.user_id = s.user_id and st.entry_id = e.entry_id
    left join links l on l.user_id = s.user_id and l.source_entry_id = e.entry_id
    where st.dismissed_at is null {where}) where rn <= 60)
"""
INBOX_VIEWS = ("entries", "subs", "state", "links")
MARKS = ", marks as (select user_id, entry_id, count(*) as n_highlights, max(created_at) as last_highlight from highlights group by all)"
UNREAD = "(st.read_at is null and st.dismissed_at is null)"


def inbox_sql(where: str = "", *views: str) -> str:
    return with_views(INBOX.format(where=where) + " select user_id, entry_id, feed_id, entry_date, unread, link_id, minutes from page", *INBOX_VIEWS, *views)


ITEMS = f""", recent as (select * from (
  select 'post' as kind, user_id, entry_id as id, updated_at, progress from places union all select 'shared', user_id, link_id, updated_at, progress from link_places)
  qualify row_number() over (partition by user_id order by updated_at desc, kind desc, id desc) <= 50),
partway as (select * from (
  select r.user_id, r.kind, r.id, e.entry_date as date, st.read_at is not null as read, r.updated_at from recent r join entries e on r.kind = 'post' and e.entry_id = r.id join subs s on s.user_id = r.user_id and s.feed_id = e.feed_id
    left join state st on st.user_id = r.user_id and st.entry_id = r.id where st.dismissed_at is null
  union all select r.user_id, r.kind, r.id, l.saved_at, false, r.updated_at from recent r join links l on r.kind = 'shared' and l.link_id = r.id and l.user_id = r.user_id and l.status = 'queued')
  qualify row_number() over (partition by user_id order by updated_at desc, kind desc, id desc) <= 4),
both_kinds as (select distinct user_id, 'post' as kind, entry_id as id, entry_date as date, not unread as read from page
  union all (select user_id, 'shared', link_id, saved_at, false from links where status = 'queued' qualify row_number() over (partition by user_id order by saved_at desc, link_id desc) <= 60)),
listed as (select user_id, 'continuing' as section, row_number() over (partition by user_id order by updated_at desc, kind desc, id desc) as place, kind, id, date, read from partway
  union all (select user_id, 'list', row_number() over w as place, kind, id, date, read from both_kinds b where not exists (select 1 from partway p where p.user_id = b.user_id and p.kind = b.kind and p.id = b.id)
  window w as (partition by user_id order by read, date desc, id desc, kind) qualify place <= 60)),
facts as (
  select i.*, coalesce(e.title, substr(e.content, 1, 80), 'Untitled') as title, coalesce(s.title_override, f.title, f.url) as source, false as note,
    coalesce((select bool_or(l.is_reference) from links l where l.user_id = i.user_id and l.source_entry_id = i.id), false) as starred, e.words, p.p_open, p.p_keep, concat_ws(',', c.primary_slug, c.secondary_slug) as categories
  from listed i join entries e on e.entry_id = i.id join subs s on s.user_id = i.user_id and s.feed_id = e.feed_id join feeds f on f.feed_id = e.feed_id
    left join predictions p on p.user_id = i.user_id and p.entry_id = i.id and p.error is null left join item_categories c on c.user_id = i.user_id and c.entry_id = i.id where i.kind = 'post'
  union all
  select i.*, case when coalesce(l.title, '') <> '' then l.title else regexp_replace(lower(regexp_extract(l.url, '^[a-zA-Z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\\.', '') end, l.site_name, coalesce(l.note <> '', false), l.is_reference,
    coalesce((select a.words from archives a where a.link_id = l.link_id and a.status = 'ready'), (select e.words from entries e where e.entry_id = l.source_entry_id)), p.p_open, p.p_keep, coalesce(c.slug, '')
  from listed i join links l on l.link_id = i.id left join link_predictions p on p.link_id = i.id and p.error is null left join link_categories c on c.link_id = i.id where i.kind = 'shared'),
items as (select f.*, not starred and coalesce(p_keep, 0) >= 0.5 as candidate, case when words > 0 then cast(greatest(1, round(words / 230.0e0)) as bigint) end as minutes, round(r.progress, 6) as progress,
  case when section = 'continuing' then 0 when read then -1 else round(coalesce(p_open, 0.5e0) * pow(0.5e0, greatest(0.0e0, (epoch_us(timestamp '{NOW}') - epoch_us(date)) / 86400000000.0e0) / 3), 6) end as worth
  from facts f left join recent r on r.user_id = f.user_id and r.kind = f.kind and r.id = f.id)
select user_id, section, {{place}} as place, kind, id, title, source, date, read, note, starred, categories, p_open, p_keep, candidate, minutes, progress from items"""
ITEM_VIEWS = (*INBOX_VIEWS, "places", "link_places", "feeds", "predictions", "link_predictions", "item_categories", "link_categories", "archives")


def scorecard_sql(score: str, hit: str) -> str:
    return with_views(
        f""", rows as (
  select p.{score} as p, {hit} as hit from predictions p
  left join state s on s.user_id = p.user_id and s.entry_id = p.entry_id
  left join history h on h.user_id = p.user_id and h.entry_id = p.entry_id
  where p.error is null and coalesce(s.opened_at, s.dismissed_at, h.opened_at, h.dismissed_at) is not null),
edges as (select * from (values (0, 0.0e0, 0.2e0), (1, 0.2e0, 0.4e0), (2, 0.4e0, 0.6e0), (3, 0.6e0, 0.8e0), (4, 0.8e0, 1.0001e0)) as t(bin, lo, hi))
select cast(bin as bigint) as bin, count(p) as n, count(case when hit then 1 end) as hits from edges left join rows on p >= lo and p < hi group by bin""",
        "predictions", "state", "history", "links",
    )


STARRED = "exists (select 1 from links l where l.is_reference and l.user_id = p.user_id and l.source_entry_id = p.entry_id)"

DIGEST_LINKS = f""", dl as (select * from (
  select l.user_id, 'link' as kind, l.link_id as id,
    3.0e0 * cast(coalesce(l.note, '') <> '' or m.n_highlights is not null as int) + 3.0e0 * cast(l.is_reference as int) + 2.0e0 * least(l.cite_count, 3)
      + cast(l.opened_at is not null as int) + 0.5e0 * cast(l.status = 'archived' as int) as score,
    greatest(l.read_at, l.starred_at, l.opened_at, l.cited_at, m.last_highlight, l.saved_at) as last_activity,
    row_number() over (partition by l.user_id order by l.updated_at desc, l.link_id desc) as rn
  from links l left join marks m on m.user_id = l.user_id and m.entry_id = l.source_entry_id
  where l.read_at >= {SINCE.format(14)} or l.starred_at >= {SINCE.format(14)} or l.opened_at >= {SINCE.format(14)} or l.cited_at >= {SINCE.format(14)}
    or (coalesce(l.note, '') <> '' and l.updated_at >= {SINCE.format(14)}) or m.last_highlight >= {SINCE.format(14)}) where rn <= 200)"""
DIGEST_POSTS = f""", dp as (select * from (
  select s.user_id, 'post' as kind, s.entry_id as id,
    3.0e0 * cast(m.n_highlights is not null as int) + 2.0e0 * cast(s.cited_at is not null as int) + cast(s.opened_at is not null as int) + 0.5e0 * cast(s.read_at is not null as int) as score,
    greatest(s.opened_at, s.cited_at, m.last_highlight, s.read_at) as last_activity,
    row_number() over (partition by s.user_id order by s.opened_at desc nulls last, s.entry_id desc) as rn
  from state s left join marks m on m.user_id = s.user_id and m.entry_id = s.entry_id
  where (s.opened_at >= {SINCE.format(14)} or s.cited_at >= {SINCE.format(14)} or m.last_highlight >= {SINCE.format(14)})
    and not exists (select 1 from links l where l.user_id = s.user_id and l.source_entry_id = s.entry_id)) where rn <= 200)"""

DOOMED = f""", doomed as (
  select entry_id, feed_id from (select entry_id, feed_id, entry_date, row_number() over (partition by feed_id order by entry_date desc, entry_id desc) as rn from entries) e
  where rn > 50 and entry_date < {SINCE.format(30)}
    and not exists (select 1 from links l where l.source_entry_id = e.entry_id)
    and not exists (select 1 from places p where p.entry_id = e.entry_id and p.updated_at >= {SINCE.format(60)})
    and not exists (select 1 from highlights h where h.entry_id = e.entry_id))"""


def profile_sql(body: str) -> str:
    return with_views(
        f""", both_states as (select user_id, entry_id, opened_at, dismissed_at from state union all select user_id, entry_id, opened_at, dismissed_at from history),
rows as ({body})
select user_id, kind, id, stamp from (select *, row_number() over (partition by user_id order by stamp desc, kind, id) as rn from rows) where rn <= 15""",
        "state", "history", "links",
    )


def candidates_sql(extra_posts: str, links: str, last: str, *views: str) -> str:
    return with_views(
        f""", rows as (
  select s.user_id, 'post' as kind, e.entry_id as id, e.entry_date as stamp from entries e join subs s on s.feed_id = e.feed_id
  left join state st on st.user_id = s.user_id and st.entry_id = e.entry_id
  where {UNREAD} and e.created_at >= {SINCE.format(7)} and not exists ({extra_posts})
  union all {links})
{last}""",
        "entries", "subs", "state", "links", *views,
    )


def standing(item: str) -> str:
    """SQL of the predictions p of an item that keep it from being scored again."""
    return f"p.user_id = {item} and (p.error is null or p.attempts >= 3 or p.updated_at > timestamp '{NOW}' - to_hours(cast(p.attempts as int)))"


def search_filter_only(v: Views) -> DataFrame:
    """tag:t3 site:example.com is:queued: tags and states all hold, the site or any below it; newest saved first."""
    from quire.operators.search import filtered, parse_search

    return filtered(v, parse_search("tag:t3 site:example.com is:queued")).select("user_id", "link_id", "canonical_url", "saved_at")


def search_bm25(v: Views) -> DataFrame:
    from quire.operators.search import ranked, tokens

    return ranked(v.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body")), tokens, ["that", "onel*"])


SEARCH_BM25 = r"""with toks as (
  select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\x{80}-\x{10ffff}]+'), lambda t: t <> '')) as term from documents),
lens as (select d.doc_id, count(t.term) as dl from documents d left join toks t on t.doc_id = d.doc_id group by d.doc_id),
stats as (select count(*) as n, avg(dl) as avgdl from lens),
hits as (select doc_id, q, count(*) as tf from (select doc_id, 'that' as q from toks where term = 'that' union all select doc_id, 'onel' as q from toks where starts_with(term, 'onel')) group by all),
dfs as (select q, count(*) as df from hits group by q),
scored as (select h.doc_id, h.q, greatest(1.0e-6, ln((n - df + 0.5e0) / (df + 0.5e0))) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl)) as s
  from hits h join dfs using (q) join lens using (doc_id), stats)
select doc_id as id, round(sum(s), 6) as score from scored group by doc_id having count(*) = 2"""


def canonical_urls(v: Views) -> DataFrame:
    url = canonical(F.col("url"))
    return v.raw("pages").select("page_id", url.alias("canonical_url"), host(url).alias("host"))


def page_text(v: Views) -> DataFrame:
    plain = strip_tags(F.col("html"))
    return v.raw("pages").select("page_id", plain.alias("plain"), summary(plain).alias("summary"), first_words(plain, 20).alias("head"))


def parsed_tags(v: Views) -> DataFrame:
    return v.raw("documents").select("doc_id", F.array_join(tags(F.col("text")), ",").alias("tags"))


def export_links(v: Views) -> DataFrame:
    from quire.sources.export import link_rows

    return link_rows(v)


def export_csv(v: Views) -> DataFrame:
    from quire.sources.export import csv_lines

    return csv_lines(v)


def page_metadata(v: Views) -> DataFrame:
    from quire.functions.pages import metadata

    return metadata(v.raw("pages"))


def extract_article(v: Views) -> DataFrame:
    from quire.functions.pages import articles

    return articles(v.raw("pages"))


def feed_parse(v: Views) -> DataFrame:
    """Posts written as RSS documents of one item and parsed again."""
    from quire.sources.export import escaped
    from quire.sources.feeds import entries

    i = F.col("doc_id").cast("string")
    body = F.concat(
        F.lit('<rss version="2.0"><channel><title>t</title><link>https://example.com/</link><item><title>'), escaped(F.concat_ws(" ", F.lit("Post"), i, F.col("source"))),
        F.lit('</title><link>/p/'), i, F.lit("</link><guid>g"), i, F.lit("</guid><description>"), escaped(F.coalesce("text", F.lit(""))),
        F.lit("</description><pubDate>Mon, 01 Jan 2024 0"), (F.col("doc_id") % 10).cast("string"), F.lit(":30:00 GMT</pubDate></item></channel></rss>"),
    )
    feeds = v.raw("documents").select(F.col("doc_id").alias("feed_id"), F.lit("https://example.com/rss").alias("feed_url"), body.alias("body"))
    return entries(feeds).select("feed_id", "guid", "url", "title", "summary", "published_at")


def opml_roundtrip(v: Views) -> DataFrame:
    from quire.sources.export import opml
    from quire.sources.feeds import opml_feeds

    return opml_feeds(opml(v).withColumnRenamed("document", "body")).select("user_id", "url", "title", "folder")


def stream_fold_entry_state(v: Views) -> DataFrame:
    from quire.streaming.fold import stream_fold

    return stream_fold(v.spark, v.sf_dir)


def reading_sessions(v: Views) -> DataFrame:
    from quire.streaming.fold import views_sessions

    return views_sessions(v)


QUERIES: dict[str, Plan] = {
    "feed_open_rates": reading.feed_open_rates,
    "scorecard_open": lambda v: reading.scorecard(v, "p_open", "opened"),
    "scorecard_keep": lambda v: reading.scorecard(v, "p_keep", "starred"),
    "facets_tags": reading.tag_facets,
    "facets_sites": reading.site_facets,
    "subscriptions_unread": reading.subscription_list,
    "folder_unread": reading.folder_unread,
    "unread_badge": reading.unread_badge,
    "inbox_posts": reading.inbox_posts,
    "inbox_short": reading.inbox_short,
    "inbox_by_category": lambda v: reading.inbox_posts(v, category="c2"),
    "inbox_by_folder": lambda v: reading.inbox_posts(v, follows=F.col("folder") == "f1"),
    "inbox_likely": reading.inbox_likely,
    "inbox_merged": reading.inbox_merged,
    "inbox_items": inbox,
    "inbox_items_likely": lambda v: inbox(v, "likely"),
    "continue_reading": reading.continue_reading,
    "next_item": reading.next_item,
    "library_candidates": reading.library_candidates,
    "digest_links": reading.digest_links,
    "digest_posts": reading.digest_posts,
    "digest_ranked": reading.digest_ranked,
    "reaction_reasons": reading.reaction_reasons,
    "highlight_runs": reading.highlight_runs,
    "composed_notes": reading.composed_notes,
    "profile_opened": lambda v: reading.profile_list(v, "opened"),
    "profile_skipped": lambda v: reading.profile_list(v, "skipped"),
    "profile_starred": lambda v: reading.profile_list(v, "starred"),
    "score_candidates": jobs.score_candidates,
    "categorize_candidates": jobs.categorize_candidates,
    "prune_doomed": jobs.doomed,
    "prune_history": jobs.prune_history,
    "prune_orphan_feeds": jobs.orphan_feeds,
    "poll_schedule": jobs.poll_schedule,
    "due_feeds": jobs.due_feeds,
    "claim_archives": jobs.claim_archives,
    "prune_archives": jobs.prune_archives,
    "fold_entry_state": lambda v: jobs.fold_entry_state(v.actions),
    "mark_backlog": jobs.mark_backlog,
    "mark_all_read": jobs.mark_all_read,
    "opened_backfill": jobs.opened_backfill,
    "word_counts": jobs.words_by_post,
    "neuron_costs": jobs.neuron_costs,
    "budget_ledger": jobs.budget_ledger,
    "placement": jobs.placements,
    "check_report": jobs.check_report,
    "category_counts": jobs.category_counts,
    "token_last_used": jobs.last_used,
    "canonical_urls": canonical_urls,
    "strip_tags": page_text,
    "parse_tags": parsed_tags,
    "search_filter_only": search_filter_only,
    "search_bm25": search_bm25,
    "export_links": export_links,
    "export_csv": export_csv,
    "kept_entries": upkeep.kept_entries,
    "imported_feeds": upkeep.imported_feeds,
    "upserted_feeds": upkeep.upserted_feeds,
    "refreshed_feeds": upkeep.refreshed_feeds,
    "refresh_totals": upkeep.refresh_totals,
    "saved_categories": upkeep.saved_categories,
    "drafted_slugs": upkeep.drafted_slugs,
    "placed_inbox": upkeep.placed_inbox,
    "queue_page": upkeep.queue_page,
    "check_summary": upkeep.check_summary,
    "settled_budget": upkeep.settled_budget,
    "reader_states": upkeep.reader_states,
    "triage": upkeep.triage,
    "dispatch_counts": upkeep.dispatch_counts,
    "highlights_of": upkeep.highlights_of,
    "page_block_text": upkeep.page_block_text,
    "place_labels": upkeep.place_labels,
    "spoken_posts": upkeep.spoken_posts,
    "token_hashes": upkeep.token_hashes,
    "entry_links": edits.entry_links,
    "save_links": edits.save_links,
    "capture_archives": edits.capture_archives,
    "keep_until": edits.keep_until,
    "last_places": edits.last_places,
    "undone_log": edits.undone_log,
    "correction_examples": edits.correction_examples,
    "item_texts": edits.item_texts,
    "batches": edits.batches,
    "read_entries": edits.read_entries,
    "suggestion_sample": edits.suggestion_sample,
    "link_display": edits.link_display,
    "link_json": edits.link_json,
    "claimed_canonicals": edits.claimed_canonicals,
    "sortable_ids": edits.sortable_ids,
    "parsed_answers": edits.parsed_answers,
    "new_users": edits.new_users,
    "long_posts": edits.long_posts,
    "page_metadata": page_metadata,
    "extract_article": extract_article,
    "feed_parse": feed_parse,
    "opml_roundtrip": opml_roundtrip,
    "stream_fold_entry_state": stream_fold_entry_state,
    "reading_sessions": reading_sessions,
}

ORACLES: dict[str, str] = {
    "feed_open_rates": with_views(
        f""", both_states as (
  select s.user_id, e.feed_id, s.opened_at, s.dismissed_at from state s join entries e on e.entry_id = s.entry_id
  union all select user_id, feed_id, opened_at, dismissed_at from history)
select user_id, feed_id, count(case when opened_at is not null then 1 end) as n_opened, count(case when opened_at is null and dismissed_at is not null then 1 end) as n_skipped
from both_states where coalesce(opened_at, dismissed_at) >= {SINCE.format(90)} group by user_id, feed_id""",
        "state", "entries", "history",
    ),
    "scorecard_open": scorecard_sql("p_open", "coalesce(s.opened_at, h.opened_at) is not null"),
    "scorecard_keep": scorecard_sql("p_keep", STARRED),
    "facets_tags": with_views(
        """, counts as (select l.user_id, t.tag, count(*) as n from links l join link_tags t on t.link_id = l.link_id group by all)
select user_id, tag, n from (select *, row_number() over (partition by user_id order by n desc, tag) as rn from counts) where rn <= 40""",
        "links", "link_tags",
    ),
    "facets_sites": with_views(
        """, counts as (select user_id, site_name as host, count(*) as n from links group by all)
select user_id, host, n from (select *, row_number() over (partition by user_id order by n desc, host) as rn from counts) where rn <= 12""",
        "links",
    ),
    "subscriptions_unread": with_views(
        f"""select s.user_id, s.feed_id, coalesce(s.title_override, f.title, f.url) as title, s.folder,
  (select count(*) from entries e where e.feed_id = s.feed_id)
  - (select count(*) from entries e join state st on st.entry_id = e.entry_id where e.feed_id = s.feed_id and st.user_id = s.user_id and not {UNREAD}) as unread
from subs s join feeds f on f.feed_id = s.feed_id""",
        "subs", "feeds", "entries", "state",
    ),
    "folder_unread": with_views(
        f"""select s.user_id, s.folder, count(case when e.entry_id is not null and {UNREAD} then 1 end) as unread
from subs s left join entries e on e.feed_id = s.feed_id left join state st on st.user_id = s.user_id and st.entry_id = e.entry_id group by s.user_id, s.folder""",
        "subs", "entries", "state",
    ),
    "unread_badge": with_views(
        f""", posts as (
  select s.user_id, count(*) as posts from entries e join subs s on s.feed_id = e.feed_id left join state st on st.user_id = s.user_id and st.entry_id = e.entry_id
  where {UNREAD} and e.entry_date >= {SINCE.format(60)} group by s.user_id),
queue as (select user_id, count(*) as queued from links where status = 'queued' group by user_id)
select u.user_id, coalesce(posts, 0) as posts, coalesce(queued, 0) as queued, coalesce(posts, 0) + coalesce(queued, 0) as total
from users u left join posts using (user_id) left join queue using (user_id)""",
        "users", "entries", "subs", "state", "links",
    ),
    "inbox_posts": inbox_sql(),
    "inbox_short": inbox_sql("and e.words < 1035"),
    "inbox_by_category": inbox_sql("and exists (select 1 from item_categories c where c.user_id = s.user_id and c.entry_id = e.entry_id and (c.primary_slug = 'c2' or c.secondary_slug = 'c2'))", "item_categories"),
    "inbox_by_folder": inbox_sql("and s.folder = 'f1'"),
    "inbox_likely": with_views(
        INBOX.format(where="") + f""", scored as (
  select page.user_id, page.entry_id, page.entry_date, page.link_id, unread,
    round(case when unread then coalesce(p_open, 0.5e0) * pow(0.5e0, greatest(0.0e0, (epoch_us(timestamp '{NOW}') - epoch_us(entry_date)) / 86400000000.0e0) / 3) else -1.0e0 end, 6) as likely
  from page left join predictions p on p.error is null and p.user_id = page.user_id and p.entry_id = page.entry_id)
select user_id, entry_id, likely, unread, row_number() over (partition by user_id order by likely desc, entry_date desc, entry_id desc, link_id desc nulls last) as place from scored""",
        *INBOX_VIEWS, "predictions",
    ),
    "inbox_items": with_views(INBOX.format(where="") + ITEMS.format(place="place"), *ITEM_VIEWS),
    "inbox_items_likely": with_views(INBOX.format(where="") + ITEMS.format(place="row_number() over (partition by user_id, section order by worth desc, place)"), *ITEM_VIEWS),
    "inbox_merged": with_views(
        INBOX.format(where="") + """, rows as (
  select user_id, 'post' as kind, entry_id as id, entry_date as stamp, unread from page
  union select user_id, 'link', link_id, saved_at, true from links where status = 'queued')
select user_id, kind, id, stamp, unread from (select *, row_number() over (partition by user_id order by unread desc, stamp desc, id desc, kind) as rn from rows) where rn <= 60""",
        *INBOX_VIEWS,
    ),
    "continue_reading": with_views(
        """, recent as (select * from (select *, row_number() over (partition by user_id order by updated_at desc, entry_id desc) as rn from places) where rn <= 50),
shown as (select r.user_id, r.entry_id, r.updated_at, r.progress from recent r join entries e on e.entry_id = r.entry_id
  where exists (select 1 from subs s where s.user_id = r.user_id and s.feed_id = e.feed_id)
    and not exists (select 1 from state st where st.user_id = r.user_id and st.entry_id = r.entry_id and st.dismissed_at is not null))
select user_id, entry_id, updated_at, round(progress, 6) as progress from (select *, row_number() over (partition by user_id order by updated_at desc, entry_id desc) as k from shown) where k <= 4""",
        "places", "entries", "subs", "state",
    ),
    "next_item": with_views(
        f""", rows as (
  select s.user_id, 'post' as kind, e.entry_id as id, e.entry_date as stamp from entries e join subs s on s.feed_id = e.feed_id
  left join state st on st.user_id = s.user_id and st.entry_id = e.entry_id where {UNREAD}
  union all select user_id, 'link', link_id, saved_at from links where status = 'queued')
select user_id, kind, id, stamp from (select *, row_number() over (partition by user_id order by stamp desc, kind desc, id desc) as rn from rows) where rn = 1""",
        "entries", "subs", "state", "links",
    ),
    "library_candidates": with_views(f"select user_id, entry_id, p_keep from predictions p where error is null and p_keep >= 0.5e0 and not {STARRED}", "predictions", "links"),
    "digest_links": with_views(MARKS + DIGEST_LINKS + " select user_id, id as link_id, score, last_activity from dl", "links", "highlights"),
    "digest_posts": with_views(MARKS + DIGEST_POSTS + " select user_id, id as entry_id, score, last_activity from dp", "links", "highlights", "state"),
    "digest_ranked": with_views(
        MARKS + DIGEST_LINKS + DIGEST_POSTS + """ select *, row_number() over (partition by user_id order by score desc, last_activity desc, kind, id desc) as place from (
  select user_id, kind, id, score, last_activity from dl union all select user_id, kind, id, score, last_activity from dp)""",
        "links", "highlights", "state",
    ),
    "reaction_reasons": with_views(
        MARKS + """ select link_id, coalesce(array_to_string(list_filter([case when coalesce(note, '') <> '' then 'note' end,
    case when n_highlights = 1 then '1 highlight' when n_highlights > 1 then n_highlights || ' highlights' end, case when is_reference then 'starred' end,
    case when cite_count = 1 then 'cited once' when cite_count > 1 then cite_count || ' citations' end, case when opened_at is not null then 'opened' end,
    case when status = 'archived' then 'finished' end], lambda r: r is not null), ', '), '') as reasons
from links l left join marks m on m.user_id = l.user_id and m.entry_id = l.source_entry_id""",
        "links", "highlights",
    ),
    "highlight_runs": with_views(
        """, flags as (select *, case when lag(entry_id) over w is not distinct from entry_id then 0 else 1 end as new from highlights window w as (partition by user_id order by created_at desc, highlight_id desc)),
runs as (select *, sum(new) over (partition by user_id order by created_at desc, highlight_id desc rows unbounded preceding) as run from flags)
select user_id, cast(run as bigint) as run, entry_id, count(*) as n, max(created_at) as latest from runs group by all""",
        "highlights",
    ),
    "composed_notes": with_views(
        r""", hs as (select user_id, entry_id, list(note order by created_at, highlight_id) as notes from highlights where note is not null group by user_id, entry_id)
select link_id, array_to_string(list_concat(case when note is null then [] else [note] end, coalesce(notes, [])), chr(10) || chr(10)) as notes
from links l left join hs h on h.user_id = l.user_id and h.entry_id = l.source_entry_id where note is not null or notes is not null""",
        "links", "highlights",
    ),
    "profile_opened": profile_sql("select user_id, 'post' as kind, entry_id as id, opened_at as stamp from both_states where opened_at is not null union all select user_id, 'link', link_id, opened_at from links where opened_at is not null"),
    "profile_skipped": profile_sql("select user_id, 'post' as kind, entry_id as id, dismissed_at as stamp from both_states where dismissed_at is not null and opened_at is null"),
    "profile_starred": profile_sql("select user_id, 'link' as kind, link_id as id, starred_at as stamp from links where is_reference"),
    "score_candidates": candidates_sql(
        f"select 1 from predictions p where {standing('s.user_id')} and p.entry_id = e.entry_id",
        f"""select l.user_id, 'link', l.link_id, l.saved_at from links l left join archives a on a.link_id = l.link_id
  where l.status = 'queued' and (a.status is null or a.status in ('ready', 'failed') or l.saved_at < timestamp '{NOW}' - interval '1' hour)
  and not exists (select 1 from link_predictions p where {standing('l.user_id')} and p.link_id = l.link_id)""",
        "select user_id, kind, id, stamp from rows order by stamp desc, kind, id desc, user_id limit 20",
        "predictions", "link_predictions", "archives",
    ),
    "categorize_candidates": candidates_sql(
        "select 1 from item_categories c where c.user_id = s.user_id and c.entry_id = e.entry_id",
        "select l.user_id, 'link', l.link_id, l.saved_at from links l where (l.status = 'queued' or l.is_reference) and not exists (select 1 from link_categories c where c.user_id = l.user_id and c.link_id = l.link_id)",
        "select user_id, kind, id, stamp from (select *, row_number() over (partition by user_id order by stamp desc, kind, id desc) as rn from rows) where rn <= 20",
        "item_categories", "link_categories",
    ),
    "prune_doomed": with_views(DOOMED + " select entry_id, feed_id from doomed", "entries", "links", "places", "highlights"),
    "prune_history": with_views(
        DOOMED + """ select s.user_id, s.entry_id, d.feed_id, s.opened_at, s.cited_at, s.dismissed_at from state s join doomed d on d.entry_id = s.entry_id
where (s.opened_at is not null or s.cited_at is not null or s.dismissed_at is not null) and not exists (select 1 from history h where h.user_id = s.user_id and h.entry_id = s.entry_id)""",
        "entries", "links", "places", "highlights", "state", "history",
    ),
    "prune_orphan_feeds": with_views("select feed_id, url from feeds f where not exists (select 1 from subs s where s.feed_id = f.feed_id)", "feeds", "subs"),
    "poll_schedule": with_views(
        f""", latest as (select feed_id, max(published_at) as latest from entries group by feed_id),
ages as (select f.feed_id, latest, error_count, (epoch_us(timestamp '{NOW}') - epoch_us(latest)) / 60000000.0e0 as age from feeds f left join latest l on l.feed_id = f.feed_id)
select feed_id, latest, cast(case when age < 1440 then 30 when age < 10080 then 60 when age < 43200 then 180 else 360 end as bigint) as minutes,
cast(least(1440, 60 * pow(2, least(error_count + 1, 10))) as bigint) as backoff from ages""",
        "feeds", "entries",
    ),
    "due_feeds": with_views(
        f"""select feed_id, next_fetch_at from feeds f where (next_fetch_at is null or next_fetch_at <= timestamp '{NOW}') and exists (select 1 from subs s where s.feed_id = f.feed_id)
order by next_fetch_at nulls first, feed_id limit 40""",
        "feeds", "subs",
    ),
    "claim_archives": with_views(
        f""", failing as (select link_id from archives where status = 'fetching' and updated_at < timestamp '{NOW}' - interval '10' minute and attempts >= 3),
due as (select link_id, updated_at from archives where link_id not in (select link_id from failing) and (status = 'pending' or (status = 'fetching' and updated_at < timestamp '{NOW}' - interval '10' minute)
  or (status = 'failed' and attempts < 3 and updated_at < timestamp '{NOW}' - to_hours(cast(attempts as int)))) order by updated_at desc, link_id desc limit 5)
select link_id, 'fail' as action from failing union all select link_id, 'claim' from due""",
        "archives",
    ),
    "prune_archives": with_views(f"select link_id, keep_until from archives where keep_until < timestamp '{NOW}'", "archives"),
    "fold_entry_state": with_views(
        """, undo as (select user_id, entry_id, max(struct_pack(stamp := stamp, event_id := event_id)) as undone from actions where event_type = 'purchase' group by all)
select a.user_id, a.entry_id, min(case when event_type = 'view' then stamp end) as opened_at, min(case when event_type in ('view', 'signup', 'error') then stamp end) as read_at,
max(case when event_type = 'error' and (undone is null or struct_pack(stamp := stamp, event_id := event_id) > undone) then stamp end) as dismissed_at,
max(case when event_type = 'click' then stamp end) as cited_at, count(case when event_type = 'click' then 1 end) as n_cites
from actions a left join undo u on u.user_id = a.user_id and u.entry_id = a.entry_id group by a.user_id, a.entry_id""",
        "actions",
    ),
    "mark_backlog": with_views(
        """select s.user_id, s.feed_id, count(*) as inserted from subs s join entries e on e.feed_id = s.feed_id
where not exists (select 1 from state st where st.user_id = s.user_id and st.entry_id = e.entry_id) group by all""",
        "subs", "entries", "state",
    ),
    "mark_all_read": with_views(
        """select s.user_id, count(*) as marked from subs s join entries e on e.feed_id = s.feed_id left join state st on st.user_id = s.user_id and st.entry_id = e.entry_id
where st.read_at is null group by s.user_id""",
        "subs", "entries", "state",
    ),
    "opened_backfill": with_views(
        """select st.user_id, st.entry_id, case when (dismissed_at is null or epoch_us(dismissed_at) - epoch_us(read_at) > 1000000) and epoch_us(read_at) - epoch_us(e.created_at) > 60000000
  and epoch_us(read_at) - coalesce((select epoch_us(s.followed_at) from subs s where s.user_id = st.user_id and s.feed_id = e.feed_id), 0) > 60000000 then read_at else opened_at end as opened_at
from state st left join entries e on e.entry_id = st.entry_id where read_at is not null""",
        "state", "entries", "subs",
    ),
    "word_counts": with_views("select entry_id, words, case when words > 0 then cast(greatest(1, round(words / 230.0e0)) as bigint) end as minutes, words >= 1035 as is_long from entries", "entries"),
    "neuron_costs": """select doc_id as entry_id, cast(ceil(length(text) / 4.0e0) as bigint) as tokens, cast(ceil(ceil(length(text) / 4.0e0) * 8182 / 1000000.0e0) as bigint) as small,
cast(ceil(ceil(length(text) / 4.0e0) * 21818 / 1000000.0e0) as bigint) as large from documents""",
    "placement": with_views(
        """, p as (select entry_id, ((entry_id * 7919) % 1000) / 1000.0e0 as share, 'c' || (entry_id % 4) as a,
  case when entry_id % 6 = 5 then 'other' else 'c' || ((entry_id + 1) % 4) end as b, case when entry_id % 10 = 0 then 'c9' end as named from entries),
r as (select *, list_sort([{'p': share, 'slug': a}, {'p': 1.0e0 - share, 'slug': b}], 'DESC') as ranked from p),
n as (select *, coalesce(named, ranked[1].slug) as first from r), s as (select *, list_filter(ranked, lambda x: x.slug <> first)[1] as second from n)
select entry_id, first as primary, case when second.p >= 0.35e0 and second.slug <> 'other' then second.slug end as secondary from s""",
        "entries",
    ),
    "check_report": with_views(
        """, p as (select ((entry_id * 7919) % 1000) / 1000.0e0 as share, 'c' || (entry_id % 4) as a, 'c' || ((entry_id + 1 + entry_id % 3) % 4) as b from entries)
select least(a, b) || '/' || greatest(a, b) as pair, count(*) as n from p where abs(2 * share - 1) < 0.2e0 and a <> b group by pair having count(*) >= 2""",
        "entries",
    ),
    "category_counts": with_views("select user_id, primary_slug, count(*) as n, count(case when corrected then 1 end) as corrected from item_categories group by all", "item_categories"),
    "canonical_urls": f"select page_id, {canonical_sql('url')} as canonical_url, regexp_extract({canonical_sql('url')}, '^https://([^/]+)/', 1) as host from pages",
    "strip_tags": f"""with p as (select page_id, {strip_tags_sql('html')} as plain from pages)
select page_id, plain, case when plain = '' then null when length(plain) > 400 then regexp_replace(substr(plain, 1, 400), '\\s+\\S*$', '') || '…' else plain end as summary,
array_to_string(regexp_extract_all(plain, '\\S+')[1:20], ' ') || case when len(regexp_extract_all(plain, '\\S+')) > 20 then ' …' else '' end as head from p""",
    "parse_tags": r"""with t as (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\s,]+'),
  lambda t: substr(regexp_replace(lower(regexp_replace(t, '^#+', '')), '[^\p{L}\p{N}_-]+', '', 'g'), 1, 40)), lambda t: t <> '') as ts from documents),
f as (select doc_id, tag, min(pos) as pos from (select doc_id, unnest(ts) as tag, unnest(range(1, len(ts) + 1)) as pos from t) group by all),
k as (select *, row_number() over (partition by doc_id order by pos) as rn from f),
j as (select doc_id, string_agg(tag, ',' order by pos) as tags from k where rn <= 20 group by doc_id)
select d.doc_id, coalesce(j.tags, '') as tags from documents d left join j on j.doc_id = d.doc_id""",
    "search_filter_only": with_views(
        """select user_id, link_id, canonical_url, saved_at from links l where status = 'queued' and exists (select 1 from link_tags t where t.link_id = l.link_id and t.tag = 't3')
and (canonical_url ilike 'https://example.com/%' or canonical_url ilike 'https://example.com:%' or canonical_url ilike 'https://%.example.com/%' or lower(site_name) = 'example.com')""",
        "links", "link_tags",
    ),
    "search_bm25": SEARCH_BM25,
    "page_metadata": r"""select page_id, case when trim(t) <> '' then trim(regexp_replace(t, '\s+', ' ', 'g')) end as title, null::varchar as description, null::varchar as site_name,
null::varchar as author, null::varchar as image_url, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/favicon.ico' as favicon_url, null::varchar as canonical_url
from (select *, replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&amp;', '&') as t from pages)""",
    "extract_article": f"""with a as (select page_id, regexp_split_to_array(regexp_extract(html, '<article\\b[^>]*>(.*)</article>', 1, 'is'),
  '(?i)</?(?:p|div|li|h[1-6]|pre|blockquote|tr|table|ul|ol|section|figure|br)\\b[^>]*>') as pieces from pages),
b as (select page_id, array_to_string(list_filter(list_transform(pieces, lambda p: {strip_tags_sql('p')}), lambda p: p <> ''), chr(10) || chr(10)) as text from a)
select page_id, text, len(regexp_extract_all(text, '\\S+')) as words from b""",
    "feed_parse": r"""with t as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as plain, concat_ws(' ', 'Post', doc_id, source) as title from documents)
select doc_id as feed_id, 'g' || doc_id as guid, 'https://example.com/p/' || doc_id as url, title,
case when length(plain) > 400 then regexp_replace(substr(plain, 1, 400), '\s+\S*$', '') || '…' else plain end as summary,
timestamp '2024-01-01 00:30:00' + to_hours(doc_id % 10) as published_at from t""",
    "opml_roundtrip": with_views("select user_id, f.url, coalesce(title_override, title, f.url) as title, folder from subs s join feeds f on f.feed_id = s.feed_id", "subs", "feeds"),
    "reading_sessions": """with marks as (select user_id, ts, case when ts <= lag(ts) over w + interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
numbered as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from marks)
select user_id, min(ts) as start, max(ts) + interval 30 minute as end, count(*) as events from numbered group by user_id, k""",
    "kept_entries": with_views(
        f""", k as (select user_id, source_entry_id as entry_id, max(link_id) as link_id from links where source_entry_id is not null group by all)
select s.user_id, s.entry_id, k.link_id, k.link_id is null as made, coalesce(s.read_at, timestamp '{NOW}') as read_at from state s left join k on k.user_id = s.user_id and k.entry_id = s.entry_id
where s.opened_at is not null and s.cited_at is not null""",
        "state", "links",
    ),
    "imported_feeds": with_views("select u.user_id, f.range as feed_id from users u, range(10) f where u.user_id % 3 = 0 and not exists (select 1 from subs s where s.user_id = u.user_id and s.feed_id = f.range)", "users", "subs"),
    "upserted_feeds": with_views("select coalesce(f.feed_id, r.range) as feed_id, case when r.range % 2 = 0 then 'New ' || r.range else f.title end as title from feeds f full join range(4, 11) r on r.range = f.feed_id", "feeds"),
    "refreshed_feeds": with_views(
        f""", latest as (select feed_id, max(published_at) as latest from entries group by feed_id),
a as (select f.feed_id, error_count, ['unchanged', 'changed', 'failed'][f.feed_id % 3 + 1] as outcome, (epoch_us(timestamp '{NOW}') - epoch_us(latest)) / 60000000.0e0 as age from feeds f left join latest l on l.feed_id = f.feed_id)
select feed_id, outcome, cast(case when outcome = 'failed' then error_count + 1 else 0 end as bigint) as errors,
cast(case when outcome = 'failed' then least(1440, 60 * pow(2, least(error_count + 1, 10))) when age < 1440 then 30 when age < 10080 then 60 when age < 43200 then 180 else 360 end as bigint) as wait from a""",
        "feeds", "entries",
    ),
    "refresh_totals": with_views(f"select (select count(*) from entries e join feeds f on f.feed_id = e.feed_id where e.created_at >= {SINCE.format(1)}) as new_posts, count(case when feed_id % 3 = 2 then 1 end) as failed from feeds", "entries", "feeds"),
    "saved_categories": with_views("select user_id, entry_id, primary_slug from item_categories where corrected and primary_slug <> 'c4'", "item_categories"),
    "drafted_slugs": with_views(
        """, m as (select user_id, link_id, case when link_id % 7 = 0 then 'other' else 'topic-' || (link_id % 3) end as slug from links),
r as (select *, row_number() over (partition by user_id, slug order by link_id) + case when slug = 'other' then 1 else 0 end as nth, row_number() over (partition by user_id order by link_id) as rn from m)
select user_id, link_id, case when nth > 1 then slug || '-' || nth else slug end as slug from r where rn <= 30""",
        "links",
    ),
    "placed_inbox": with_views(
        INBOX.format(where="") + """ select p.user_id, p.entry_id, coalesce(concat_ws(',', c.primary_slug, c.secondary_slug), '') as categories, coalesce(k.p_keep >= 0.5e0, false) as candidate, coalesce(p.link_id, -1) as link_id
from page p left join item_categories c on c.user_id = p.user_id and c.entry_id = p.entry_id left join predictions k on k.error is null and k.user_id = p.user_id and k.entry_id = p.entry_id""",
        *INBOX_VIEWS, "item_categories", "predictions",
    ),
    "queue_page": with_views("select link_id, saved_at from links where status = 'queued' order by saved_at desc, link_id desc limit 10 offset 5", "links"),
    "check_summary": with_views(
        """, r as (select entry_id, title, 'c' || (entry_id % 4) as slug, ((entry_id * 7919) % 1000) / 1000.0e0 < 0.5e0 as unsure from entries),
k as (select *, row_number() over (partition by slug order by entry_id) as rn from r)
select slug, count(*) as n, count(case when unsure then 1 end) as unsure, string_agg(title, ' | ' order by rn) filter (where rn <= 3) as examples from k group by slug""",
        "entries",
    ),
    "settled_budget": f"""with recursive c as (select event_id, ts, cast(ceil(value) as bigint) as asked, case when event_type = 'error' then 0 else cast(ceil(ceil(value) * 1000 * 8182 / 1000000.0e0) as bigint) end as cost from events),
s as (select event_id, ts as moment, 0 as o, asked as d from c union all select event_id, ts + interval 30 minute, 1, cost - asked from c where cost <> asked),
p as (select cast(moment as date) as day, o, d, row_number() over (partition by cast(moment as date) order by moment, o, event_id) as k from s),
run as (select distinct day, cast(0 as bigint) as k, cast(null as bigint) as neurons, 0 as calls from p
  union all select p.day, p.k, case when o = 1 then greatest(0, neurons + d) + 0 * neurons when coalesce(neurons, 0) + d <= 20000 then coalesce(neurons, 0) + d else neurons end,
    calls + cast(o = 0 and coalesce(neurons, 0) + d <= 20000 as int) from run join p on p.day = run.day and p.k = run.k + 1)
select day, arg_max(neurons, k) as neurons, cast(max(calls) as bigint) as calls from run where neurons is not null group by day""",
    "reader_states": with_views(
        f""", both_states as (
  select s.user_id, e.feed_id, s.opened_at, s.dismissed_at from state s join entries e on e.entry_id = s.entry_id union all select user_id, feed_id, opened_at, dismissed_at from history),
r as (select user_id, feed_id, count(case when opened_at is not null then 1 end) as o, count(case when opened_at is null and dismissed_at is not null then 1 end) as d
  from both_states where coalesce(opened_at, dismissed_at) >= {SINCE.format(90)} group by all),
k as (select *, row_number() over (partition by user_id order by o + d desc, feed_id) as rn from r)
select user_id, string_agg('- feed ' || feed_id || ': opened ' || o || ' of ' || (o + d), chr(10) order by rn) as state from k where rn <= 30 group by user_id""",
        "state", "entries", "history",
    ),
    "triage": with_views("select user_id, case event_type when 'click' then 'later' when 'purchase' then 'star' when 'error' then 'dismiss' else 'read' end as action, count(*) as n from actions group by all", "actions"),
    "highlights_of": with_views(
        """select h.user_id, h.entry_id, h.highlight_id, row_number() over (partition by h.user_id, h.entry_id order by h.block, h.created_at, h.highlight_id) as place from highlights h join entries e on e.entry_id = h.entry_id
where exists (select 1 from subs s where s.user_id = h.user_id and s.feed_id = e.feed_id) and not exists (select 1 from state st where st.user_id = h.user_id and st.entry_id = h.entry_id and st.dismissed_at is not null)""",
        "highlights", "entries", "subs", "state",
    ),
    "place_labels": with_views(
        """select p.user_id, p.entry_id, cast(round(progress * 100) as int) || '%' as label, cast(case when progress >= 1 then 0 else greatest(1, ceil(words * (1 - progress) / 230)) end as bigint) as minutes
from places p join entries e on e.entry_id = p.entry_id""",
        "places", "entries",
    ),
    "token_hashes": with_views("select user_id, sha256('qt_' || user_id) as hash from users", "users"),
    "link_json": with_views(
        """, ts as (select link_id, list(tag order by tag) as tags from link_tags group by link_id)
select link_id, cast(to_json({'id': link_id, 'url': url, 'tags': tags, 'starred': is_reference}) as varchar) as json from links left join ts using (link_id)""",
        "links", "link_tags",
    ),
    "entry_links": with_views(
        """, posts as (select entry_id, 'https://feed.example.com/' || (entry_id % 97) as url, entry_date from entries),
found as (select l.link_id, p.entry_id, p.entry_date, case when p.entry_id = l.source_entry_id then 0 else 1 end as how
  from links l join posts p on p.entry_id = l.source_entry_id or p.url = 'https://feed.example.com/' || (l.link_id % 211))
select link_id, entry_id, how = 0 as by_source from (select *, row_number() over (partition by link_id order by how, entry_date desc, entry_id desc) as rn from found) where rn = 1""",
        "entries", "links",
    ),
    "save_links": with_views(
        f""", saved as (select user_id, canonical_url, link_id, note, status, saved_at from links where link_id % 2 = 0),
incoming as (select user_id, canonical_url, link_id as in_id, case when link_id % 12 = 0 then 'NOTE  0' else 'new ' || link_id end as new_note from links where link_id % 3 = 0)
select user_id, canonical_url, coalesce(link_id, in_id) as link_id, case when in_id is null then note when note is null then new_note
  when contains(lower(regexp_replace(note, '\\s+', ' ', 'g')), lower(regexp_replace(new_note, '\\s+', ' ', 'g'))) then note else note || chr(10) || chr(10) || new_note end as note,
case when in_id is not null then 'queued' else status end as status, case when in_id is not null then timestamp '{NOW}' else saved_at end as saved_at, link_id is null as made
from saved full join incoming using (user_id, canonical_url)""",
        "links",
    ),
    "capture_archives": with_views(
        """, rows as (select a.link_id, a.attempts, coalesce(e.words, 0) as feed, [200, 200, 200, 404, 503, 429, 200, 403][a.link_id % 8 + 1] as code
  from archives a join links l on l.link_id = a.link_id left join entries e on e.entry_id = l.source_entry_id where a.status <> 'ready'),
p as (select *, case when code = 200 then (link_id * 53) % 300 else 0 end as page from rows),
s as (select *, case when feed >= 100 then 'feed' when page >= 100 then 'page' when feed > 0 then 'feed' end as source from p)
select link_id, case when source is null then 'failed' else 'ready' end as status, source, cast(case source when 'feed' then feed when 'page' then page end as bigint) as words,
cast(case when source is null and not (code >= 500 or code in (408, 429)) then 3 else attempts end as bigint) as attempts from s""",
        "archives", "links", "entries",
    ),
    "keep_until": with_views(f"select link_id, case when not (status = 'queued' or is_reference) then timestamp '{NOW}' + interval 14 day end as keep_until from links", "links"),
    "last_places": with_views("select user_id, entry_id, block, round(progress, 6) as progress, updated_at from places", "places"),
    "undone_log": with_views(
        """, m as (select *, lead(event_type) over (partition by user_id order by stamp, event_id) as next from actions where event_type in ('purchase', 'signup'))
select user_id, count(*) as stars, count(case when next = 'signup' then 1 end) as undone from m where event_type = 'purchase' group by user_id""",
        "actions",
    ),
    "correction_examples": with_views(
        """select user_id, entry_id, title, primary_slug as category from (select c.user_id, c.entry_id, e.title, c.primary_slug,
  row_number() over (partition by c.user_id order by e.entry_date desc, c.entry_id desc) as rn from item_categories c join entries e on e.entry_id = c.entry_id where c.corrected and e.title is not null) where rn <= 10""",
        "item_categories", "entries",
    ),
    "item_texts": with_views(
        """, t as (select l.link_id, l.title, l.note, regexp_extract_all(e.content, '\\S+') as ws from links l left join entries e on e.entry_id = l.source_entry_id where l.status = 'queued')
select link_id, title, concat_ws(chr(10), note, array_to_string(ws[1:120], ' ') || case when len(ws) > 120 then ' …' else '' end) as text from t""",
        "links", "entries",
    ),
    "batches": with_views(
        """, r as (select user_id, title, site_name, row_number() over (partition by user_id order by saved_at desc, link_id desc) as rn from links where status = 'queued')
select user_id, cast(floor((rn - 1) / 20.0e0) as bigint) as batch, string_agg('[' || ((rn - 1) % 20 + 1) || '] ' || title || ' (' || site_name || ')', chr(10) order by rn) as state, count(*) as items from r group by all""",
        "links",
    ),
    "read_entries": """with t as (select doc_id, text, trim(regexp_replace(text, '\\s+', ' ', 'g')) as plain from documents)
select doc_id as entry_id, least(length(text), 30000) as chars, length(text) > 30000 as truncated,
case when plain = '' then null when length(plain) > 400 then regexp_replace(substr(plain, 1, 400), '\\s+\\S*$', '') || '…' else plain end as summary from t""",
    "suggestion_sample": with_views(
        """select user_id, kind, id from (
  select s.user_id, 'post' as kind, e.entry_id as id, row_number() over (partition by s.user_id order by e.entry_date desc, e.entry_id desc) as rn, 25 as most from entries e join subs s on s.feed_id = e.feed_id
  union all select user_id, 'link', link_id, row_number() over (partition by user_id order by starred_at desc, link_id desc), 15 from links where is_reference) where rn <= most""",
        "entries", "subs", "links",
    ),
    "claimed_canonicals": f"""with c as (select page_id, url, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '^www\\.', '') as site,
  regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) as path from pages),
k as (select page_id, case when page_id % 3 = 0 then url when page_id % 4 = 0 then case when path in ('', '/') then 'https://' || site || '/' else url end else 'http://www.' || site || '/same?utm_x=1' end as url from c)
select page_id, {canonical_sql('url')} as canonical_url from k""",
    "parsed_answers": """select event_id, case when event_id % 4 < 3 and value / 400 between 0 and 1 then round(value / 400, 9) end as p from events""",
    "new_users": """with e as (select 'u' || user_id || '@example.com' as email, ts, event_id from events)
select email, min(ts) as created_at from e where event_id % 97 >= 3 and email not in (select email from e where event_id % 97 < 3) group by email""",
    "long_posts": with_views("select feed_id, cast(sum(words) as bigint) as words, cast(sum(case when words >= 1035 then words else 0 end) as bigint) as long_words from entries group by feed_id", "entries"),
}


QUERIES.update(formats.QUERIES)
QUERIES.update(searches.QUERIES)
QUERIES.update(changes.QUERIES)
QUERIES.update(merges.QUERIES)
ORACLES.update(formats.ORACLES)
ORACLES.update(searches.ORACLES)
ORACLES.update(changes.ORACLES)
ORACLES.update(merges.ORACLES)
ORACLES["dispatch_counts"] = f"select status, coalesce(source, 'none') as source, count(*) as n from ({ORACLES['capture_archives']}) group by all"
ORACLES["stream_fold_entry_state"] = ORACLES["fold_entry_state"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, plan=plan: plan(Views(spark, sf_dir))) for name, plan in QUERIES.items()}
