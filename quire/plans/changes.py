"""Edits, their log and undo as queries, with SQL that replays a page's events one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.changelog import FIELDS, flat, logged
from quire.plans.views import Views, with_views


def tables(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, edits by users of their own pages, and undos: events number what is edited, a purchase takes the user's last action back, whatever it was."""
    tags = v.link_tags.groupBy("link_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    pages = v.links.join(tags, "link_id", "left").select("link_id", "user_id", "note", "status", F.col("is_reference").alias("reference"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    k, kind = F.col("event_id"), F.col("event_type")
    marked = v.raw("events").select("user_id", "event_id", "event_type", F.col("ts").alias("at"), F.floor(k / 2).cast("long").alias("action_id"))
    both = marked.where("event_type <> 'purchase'").join(v.links.select("user_id", "link_id"), "user_id").where((F.col("event_id") + F.col("link_id")) % 2 == 0)
    text = F.concat(F.lit("n"), (k % 5).cast("string"))
    edits = both.select(
        (k * 100_000 + F.col("link_id")).alias("event_id"), "action_id", "link_id", "user_id", "at", F.when((kind == "click") & (k % 4 == 0), text).alias("note"), F.when((kind == "click") & (k % 4 != 0), text).alias("more"),
        F.when(kind == "view", F.when(k % 3 == 0, "archived").otherwise("queued")).alias("status"), F.when(kind == "error", k % 2 == 0).alias("reference"), F.when(kind == "signup", F.concat(F.lit("#T1 x"), (k % 3).cast("string"))).alias("tags"),
    )
    undos = marked.where("event_type = 'purchase'").select("user_id", (k * 100_000).alias("event_id"), "at")
    # the last action before each undo, by one order of a user's edits and undos: at equal times the undo comes first
    seen = edits.select("user_id", "at", "action_id").where("at is not null").distinct()
    both = undos.select("user_id", "at", "event_id").where("at is not null").distinct().unionByName(seen, allowMissingColumns=True)
    earlier = Window.partitionBy("user_id").orderBy("at", F.col("event_id").isNull(), "action_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    latest = both.withColumn("action_id", F.last("action_id", True).over(earlier)).where("event_id is not null and action_id is not null")
    return pages, edits, latest


def edited_pages(v: Views) -> DataFrame:
    """Every page after all edits and undos."""
    return logged(*tables(v))[0]


def edit_log(v: Views) -> DataFrame:
    """Every edit and undo with what stood before and after it."""
    return flat(logged(*tables(v))[1])


QUERIES = {"edited_pages": edited_pages, "edit_log": edit_log}

PAGE = "{'note': note, 'status': status, 'reference': reference, 'tags': tags}"
STEPS = """, pages0 as (select l.link_id, l.user_id, l.note, l.status, l.is_reference as reference, coalesce(t.tags, '') as tags from links l left join (select link_id, array_to_string(list_sort(list(tag)), ',') as tags from link_tags group by link_id) t using (link_id)),
marked as (select *, ts as moment, event_id // 2 as action_id from events),
edits as (select m.event_id * 100000 + l.link_id as event_id, action_id, l.link_id, m.user_id, moment, event_type as kind, m.event_id as k from marked m join links l using (user_id) where event_type <> 'purchase' and (m.event_id + l.link_id) % 2 = 0),
undos as (select u.event_id * 100000 as event_id, u.user_id, u.moment, arg_max(e.action_id, (e.moment, e.action_id)) as action_id from marked u join edits e on e.user_id = u.user_id and e.moment < u.moment where u.event_type = 'purchase' group by all),
valid as (select u.* from undos u join (select action_id, user_id, max(moment) as done from edits group by all) d using (action_id, user_id) where u.moment > d.done qualify row_number() over (partition by action_id order by u.moment, u.event_id) = 1),
all_events as (select link_id, event_id, action_id, moment, kind, k, cast(null as bigint) as back_to from edits
  union all select t.link_id, u.event_id, u.action_id, u.moment, 'undo', 0, t.back_to from valid u join (select action_id, link_id, arg_min(event_id, (moment, event_id)) as back_to from edits group by all) t using (action_id)),
numbered as (select *, row_number() over (partition by link_id order by moment, event_id) as nth from all_events),
steps as (select a.*, b.nth as back_nth from numbered a left join numbered b on b.link_id = a.link_id and b.event_id = a.back_to),
run as (select link_id, cast(0 as bigint) as nth, cast(null as bigint) as event_id, '' as kind, """ + PAGE + """ as state, [""" + PAGE + """] as held from pages0
  union all select link_id, nth, event_id, kind, state, list_append(held, state) from (
    select r.link_id, s.nth, s.event_id, s.kind, r.held, case when s.kind = 'undo' then r.held[s.back_nth] else {
      'note': case when s.kind = 'click' and (k % 4 = 0 or coalesce(r.state.note, '') = '') then 'n' || k % 5 when s.kind = 'click' and not contains(lower(regexp_replace(r.state.note, '\\s+', ' ', 'g')), 'n' || k % 5) then r.state.note || chr(10) || chr(10) || 'n' || k % 5 else r.state.note end,
      'status': case when s.kind = 'view' then case when k % 3 = 0 then 'archived' else 'queued' end else r.state.status end,
      'reference': case when s.kind = 'error' then k % 2 = 0 else r.state.reference end,
      'tags': case when s.kind = 'signup' then 't1,x' || k % 3 else r.state.tags end} end as state
    from run r join steps s on s.link_id = r.link_id and s.nth = r.nth + 1))
"""
CHANGED = " || ".join(f"case when a.{f} is distinct from b.{f} then '{f}, ' else '' end" for f in FIELDS)
SIDES = ", ".join(f"{a}.{f} as {f}_{side}" for side, a in (("before", "b"), ("after", "a")) for f in FIELDS)
HEAD = with_views(STEPS, "links", "link_tags").replace("with ", "with recursive ", 1)
ORACLES = {
    "edited_pages": HEAD + "select link_id, s.note, s.status, s.reference, s.tags from (select link_id, arg_max(state, nth) as s from run group by link_id)",
    "edit_log": HEAD + f"""select event_id, link_id, action, undone, {SIDES}, rtrim({CHANGED}, ', ') as changed from (
  select r.event_id, r.link_id, case when r.kind = 'undo' then 'undo' else 'link.update' end as action, r.kind <> 'undo' and exists (select 1 from valid v join edits e on e.action_id = v.action_id where e.event_id = r.event_id) as undone,
    r.held[r.nth] as b, r.state as a from run r where r.nth > 0)""",
}
