"""Upserts as queries: a stored table that incoming rows are merged into, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.plans.views import Views, with_views
from quire.sources.buckets import Buckets, Rule, absent_only, filled
from quire.sources.scratch import scratch

TURN = "timestamp_ntz'2024-01-16 00:00:00'"


def merged(v: Views, state: DataFrame, incoming: DataFrame, keys: list[str], rule: Rule) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)
    table = Buckets(v.spark, f"{scratch(v.spark)}/merge-{uuid.uuid4().hex}", keys, schema, 16)
    table.merge(state, "state")
    table.merge(incoming, "incoming", rule)
    return table.read()


def site_details(v: Views) -> DataFrame:
    """What is known of the sites of saved pages: details of pages saved later replace those of earlier ones, unless they are empty."""
    latest = lambda c: F.max_by(c, F.struct("saved_at", "link_id")).alias(c)
    told = lambda rows: rows.groupBy("site_name").agg(latest("author"), latest("description"))
    return merged(v, told(v.links.where(f"saved_at < {TURN}")), told(v.links.where(f"saved_at >= {TURN}")), ["site_name"], filled)


def imported_follows(v: Views) -> DataFrame:
    """Follows after an import of the feeds of all posts that a user did something with: those that are there keep their folder and title."""
    state = v.subscriptions.select("user_id", "feed_id", "folder", "title_override", "followed_at")
    seen = v.actions.join(v.entries.select("entry_id", "feed_id"), "entry_id").where("feed_id is not null").groupBy("user_id", "feed_id").agg(F.min("stamp").alias("followed_at"))
    listed = seen.select("user_id", "feed_id", F.lit("imported").alias("folder"), F.lit(None).cast("string").alias("title_override"), "followed_at")
    return merged(v, state, listed, ["user_id", "feed_id"], absent_only)


def provisioned_users(v: Views) -> DataFrame:
    """Accounts by e-mail: the first sign-in makes one, later ones leave it as it is."""
    named = v.raw("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"), "ts", "event_type")
    made = lambda rows: rows.groupBy("email").agg(F.min("ts").alias("created_at"))
    return merged(v, made(named.where("event_type = 'signup'")), made(named.where("event_type = 'view'")), ["email"], absent_only)


QUERIES = {"site_details": site_details, "imported_follows": imported_follows, "provisioned_users": provisioned_users}
ORACLES = {
    "site_details": with_views(
        """, told as (select site_name, saved_at >= timestamp '2024-01-16' as late, arg_max_null(author, (saved_at, link_id)) as author, arg_max_null(description, (saved_at, link_id)) as description from links group by all)
select site_name, coalesce(max(case when late then author end), max(case when not late then author end)) as author, coalesce(max(case when late then description end), max(case when not late then description end)) as description from told group by site_name""",
        "links",
    ),
    "imported_follows": with_views(
        """select user_id, feed_id, folder, title_override, followed_at from subs
union all select a.user_id, e.feed_id, 'imported', null, min(a.stamp) from actions a join entries e using (entry_id) where e.feed_id is not null and not exists (select 1 from subs s where s.user_id = a.user_id and s.feed_id = e.feed_id) group by a.user_id, e.feed_id""",
        "subs", "actions", "entries",
    ),
    "provisioned_users": """select 'u' || user_id || '@example.com' as email, coalesce(min(case when event_type = 'signup' then ts end), min(ts)) as created_at from events where event_type in ('signup', 'view') group by user_id""",
}
