"""More state changes and reports: keeping posts, imports, feed refreshes, categories, budget settlements, model states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.display import slug
from quire.functions.markup import block_text, minutes_left, percent, spoken, token_hash
from quire.operators.jobs import backoff_minutes, neurons, poll_minutes
from quire.operators.ledger import CORRECT, RESERVE, ledger
from quire.operators.reading import inbox_posts, top_per
from quire.plans.views import Views, days_ago, now

RESERVED, MAX_CATEGORIES = "other", 30


def kept_entries(v: Views) -> DataFrame:
    """Keeping opened and cited posts: those with a link are queued again, others get a new link; all are read."""
    wanted = v.entry_state.where("opened_at is not null and cited_at is not null").select("user_id", "entry_id", "read_at")
    links = v.links.where("source_entry_id is not null").groupBy("user_id", F.col("source_entry_id").alias("entry_id")).agg(F.max("link_id").alias("link_id"))
    return wanted.join(links, ["user_id", "entry_id"], "left").select("user_id", "entry_id", "link_id", F.col("link_id").isNull().alias("made"), F.coalesce("read_at", now()).alias("read_at"))


def imported_feeds(v: Views) -> DataFrame:
    """Insert-if-absent of a list of ten feeds for every third user: follows to add."""
    listed = v.users.where("user_id % 3 = 0").withColumn("feed_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    return listed.join(v.subscriptions.select("user_id", "feed_id"), ["user_id", "feed_id"], "left_anti")


def upserted_feeds(v: Views) -> DataFrame:
    """Feed details after a fetch: only non-empty new ones replace old ones; unknown feeds are added."""
    fresh = v.spark.range(4, 11).select(F.col("id").alias("feed_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("New "), F.col("id").cast("string"))).otherwise("").alias("new_title"))
    return v.feeds.select("feed_id", "title").join(fresh, "feed_id", "full_outer").select("feed_id", F.coalesce(F.nullif("new_title", F.lit("")), "title").alias("title"))


def refreshed_feeds(v: Views) -> DataFrame:
    """Schedule after a poll: unchanged and changed feeds lose their errors and wait by their newest post, failed ones back off."""
    outcome = F.element_at(F.array(*map(F.lit, ("unchanged", "changed", "failed"))), (F.col("feed_id") % 3 + 1).cast("int"))
    latest = v.entries.groupBy("feed_id").agg(F.max("published_at").alias("latest"))
    rows = v.feeds.withColumn("outcome", outcome).join(latest, "feed_id", "left")
    failed = F.col("outcome") == "failed"
    return rows.select(
        "feed_id", "outcome", F.when(failed, F.col("error_count") + 1).otherwise(0).cast("long").alias("errors"), F.when(failed, backoff_minutes(F.col("error_count"))).otherwise(poll_minutes(F.col("latest"))).alias("wait")
    )


def refresh_totals(v: Views) -> DataFrame:
    """New posts of the last day and failed feeds over all feeds."""
    fresh = v.entries.where(F.col("created_at") >= days_ago(1)).groupBy("feed_id").agg(F.count("*").alias("n"))
    rows = refreshed_feeds(v).join(fresh, "feed_id", "left")
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("new_posts"), F.count_if(F.col("outcome") == "failed").alias("failed"))


def saved_categories(v: Views) -> DataFrame:
    """Placements that outlive new rules: corrected ones whose category is still there (c4 goes)."""
    return v.item_categories.where(F.col("corrected") & (F.col("primary_slug") != "c4")).select("user_id", "entry_id", "primary_slug")


def free_slugs(slugs: Column) -> Column:
    """The slugs in order, each with the first of -2, -3, ... that is still free; what is reserved is taken from the start."""

    def take(taken: Column, wanted: Column) -> Column:
        more = F.transform(F.sequence(F.lit(2), F.size(taken) + 2), lambda n: F.concat(F.substring(wanted, 1, 36), F.lit("-"), n.cast("string")))
        return F.concat(taken, F.array(F.filter(F.concat(F.array(wanted), more), lambda s: ~F.array_contains(taken, s))[0]))

    return F.slice(F.aggregate(slugs, F.array(F.lit(RESERVED)), take), 2, F.size(slugs))


def drafted_slugs(v: Views) -> DataFrame:
    """Slugs of category drafts, unique by user; "other" is taken, so it gets a number at once."""
    names = v.links.select("user_id", "link_id", F.when(F.col("link_id") % 7 == 0, F.lit("Other")).otherwise(F.concat(F.lit("Topic "), (F.col("link_id") % 3).cast("string"))).alias("name"))
    few = top_per(names, ["user_id"], [F.asc("link_id")], MAX_CATEGORIES).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("link_id", slug(F.col("name")).alias("slug")))).alias("drafts"))
    named = F.arrays_zip(F.col("drafts.link_id").alias("link_id"), free_slugs(F.col("drafts.slug")).alias("slug"))
    return few.select("user_id", F.inline(named))


def placed_inbox(v: Views) -> DataFrame:
    """The inbox with categories (first and second) and the predicted chance of keeping; library candidates are marked."""
    keys = ["user_id", "entry_id"]
    placed = v.item_categories.select(*keys, F.array_compact(F.array("primary_slug", "secondary_slug")).alias("slugs"))
    chances = v.predictions.where("error is null").select(*keys, "p_keep")
    rows = inbox_posts(v).join(placed, keys, "left").join(chances, keys, "left")
    return rows.select(*keys, F.coalesce(F.array_join("slugs", ","), F.lit("")).alias("categories"), F.coalesce(F.col("p_keep") >= 0.5, F.lit(False)).alias("candidate"), F.coalesce("link_id", F.lit(-1)).alias("link_id"))


def queue_page(v: Views, offset: int = 5, limit: int = 10) -> DataFrame:
    """The second page of the queue over all users: newest saved first."""
    return v.links.where("status = 'queued'").orderBy(F.desc("saved_at"), F.desc("link_id")).offset(offset).limit(limit).select("link_id", "saved_at")


def check_summary(v: Views) -> DataFrame:
    """A check of made placements by category: how many, how many unsure (likeliest under a half), first titles."""
    share = (F.col("entry_id") * 7919 % 1000) / F.lit(1000.0)
    first = F.concat(F.lit("c"), (F.col("entry_id") % 4).cast("string"))
    rows = v.entries.select("entry_id", "title", first.alias("slug"), (share < 0.5).alias("unsure"))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("slug").orderBy("entry_id")))
    titles = F.array_sort(F.collect_list(F.when(F.col("rn") <= 3, F.struct("rn", "title"))))
    return rows.groupBy("slug").agg(F.count("*").alias("n"), F.count_if("unsure").alias("unsure"), F.array_join(F.transform(titles, lambda t: t["title"]), " | ").alias("examples"))


def settled_budget(v: Views, minutes: int = 30, cap: int = 20_000) -> DataFrame:
    """Neurons and calls by day: what a call is thought to cost is reserved under the cap, and corrected on the day it ends when that is known.

    The log has a correction of every call that cost something else.
    """
    asked = F.ceil("value").cast("long")
    cost = F.when(F.col("event_type") == "error", 0).otherwise(neurons(asked * 1000, "small")).cast("long")
    step = lambda at, kind, amount: F.struct(at.alias("at"), F.lit(kind).alias("rank"), F.lit(kind).alias("kind"), amount.alias("amount"))
    ends = F.col("ts") + F.make_dt_interval(mins=F.lit(minutes))
    steps = v.raw("events").select(F.col("event_id").alias("id"), F.inline(F.array(step(F.col("ts"), RESERVE, asked), step(ends, CORRECT, cost - asked))))
    steps = steps.where((F.col("kind") == RESERVE) | (F.col("amount") != 0)).withColumn("day", F.to_date("at"))
    return ledger(steps, cap).select("day", "neurons", "calls")


def reader_states(v: Views) -> DataFrame:
    """The reader's profile as text for a model: the feeds that they open most."""
    from quire.operators.reading import feed_open_rates

    active = top_per(feed_open_rates(v).withColumn("n", F.col("n_opened") + F.col("n_skipped")), ["user_id"], [F.desc("n"), F.asc("feed_id")], 30)
    line = F.concat(F.lit("- feed "), F.col("feed_id").cast("string"), F.lit(": opened "), F.col("n_opened").cast("string"), F.lit(" of "), F.col("n").cast("string"))
    lines = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "feed_id", line.alias("line"))))
    return active.groupBy("user_id").agg(F.array_join(F.transform(lines, lambda s: s["line"]), "\n").alias("state"))


def triage(v: Views) -> DataFrame:
    """What triage actions map to, counted: later, star, dismiss, read."""
    action: Column = F.when(F.col("event_type") == "click", "later").when(F.col("event_type") == "purchase", "star").when(F.col("event_type") == "error", "dismiss").otherwise("read")
    return v.actions.groupBy("user_id", action.alias("action")).agg(F.count("*").alias("n"))


def dispatch_counts(v: Views) -> DataFrame:
    """Outcomes of archive jobs by status."""
    from quire.operators.edits import capture_archives

    return capture_archives(v).groupBy("status", F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("n"))


def highlights_of(v: Views) -> DataFrame:
    """Highlights of posts that are followed and undismissed, with their place in the post by block and time."""
    keys = ["user_id", "entry_id"]
    dismissed = v.entry_state.where("dismissed_at is not null").select(*keys)
    shown = v.highlights.join(v.entries.select("entry_id", "feed_id"), "entry_id").join(v.subscriptions.select("user_id", "feed_id"), ["user_id", "feed_id"], "left_semi").join(dismissed, keys, "left_anti")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("block", "created_at", "highlight_id"))
    return shown.select(*keys, "highlight_id", place.cast("long").alias("place"))


def page_block_text(v: Views) -> DataFrame:
    return v.raw("pages").select("page_id", block_text(F.col("html")).alias("text"))


def place_labels(v: Views) -> DataFrame:
    """Progress labels and minutes left of reading places."""
    rows = v.places.join(v.entries.select("entry_id", "words"), "entry_id")
    return rows.select("user_id", "entry_id", percent(F.col("progress")).alias("label"), minutes_left(F.col("words"), F.col("progress")).alias("minutes"))


def spoken_posts(v: Views) -> DataFrame:
    pieces = spoken(F.col("content"))
    return v.entries.select("entry_id", F.size(pieces).cast("long").alias("pieces"), F.array_max(F.transform(pieces, lambda p: F.length(p))).cast("long").alias("longest"))


def token_hashes(v: Views) -> DataFrame:
    return v.users.select("user_id", token_hash(F.concat(F.lit("qt_"), F.col("user_id").cast("string"))).alias("hash"))
