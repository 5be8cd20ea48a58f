"""Background jobs: candidates for scoring, retention, archives, polling, state changes, the budget ledger, placements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.ledger import RESERVE, last_writes, ledger
from quire.operators.reading import handled, newest_left, top_per
from quire.plans.views import Views, days_ago, now

BUDGET = 2000
RATE_PER_MILLION = {"small": 8182, "large": 21818}


def hours_ago(n: Column) -> Column:
    return now() - F.make_dt_interval(hours=n.cast("int"))


def blocking(predictions: DataFrame) -> DataFrame:
    """The predictions that stand: a failed one only until its wait is over, an hour for each attempt, three attempts at most."""
    return predictions.where(F.col("error").isNull() | (F.col("attempts") >= 3) | (F.col("updated_at") > hours_ago(F.col("attempts"))))


def newest_candidates(v: Views, posts_gone: DataFrame, links: DataFrame, days: int, limit: int) -> DataFrame:
    """(user_id, kind, id, stamp) of unread posts of the last days that are not gone, ``limit`` a feed at least, and of links."""
    recent = v.entries.where(F.col("created_at") >= days_ago(days))
    posts = newest_left(v, recent, limit, handled(v).union(posts_gone).distinct())
    rows = posts.select("user_id", F.lit("post").alias("kind"), F.col("entry_id").alias("id"), F.col("entry_date").alias("stamp"))
    return rows.unionByName(links.select("user_id", F.lit("link").alias("kind"), F.col("link_id").alias("id"), F.col("saved_at").alias("stamp")))


def score_candidates(v: Views, days: int = 7, limit: int = 20) -> DataFrame:
    """The newest ``limit`` over all users: unread posts of the last days and queued links whose copy is there (or an hour late), without a standing prediction."""
    copies = v.links.where("status = 'queued'").join(v.archives.select("link_id", F.col("status").alias("copy")), "link_id", "left")
    ready = F.col("copy").isNull() | F.col("copy").isin("ready", "failed") | (F.col("saved_at") < now() - F.expr("interval '1' hour"))
    links = copies.where(ready).join(blocking(v.link_predictions).select("user_id", "link_id"), ["user_id", "link_id"], "left_anti")
    rows = newest_candidates(v, blocking(v.predictions).select("user_id", "entry_id"), links, days, limit)
    return rows.orderBy(F.desc("stamp"), F.asc("kind"), F.desc("id"), F.asc("user_id")).limit(limit)


def categorize_candidates(v: Views, days: int = 7, limit: int = 20, starred: bool = True) -> DataFrame:
    """By user the newest ``limit`` items without a category: unread posts of the last days, queued and, if asked for, starred links."""
    links = v.links.where("status = 'queued' or is_reference" if starred else "status = 'queued'").join(v.link_categories, ["user_id", "link_id"], "left_anti")
    rows = newest_candidates(v, v.item_categories.select("user_id", "entry_id"), links, days, limit)
    return top_per(rows, ["user_id"], [F.desc("stamp"), F.asc("kind"), F.desc("id")], limit)


def doomed(v: Views, keep: int = 50, days: int = 30, place_days: int = 60) -> DataFrame:
    """Posts to prune: beyond the newest ``keep`` of their feed, old, and without a link, a live reading place or a highlight."""
    ranked = v.entries.select("entry_id", "feed_id", "entry_date").withColumn("rn", F.row_number().over(Window.partitionBy("feed_id").orderBy(F.desc("entry_date"), F.desc("entry_id"))))
    old = ranked.where((F.col("rn") > keep) & (F.col("entry_date") < days_ago(days)))
    links = v.links.where("source_entry_id is not null").select(F.col("source_entry_id").alias("entry_id"))
    places = v.places.where(F.col("updated_at") >= days_ago(place_days)).select("entry_id")
    return old.join(links, "entry_id", "left_anti").join(places, "entry_id", "left_anti").join(v.highlights.select("entry_id"), "entry_id", "left_anti").select("entry_id", "feed_id")


def prune_history(v: Views) -> DataFrame:
    """Outcomes to keep of the doomed posts: opened, cited or dismissed ones that history does not have."""
    some = v.entry_state.where("opened_at is not null or cited_at is not null or dismissed_at is not null")
    rows = some.join(doomed(v), "entry_id").join(v.history.select("user_id", "entry_id"), ["user_id", "entry_id"], "left_anti")
    return rows.select("user_id", "entry_id", "feed_id", "opened_at", "cited_at", "dismissed_at")


def orphan_feeds(v: Views) -> DataFrame:
    """Feeds that nobody follows."""
    return v.feeds.join(v.subscriptions.select("feed_id"), "feed_id", "left_anti").select("feed_id", "url")


def poll_minutes(latest: Column) -> Column:
    """Poll interval by the age of a feed's newest post."""
    age = (F.unix_micros(now().cast("timestamp")) - F.unix_micros(latest.cast("timestamp"))) / F.lit(60_000_000.0)
    return F.when(age < 1440, 30).when(age < 7 * 1440, 60).when(age < 30 * 1440, 180).otherwise(360).cast("long")


def backoff_minutes(errors: Column) -> Column:
    """Wait after one more error: an hour doubled with each, a day at most."""
    return F.least(F.lit(1440), 60 * F.pow(F.lit(2), F.least(errors + 1, F.lit(10)))).cast("long")


def poll_schedule(v: Views) -> DataFrame:
    """Feeds' newest posts and next intervals."""
    latest = v.entries.groupBy("feed_id").agg(F.max("published_at").alias("latest"))
    return v.feeds.join(latest, "feed_id", "left").select("feed_id", "latest", poll_minutes(F.col("latest")).alias("minutes"), backoff_minutes(F.col("error_count")).alias("backoff"))


def due_feeds(v: Views, limit: int = 40) -> DataFrame:
    """Followed feeds whose next fetch is unset or past, unset ones first."""
    due = v.feeds.where(F.col("next_fetch_at").isNull() | (F.col("next_fetch_at") <= now())).join(v.subscriptions.select("feed_id"), "feed_id", "left_semi")
    return due.orderBy(F.asc_nulls_first("next_fetch_at"), "feed_id").limit(limit).select("feed_id", "next_fetch_at")


def claim_archives(v: Views, limit: int = 5) -> DataFrame:
    """Stale third attempts, which fail, and the copies to fetch now: the ``limit`` that were asked for last."""
    stale = (F.col("status") == "fetching") & (F.col("updated_at") < now() - F.expr("interval '10' minute"))
    waited = F.col("updated_at") < hours_ago(F.col("attempts"))
    spent = F.col("attempts") >= 3
    due = (F.col("status") == "pending") | (stale & ~spent) | ((F.col("status") == "failed") & ~spent & waited)
    failed = v.archives.where(stale & spent).select("link_id", F.lit("fail").alias("action"))
    claimed = v.archives.where(due).orderBy(F.desc("updated_at"), F.desc("link_id")).limit(limit)
    return failed.union(claimed.select("link_id", F.lit("claim").alias("action")))


def prune_archives(v: Views) -> DataFrame:
    return v.archives.where(F.col("keep_until") < now()).select("link_id", "keep_until")


def partial_states(actions: DataFrame) -> DataFrame:
    """What some actions on a post by a user amount to; these can be put together in any order and grouping."""
    at = lambda *kinds: F.when(F.col("event_type").isin(*kinds), F.col("stamp"))
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.struct("stamp", "event_id")))
    return actions.groupBy("user_id", "entry_id").agg(
        F.min(at("view")).alias("opened_at"),
        F.min(at("view", "signup", "error")).alias("read_at"),
        last("error").alias("dismissed"),
        last("purchase").alias("undone"),
        F.max(at("click")).alias("cited_at"),
        F.count_if(F.col("event_type") == "click").alias("n_cites"),
    )


def joined_states(partials: DataFrame) -> DataFrame:
    """Partial states of the same user and post as one."""
    first, last = ("opened_at", "read_at"), ("dismissed", "undone", "cited_at")
    return partials.groupBy("user_id", "entry_id").agg(*[F.min(c).alias(c) for c in first], *[F.max(c).alias(c) for c in last], F.sum("n_cites").alias("n_cites"))


def final_states(partials: DataFrame) -> DataFrame:
    """A dismissal stands if the last one came after the last undo."""
    stands = F.col("undone").isNull() | (F.col("dismissed") > F.col("undone"))
    return partials.select("user_id", "entry_id", "opened_at", "read_at", F.when(stands, F.col("dismissed.stamp")).alias("dismissed_at"), "cited_at", "n_cites")


def fold_entry_state(actions: DataFrame) -> DataFrame:
    """Replay actions in the order of (stamp, event_id): opening and reading keep their first time, dismissal and citation their last.

    A purchase stands for an undo here: it clears a dismissal that came before.  The replay needs only minima, maxima and
    a count, so batches of actions can be folded apart and joined.
    """
    return final_states(partial_states(actions))


def mark_backlog(v: Views) -> DataFrame:
    """Posts that a new follower has read from the start: those of their feeds without a state, by user and feed."""
    every = v.entries.groupBy("feed_id").agg(F.count("*").alias("posts"))
    touched = v.entry_state.join(v.entries.select("entry_id", "feed_id"), "entry_id").groupBy("user_id", "feed_id").agg(F.count("*").alias("touched"))
    rows = v.subscriptions.join(every, "feed_id").join(touched, ["user_id", "feed_id"], "left")
    return rows.select("user_id", "feed_id", (F.col("posts") - F.coalesce("touched", F.lit(0))).alias("inserted"))


def mark_all_read(v: Views) -> DataFrame:
    """Posts that "mark all read" changes, by user: unread ones, dismissed or not."""
    read = v.entry_state.where("read_at is not null").join(v.entries.select("entry_id", "feed_id"), "entry_id").join(v.subscriptions.select("user_id", "feed_id"), ["user_id", "feed_id"], "left_semi")
    done = read.groupBy("user_id").agg(F.count("*").alias("done"))
    every = v.entries.groupBy("feed_id").agg(F.count("*").alias("posts"))
    total = v.subscriptions.join(every, "feed_id").groupBy("user_id").agg(F.sum("posts").alias("posts"))
    return total.join(done, "user_id", "left").select("user_id", (F.col("posts") - F.coalesce("done", F.lit(0))).alias("marked"))


def opened_backfill(v: Views) -> DataFrame:
    """Old rows with a read: the time of reading was that of opening, unless it was set otherwise.

    "Done" sets it in the same second as the dismissal, a new feed's backlog within a minute of the post's arrival or of following
    the feed; those keep what they have.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    after = lambda c: micros("read_at") - micros(c) > 60_000_000
    posts = v.entries.select("entry_id", "feed_id", "created_at")
    follows = v.subscriptions.select("user_id", "feed_id", "followed_at")
    rows = v.entry_state.where("read_at is not null").join(posts, "entry_id", "left").join(follows, ["user_id", "feed_id"], "left")
    done = F.coalesce(micros("dismissed_at") - micros("read_at") <= 1_000_000, F.lit(False))
    opened = ~done & F.coalesce(after("created_at"), F.lit(False)) & F.coalesce(after("followed_at"), F.lit(True))
    return rows.select("user_id", "entry_id", F.when(opened, F.col("read_at")).otherwise(F.col("opened_at")).alias("opened_at"))


def neurons(tokens: Column, model: str) -> Column:
    """Cost of tokens, rounded up."""
    return F.ceil(tokens * RATE_PER_MILLION[model] / F.lit(1_000_000.0)).cast("long")


def neuron_costs(v: Views) -> DataFrame:
    """Estimated tokens (four characters each) and costs of sending each post to a model."""
    tokens = F.ceil(F.length("content") / F.lit(4.0)).cast("long")
    return v.entries.select("entry_id", tokens.alias("tokens"), neurons(tokens, "small").alias("small"), neurons(tokens, "large").alias("large"))


def budget_requests(v: Views) -> DataFrame:
    """Model calls as a ledger sees them: (day, stamp, event_id, asked)."""
    return v.raw("events").select(F.to_date("ts").alias("day"), F.col("ts").alias("stamp"), "event_id", F.ceil("value").cast("long").alias("asked"))


def budget_ledger(v: Views, cap: int = BUDGET) -> DataFrame:
    """Calls by day in order, each accepted if it still fits under the day's cap; a refused one takes nothing."""
    requests = budget_requests(v)
    steps = requests.select("day", F.col("stamp").alias("at"), F.lit(0).alias("rank"), F.col("event_id").alias("id"), F.lit(RESERVE).alias("kind"), F.col("asked").alias("amount"))
    none = F.lit(0).cast("long")
    rows = requests.groupBy("day").agg(F.count("*").alias("n")).join(ledger(steps, cap), "day", "left")
    accepted = F.coalesce("calls", none)
    return rows.select("day", accepted.alias("accepted"), (F.col("n") - accepted).alias("refused"), F.coalesce("neurons", none).alias("spent"))


def stub_probabilities(question: Column, slugs: list[str]) -> Column:
    """Deterministic stand-in for a model: 0.7 to the choice that the sum of the question's character codes names, the rest shared."""
    n = len(slugs)
    codes = F.transform(F.filter(F.split(question, ""), lambda c: c != ""), lambda c: F.ascii(c))
    pick = F.aggregate(codes, F.lit(0), lambda total, code: total + code) % n
    rest = 0.3 / max(1, n - 1)
    return F.array(*[F.struct(F.when(pick == k, F.lit(0.7)).otherwise(F.lit(rest)).alias("p"), F.lit(s).alias("slug")) for k, s in enumerate(slugs)])


SLUGS = ["c0", "c1", "c2", "c3", "other"]
SECOND_LEAST = 0.35


def placement(probabilities: Column, named: Column | None = None) -> Column:
    """First category (the named one, else the likeliest) and a second one that is likely too and not "other"."""
    ranked = F.sort_array(probabilities, asc=False)
    primary = F.coalesce(named if named is not None else F.lit(None).cast("string"), ranked[0]["slug"], F.lit("other"))
    second = F.filter(ranked, lambda r: r["slug"] != primary)[0]
    return F.struct(primary.alias("primary"), F.when((second["p"] >= SECOND_LEAST) & (second["slug"] != "other"), second["slug"]).alias("secondary"))


def placements(v: Views) -> DataFrame:
    """Placements of posts from made probabilities: of two numbers of the post."""
    share = (F.col("entry_id") * 7919 % 1000) / F.lit(1000.0)
    first = F.concat(F.lit("c"), (F.col("entry_id") % 4).cast("string"))
    second = F.when(F.col("entry_id") % 6 == 5, F.lit("other")).otherwise(F.concat(F.lit("c"), ((F.col("entry_id") + 1) % 4).cast("string")))
    rows = F.array(F.struct(share.alias("p"), first.alias("slug")), F.struct((F.lit(1.0) - share).alias("p"), second.alias("slug")))
    named = F.when(F.col("entry_id") % 10 == 0, F.lit("c9"))
    return v.entries.select("entry_id", placement(rows, named).alias("p")).select("entry_id", "p.primary", "p.secondary")


def check_report(v: Views) -> DataFrame:
    """Pairs of categories that posts are torn between: the two likeliest within 0.2, at least two posts."""
    share = (F.col("entry_id") * 7919 % 1000) / F.lit(1000.0)
    first = F.concat(F.lit("c"), (F.col("entry_id") % 4).cast("string"))
    second = F.concat(F.lit("c"), ((F.col("entry_id") + 1 + F.col("entry_id") % 3) % 4).cast("string"))
    torn = v.entries.where((F.abs(2 * share - 1) < 0.2) & (first != second)).select(F.array_sort(F.array(first, second)).alias("pair"))
    return torn.groupBy(F.array_join("pair", "/").alias("pair")).agg(F.count("*").alias("n")).where("n >= 2")


def category_counts(v: Views) -> DataFrame:
    """Placed posts by first category, with the corrected ones."""
    return v.item_categories.groupBy("user_id", "primary_slug").agg(F.count("*").alias("n"), F.count_if("corrected").alias("corrected"))


def last_used(v: Views) -> DataFrame:
    """How often a token's "last used" is written, and when last: at the first use, then at any more than an hour after the last write."""
    writes = last_writes(v.raw("events").select("user_id", F.col("ts").alias("stamp")), ["user_id"])
    return writes.groupBy("user_id").agg(F.count("*").alias("writes"), F.max("stamp").alias("last_used"))


def words_by_post(v: Views) -> DataFrame:
    from quire.functions.texts import is_long, minutes

    return v.entries.select("entry_id", "words", minutes(F.col("words")).alias("minutes"), is_long(F.col("words")).alias("is_long"))

