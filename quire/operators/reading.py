"""Engagement and inbox operators: open rates, calibration, facets, unread counts, inbox, ranking, digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.texts import LONG_READ_WORDS, minutes
from quire.plans.views import Views, days_ago, now

INBOX_LIMIT = 60
BINS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0001)
HALF_LIFE_DAYS = 3


def long(column: Column) -> Column:
    return column.cast("long")


def feed_open_rates(v: Views, days: int = 90) -> DataFrame:
    """Opened and skipped posts by user and feed, from live state and from the history of pruned posts."""
    live = v.entry_state.join(v.entries.select("entry_id", "feed_id"), "entry_id").select("user_id", "feed_id", "opened_at", "dismissed_at")
    every = live.unionByName(v.history.select("user_id", "feed_id", "opened_at", "dismissed_at"))
    opened = F.col("opened_at").isNotNull()
    recent = every.where(F.coalesce("opened_at", "dismissed_at") >= days_ago(days))
    return recent.groupBy("user_id", "feed_id").agg(
        F.count_if(opened).alias("n_opened"), F.count_if(~opened & F.col("dismissed_at").isNotNull()).alias("n_skipped")
    )


def scorecard(v: Views, score: str, outcome: str) -> DataFrame:
    """Of five bins of a predicted probability, how many predictions fell in and how many came true; empty bins too.

    Outcomes: ``opened`` by state, history; ``starred`` by a starred link made from the post.  Bins compare with
    their edges, so 1.0 is in the last.
    """
    state = v.entry_state.select("user_id", "entry_id", "opened_at", "dismissed_at")
    past = v.history.select("user_id", "entry_id", F.col("opened_at").alias("past_opened"), F.col("dismissed_at").alias("past_dismissed"))
    stars = v.links.where("is_reference and source_entry_id is not null").select("user_id", F.col("source_entry_id").alias("entry_id")).distinct().withColumn("starred", F.lit(True))
    keys = ["user_id", "entry_id"]
    rows = v.predictions.where("error is null").join(state, keys, "left").join(past, keys, "left").join(stars, keys, "left")
    opened = F.coalesce("opened_at", "past_opened").isNotNull()
    came_true = opened if outcome == "opened" else F.coalesce("starred", F.lit(False))
    decided = rows.where(F.coalesce("opened_at", "dismissed_at", "past_opened", "past_dismissed").isNotNull())
    bin_of = F.lit(None).cast("int")
    for k in range(len(BINS) - 1):
        bin_of = F.when((F.col(score) >= BINS[k]) & (F.col(score) < BINS[k + 1]), F.lit(k)).otherwise(bin_of)
    counts = decided.withColumn("bin", bin_of).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.count_if(came_true).alias("hits"))
    bins = v.spark.range(len(BINS) - 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").select(long(F.col("bin")).alias("bin"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(0)).alias("hits"))


def tag_facets(v: Views, limit: int = 40) -> DataFrame:
    """Each user's tags by number of links, the first ``limit``."""
    counts = v.links.select("user_id", "link_id").join(v.link_tags, "link_id").groupBy("user_id", "tag").agg(F.count("*").alias("n"))
    return top_per(counts, ["user_id"], [F.desc("n"), F.asc("tag")], limit)


def site_facets(v: Views, limit: int = 12) -> DataFrame:
    """Each user's sites by number of links, the first ``limit``."""
    counts = v.links.groupBy("user_id", F.col("site_name").alias("host")).agg(F.count("*").alias("n"))
    return top_per(counts, ["user_id"], [F.desc("n"), F.asc("host")], limit)


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark drops the rest before the shuffle (WindowGroupLimit)."""
    ranked = df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("__rank") <= n).drop("__rank")


def is_unread() -> Column:
    return F.col("read_at").isNull() & F.col("dismissed_at").isNull()


def handled(v: Views) -> DataFrame:
    """(user, post) pairs with a read or dismissal."""
    return v.entry_state.where(~is_unread()).select("user_id", "entry_id")


def newest_left(v: Views, posts: DataFrame, limit: int, gone: DataFrame | None = None, follows: DataFrame | None = None) -> DataFrame:
    """(user_id, entry_id, feed_id, entry_date): by user and followed feed the newest ``limit`` of ``posts`` that are not ``gone``, and some more.

    Users are never paired with all posts.  Posts are numbered once a feed, newest first; of a feed where h posts are gone for
    a user, the first limit + h hold the newest ``limit`` that are left.  The number is that of newer days plus the place in the
    day, so no task sorts a feed, and days that nobody needs are not numbered.  Users and posts meet by feed and level, the number of binary
    digits of a place, so a user meets less than twice as many posts as they need, however many another reader of the feed needs.
    ``gone`` has distinct pairs.
    """
    follows = (v.subscriptions if follows is None else follows).select("user_id", "feed_id")
    narrow = posts.select("entry_id", "feed_id", "entry_date", F.to_date("entry_date").alias("day"))
    need = F.lit(limit).cast("long")
    asked = follows.withColumn("need", need)
    if gone is not None:
        counts = gone.join(narrow.select("entry_id", "feed_id"), "entry_id").groupBy("user_id", "feed_id").agg(F.count("*").alias("h"))
        asked = follows.join(counts, ["user_id", "feed_id"], "left").select("user_id", "feed_id", (need + F.coalesce("h", F.lit(0))).alias("need"))
    most = asked.groupBy("feed_id").agg(F.max("need").alias("most"))
    later = Window.partitionBy("feed_id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    days = narrow.groupBy("feed_id", "day").agg(F.count("*").alias("n")).select("feed_id", "day", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("newer"))
    days = days.join(most, "feed_id").where("newer < most")
    place = F.row_number().over(Window.partitionBy("feed_id", "day").orderBy(F.desc("entry_date"), F.desc("entry_id")))
    numbered = narrow.join(days, ["feed_id", "day"]).withColumn("place", F.col("newer") + place).where("place <= most").select("entry_id", "feed_id", "entry_date", "place")
    pairs = by_level(asked, numbered).where("place <= need").select("user_id", "entry_id", "feed_id", "entry_date")
    return pairs if gone is None else pairs.join(gone, ["user_id", "entry_id"], "left_anti")


def by_level(asked: DataFrame, numbered: DataFrame) -> DataFrame:
    """Followers (feed_id, need) with the posts (feed_id, place from 1) of the levels up to their need's."""
    level = lambda c: F.length(F.bin(c))
    wanted = asked.where("need > 0").withColumn("level", F.explode(F.sequence(F.lit(1), level("need"))))
    return wanted.join(numbered.withColumn("level", level("place")), ["feed_id", "level"])


def subscription_list(v: Views) -> DataFrame:
    """Feeds by user with their unread counts (without a time window), ordered by title."""
    handled = v.entry_state.where("read_at is not null or dismissed_at is not null").join(v.entries.select("entry_id", "feed_id"), "entry_id")
    done = handled.groupBy("user_id", "feed_id").agg(F.count("*").alias("done"))
    every = v.entries.groupBy("feed_id").agg(F.count("*").alias("posts"))
    title = F.coalesce("title_override", "title", "url")
    rows = v.subscriptions.join(v.feeds.select("feed_id", "title", "url"), "feed_id").join(every, "feed_id", "left").join(done, ["user_id", "feed_id"], "left")
    unread = F.coalesce("posts", F.lit(0)) - F.coalesce("done", F.lit(0))
    return rows.select("user_id", "feed_id", title.alias("title"), "folder", unread.alias("unread"))


def folder_unread(v: Views) -> DataFrame:
    """Unread posts by folder."""
    return subscription_list(v).groupBy("user_id", "folder").agg(F.sum("unread").alias("unread"))


def unread_badge(v: Views, days: int = 60) -> DataFrame:
    """Unread posts of the last ``days`` days plus queued links, by user.

    Posts are counted by feed and the handled ones taken off, so users and posts are never paired.
    """
    recent = v.entries.where(F.col("entry_date") >= days_ago(days)).select("entry_id", "feed_id")
    by_feed = recent.groupBy("feed_id").agg(F.count("*").alias("n"))
    handled = v.entry_state.where("read_at is not null or dismissed_at is not null").select("user_id", "entry_id").join(recent, "entry_id")
    done = handled.join(v.subscriptions.select("user_id", "feed_id"), ["user_id", "feed_id"]).groupBy("user_id").agg(F.count("*").alias("done"))
    total = v.subscriptions.join(by_feed, "feed_id").groupBy("user_id").agg(F.sum("n").alias("n"))
    queued = v.links.where("status = 'queued'").groupBy("user_id").agg(F.count("*").alias("queued"))
    rows = v.users.join(total, "user_id", "left").join(done, "user_id", "left").join(queued, "user_id", "left")
    posts = F.coalesce("n", F.lit(0)) - F.coalesce("done", F.lit(0))
    return rows.select("user_id", posts.alias("posts"), F.coalesce("queued", F.lit(0)).alias("queued"), (posts + F.coalesce("queued", F.lit(0))).alias("total"))


def inbox_order() -> list[Column]:
    """Unread first, then newest."""
    return [F.col("read_at").isNotNull().asc(), F.desc("entry_date"), F.desc("entry_id")]


def inbox_posts(v: Views, limit: int = INBOX_LIMIT, where: Column | None = None, follows: Column | None = None, category: str | None = None) -> DataFrame:
    """Each user's undismissed posts, unread first, newest first, the first ``limit``; two links to one post give it twice.

    ``where`` is on posts, ``follows`` on subscriptions.  The unread ones come from ``newest_left``, the read ones (or those of a
    category) from the user's own rows.  Reading times are joined to the page that is left.
    """
    keys = ["user_id", "entry_id"]
    posts = v.entries if where is None else v.entries.where(where)
    followed = (v.subscriptions if follows is None else v.subscriptions.where(follows)).select("user_id", "feed_id")
    narrow = posts.select("entry_id", "feed_id", "entry_date")
    if category is not None:
        placed = v.item_categories.where((F.col("primary_slug") == category) | (F.col("secondary_slug") == category)).select(*keys)
        rows = placed.join(v.entry_state.select(*keys, "read_at", "dismissed_at"), keys, "left").where("dismissed_at is null")
        rows = rows.join(narrow, "entry_id").join(followed, ["user_id", "feed_id"]).select(*keys, "feed_id", "entry_date", "read_at")
    else:
        read = v.entry_state.where("read_at is not null and dismissed_at is null").select(*keys, "read_at").join(narrow, "entry_id").join(followed, ["user_id", "feed_id"])
        unread = newest_left(v, posts, limit, handled(v), followed).withColumn("read_at", F.lit(None).cast("timestamp_ntz"))
        rows = unread.unionByName(read.select(*unread.columns))
    links = v.links.where("source_entry_id is not null").select("user_id", F.col("source_entry_id").alias("entry_id"), "link_id")
    page = top_per(rows.join(links, keys, "left"), ["user_id"], [*inbox_order(), F.desc_nulls_last("link_id")], limit)
    times = v.entries.select("entry_id", minutes(F.col("words")).alias("minutes"))
    return page.join(times, "entry_id").select("user_id", "entry_id", "feed_id", "entry_date", F.col("read_at").isNull().alias("unread"), "link_id", "minutes")


def inbox_short(v: Views) -> DataFrame:
    """The inbox of posts under the length of a long read."""
    return inbox_posts(v, where=F.col("words") < LONG_READ_WORDS)


def likely(p_open: Column, date: Column) -> Column:
    """Chance of opening (a half when unknown) that halves every HALF_LIFE_DAYS."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(now().cast("timestamp")) - F.unix_micros(date.cast("timestamp"))) / F.lit(86_400_000_000.0))
    return F.coalesce(p_open, F.lit(0.5)) * F.pow(F.lit(0.5), age / HALF_LIFE_DAYS)


def inbox_likely(v: Views, limit: int = INBOX_LIMIT) -> DataFrame:
    """The newest page of the inbox, ranked by how likely each post is opened; read ones are last."""
    page = inbox_posts(v, limit)
    scored = page.join(v.predictions.where("error is null").select("user_id", "entry_id", "p_open"), ["user_id", "entry_id"], "left")
    value = F.when(F.col("unread"), likely(F.col("p_open"), F.col("entry_date"))).otherwise(F.lit(-1.0))
    scored = scored.withColumn("likely", F.round(value, 6))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("likely"), F.desc("entry_date"), F.desc("entry_id"), F.desc_nulls_last("link_id")))
    return scored.select("user_id", "entry_id", "likely", "unread", long(place).alias("place"))


def inbox_merged(v: Views, limit: int = INBOX_LIMIT) -> DataFrame:
    """Posts and queued links in one list: unread (with all links) newest first, then read posts."""
    posts = inbox_posts(v, limit).select("user_id", F.lit("post").alias("kind"), F.col("entry_id").alias("id"), F.col("entry_date").alias("stamp"), "unread")
    queued = v.links.where("status = 'queued'").select("user_id", F.lit("link").alias("kind"), F.col("link_id").alias("id"), F.col("saved_at").alias("stamp"), F.lit(True).alias("unread"))
    order = [F.desc("unread"), F.desc("stamp"), F.desc("id"), F.asc("kind")]
    return top_per(posts.unionByName(queued).distinct(), ["user_id"], order, limit)


def continue_reading(v: Views, newest: int = 50, limit: int = 4) -> DataFrame:
    """Each user's newest reading places on undismissed posts of followed feeds."""
    recent = top_per(v.places, ["user_id"], [F.desc("updated_at"), F.desc("entry_id")], newest)
    open_posts = recent.join(v.entries.select("entry_id", "feed_id"), "entry_id").join(v.subscriptions.select("user_id", "feed_id"), ["user_id", "feed_id"], "left_semi")
    dismissed = v.entry_state.where("dismissed_at is not null").select("user_id", "entry_id")
    shown = open_posts.join(dismissed, ["user_id", "entry_id"], "left_anti")
    return top_per(shown, ["user_id"], [F.desc("updated_at"), F.desc("entry_id")], limit).select("user_id", "entry_id", "updated_at", F.round("progress", 6).alias("progress"))


def next_item(v: Views) -> DataFrame:
    """The newest unread post or queued link of each user."""
    posts = newest_left(v, v.entries, 1, handled(v)).select("user_id", F.struct(F.col("entry_date").alias("stamp"), F.lit("post").alias("kind"), F.col("entry_id").alias("id")).alias("item"))
    queued = v.links.where("status = 'queued'").select("user_id", F.struct(F.col("saved_at").alias("stamp"), F.lit("link").alias("kind"), F.col("link_id").alias("id")).alias("item"))
    return posts.unionByName(queued).groupBy("user_id").agg(F.max("item").alias("item")).select("user_id", "item.kind", "item.id", "item.stamp")


def library_candidates(v: Views, least: float = 0.5) -> DataFrame:
    """Unstarred posts that are likely worth keeping."""
    starred = v.links.where("is_reference and source_entry_id is not null").select("user_id", F.col("source_entry_id").alias("entry_id"))
    good = v.predictions.where(F.col("error").isNull() & (F.col("p_keep") >= least))
    return good.join(starred, ["user_id", "entry_id"], "left_anti").select("user_id", "entry_id", "p_keep")


def highlight_counts(v: Views) -> DataFrame:
    return v.highlights.groupBy("user_id", "entry_id").agg(F.count("*").alias("n_highlights"), F.max("created_at").alias("last_highlight"))


def reaction_score(noted: Column, starred: Column, cites: Column, opened: Column, done: Column) -> Column:
    """3 for a note or highlight, 3 for a star, 2 a citation (three count), 1 for opening, a half for finishing."""
    one = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    return 3 * one(noted) + 3 * one(starred) + 2.0 * F.least(cites, F.lit(3)) + one(opened) + 0.5 * one(done)


def digest_links(v: Views, days: int = 14, limit: int = 200) -> DataFrame:
    """Links with a reaction in the window; the score uses all signals, whenever they came."""
    since = days_ago(days)
    marks = highlight_counts(v).withColumnRenamed("entry_id", "source_entry_id")
    rows = v.links.join(marks, ["user_id", "source_entry_id"], "left")
    in_window = (
        (F.col("read_at") >= since)
        | (F.col("starred_at") >= since)
        | (F.col("opened_at") >= since)
        | (F.col("cited_at") >= since)
        | ((F.coalesce("note", F.lit("")) != "") & (F.col("updated_at") >= since))
        | (F.col("last_highlight") >= since)
    )
    noted = (F.coalesce("note", F.lit("")) != "") | F.col("n_highlights").isNotNull()
    score = reaction_score(noted, F.col("is_reference"), F.col("cite_count"), F.col("opened_at").isNotNull(), F.col("status") == "archived")
    last = F.greatest("read_at", "starred_at", "opened_at", "cited_at", "last_highlight", "saved_at")
    found = rows.where(F.coalesce(in_window, F.lit(False)))
    return top_per(found, ["user_id"], [F.desc("updated_at"), F.desc("link_id")], limit).select("user_id", "link_id", score.alias("score"), last.alias("last_activity"))


def digest_posts(v: Views, days: int = 14, limit: int = 200) -> DataFrame:
    """Posts opened, cited or highlighted in the window of which no link was saved."""
    since = days_ago(days)
    saved = v.links.where("source_entry_id is not null").select("user_id", F.col("source_entry_id").alias("entry_id"))
    rows = v.entry_state.join(highlight_counts(v), ["user_id", "entry_id"], "left").join(saved, ["user_id", "entry_id"], "left_anti")
    in_window = (F.col("opened_at") >= since) | (F.col("cited_at") >= since) | (F.col("last_highlight") >= since)
    score = reaction_score(F.col("n_highlights").isNotNull(), F.lit(False), F.when(F.col("cited_at").isNotNull(), 1).otherwise(0), F.col("opened_at").isNotNull(), F.col("read_at").isNotNull())
    last = F.greatest("opened_at", "cited_at", "last_highlight", "read_at")
    found = rows.where(F.coalesce(in_window, F.lit(False)))
    return top_per(found, ["user_id"], [F.desc_nulls_last("opened_at"), F.desc("entry_id")], limit).select("user_id", "entry_id", score.alias("score"), last.alias("last_activity"))


def digest_ranked(v: Views) -> DataFrame:
    """Links and posts of the digest in one ranking: score, then the latest activity."""
    both = digest_links(v).select("user_id", F.lit("link").alias("kind"), F.col("link_id").alias("id"), "score", "last_activity").unionByName(
        digest_posts(v).select("user_id", F.lit("post").alias("kind"), F.col("entry_id").alias("id"), "score", "last_activity")
    )
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), F.desc("last_activity"), F.asc("kind"), F.desc("id")))
    return both.withColumn("place", long(place))


def reaction_reasons(v: Views) -> DataFrame:
    """Why a link is in the digest, in a fixed order, by the number of each."""
    some = lambda c, text: F.when(c, text)
    plural = lambda n, one, many: F.when(n == 1, F.lit(one)).otherwise(F.concat(n.cast("string"), F.lit(many)))
    rows = v.links.join(highlight_counts(v).withColumnRenamed("entry_id", "source_entry_id"), ["user_id", "source_entry_id"], "left")
    reasons = F.array_compact(
        F.array(
            some(F.coalesce("note", F.lit("")) != "", F.lit("note")),
            some(F.col("n_highlights") > 0, plural(F.col("n_highlights"), "1 highlight", " highlights")),
            some(F.col("is_reference"), F.lit("starred")),
            some(F.col("cite_count") > 0, plural(F.col("cite_count"), "cited once", " citations")),
            some(F.col("opened_at").isNotNull(), F.lit("opened")),
            some(F.col("status") == "archived", F.lit("finished")),
        )
    )
    return rows.select("link_id", F.array_join(reasons, ", ").alias("reasons"))


def highlight_runs(v: Views) -> DataFrame:
    """Newest-first highlights in runs of one post; a post that returns later starts a new run."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("highlight_id"))
    changed = v.highlights.withColumn("new", (~F.equal_null(F.lag("entry_id").over(w), F.col("entry_id"))).cast("long"))
    runs = changed.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("user_id", "run", "entry_id").agg(F.count("*").alias("n"), F.max("created_at").alias("latest"))


def composed_notes(v: Views) -> DataFrame:
    """A link's own note, then the notes of its post's highlights by time, joined with blank lines."""
    marked = v.highlights.where("note is not null").groupBy("user_id", "entry_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "highlight_id", "note"))).alias("hs"))
    rows = v.links.join(marked.withColumnRenamed("entry_id", "source_entry_id"), ["user_id", "source_entry_id"], "left")
    parts = F.concat(F.array_compact(F.array("note")), F.coalesce(F.transform("hs", lambda h: h["note"]), F.array().cast("array<string>")))
    return rows.where("note is not null or hs is not null").select("link_id", F.array_join(parts, "\n\n").alias("notes"))


def profile_list(v: Views, which: str, limit: int = 15) -> DataFrame:
    """Each user's newest ``opened``, ``skipped`` or ``starred`` items: over live state, history and links."""
    state = v.entry_state.select("user_id", "entry_id", "opened_at", "dismissed_at").unionByName(v.history.select("user_id", "entry_id", "opened_at", "dismissed_at"))
    if which == "opened":
        posts = state.where("opened_at is not null").select("user_id", F.lit("post").alias("kind"), F.col("entry_id").alias("id"), F.col("opened_at").alias("stamp"))
        links = v.links.where("opened_at is not null").select("user_id", F.lit("link").alias("kind"), F.col("link_id").alias("id"), F.col("opened_at").alias("stamp"))
        rows = posts.unionByName(links)
    elif which == "skipped":
        rows = state.where("dismissed_at is not null and opened_at is null").select("user_id", F.lit("post").alias("kind"), F.col("entry_id").alias("id"), F.col("dismissed_at").alias("stamp"))
    else:
        rows = v.links.where("is_reference").select("user_id", F.lit("link").alias("kind"), F.col("link_id").alias("id"), F.col("starred_at").alias("stamp"))
    return top_per(rows, ["user_id"], [F.desc("stamp"), F.asc("kind"), F.asc("id")], limit)


def link_words(v: Views) -> DataFrame:
    """The length of each link: that of its ready copy, else of its post."""
    copies = v.archives.where("status = 'ready'").select("link_id", F.col("words").alias("copied"))
    posts = v.entries.select(F.col("entry_id").alias("source_entry_id"), F.col("words").alias("posted"))
    rows = v.links.select("user_id", "link_id", "source_entry_id").join(copies, "link_id", "left").join(posts, "source_entry_id", "left")
    return rows.select("user_id", "link_id", F.coalesce("copied", "posted").alias("words"))
