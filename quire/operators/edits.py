"""Changes to saved items, as functions from state and incoming rows to new state; texts and batches for models."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.display import chosen_canonical, shown_title, site, slug, sortable_time, time_of, tone, yes_chance
from quire.functions.texts import first_words, merge_note, summary, words
from quire.operators.reading import newest_left, top_per
from quire.plans.views import Views, now

ARTICLE_WORDS, MAX_ATTEMPTS, READ_CHARS, BATCH = 100, 3, 30_000, 20


def entry_links(v: Views) -> DataFrame:
    """The post of each link: by its source, else the newest post of the same URL; a union of two equi-joins instead of an OR.

    The newest post of a URL is the same for all its links, so it is found once: a URL that many posts and many links have makes no pairs of them.
    """
    posts = v.entries.select("entry_id", F.concat(F.lit("https://feed.example.com/"), (F.col("entry_id") % 97).cast("string")).alias("url"), "entry_date")
    links = v.links.select("link_id", "source_entry_id", F.concat(F.lit("https://feed.example.com/"), (F.col("link_id") % 211).cast("string")).alias("seen"))
    by_source = links.join(posts, F.col("source_entry_id") == F.col("entry_id")).select("link_id", "entry_id", "entry_date", F.lit(0).alias("how"))
    newest = posts.groupBy("url").agg(F.max(F.struct("entry_date", "entry_id")).alias("post"))
    by_url = links.join(newest, F.col("seen") == F.col("url")).select("link_id", "post.entry_id", "post.entry_date", F.lit(1).alias("how"))
    best = top_per(by_source.unionByName(by_url), ["link_id"], [F.asc("how"), F.desc("entry_date"), F.desc("entry_id")], 1)
    return best.select("link_id", "entry_id", (F.col("how") == 0).alias("by_source"))


def save_links(v: Views) -> DataFrame:
    """Saving pages again: the saved row is updated (note merged, back in the queue, tags joined), a new one is made.

    Every third page comes in, half of them with addresses that differ in case and tracking only; every second page is saved.
    """
    k = F.col("link_id")
    saved = v.links.where("link_id % 2 = 0").select("user_id", "canonical_url", "link_id", "note", "status", "saved_at")
    incoming = v.links.where("link_id % 3 = 0").select("user_id", "canonical_url", k.alias("in_id"), F.when(k % 12 == 0, F.lit("NOTE  0")).otherwise(F.concat(F.lit("new "), k.cast("string"))).alias("new_note"))
    both = saved.join(incoming, ["user_id", "canonical_url"], "full_outer")
    return both.select(
        "user_id",
        "canonical_url",
        F.coalesce("link_id", "in_id").alias("link_id"),
        F.when(F.col("in_id").isNull(), F.col("note")).otherwise(merge_note(F.col("note"), F.col("new_note"))).alias("note"),
        F.when(F.col("in_id").isNotNull(), F.lit("queued")).otherwise(F.col("status")).alias("status"),
        F.when(F.col("in_id").isNotNull(), now()).otherwise(F.col("saved_at")).alias("saved_at"),
        F.col("link_id").isNull().alias("made"),
    )


def capture_archives(v: Views) -> DataFrame:
    """What becomes of each copy: a feed text of enough words, else the page's, else any feed text, else failure.

    Failures that may pass keep their attempts, others are final.
    """
    posts = v.entries.select(F.col("entry_id").alias("source_entry_id"), F.col("words").alias("feed_words"))
    k = F.col("link_id")
    status_code = F.element_at(F.array(*map(F.lit, (200, 200, 200, 404, 503, 429, 200, 403))), (k % 8 + 1).cast("int"))
    rows = v.archives.where("status <> 'ready'").select("link_id", "attempts").join(v.links.select("link_id", "source_entry_id"), "link_id").join(posts, "source_entry_id", "left")
    rows = rows.withColumn("code", status_code).withColumn("page_words", F.when(F.col("code") == 200, (k * 53) % 300))
    feed, page = F.coalesce("feed_words", F.lit(0)), F.coalesce("page_words", F.lit(0))
    source = F.when(feed >= ARTICLE_WORDS, "feed").when(page >= ARTICLE_WORDS, "page").when(feed > 0, "feed")
    again = (F.col("code") >= 500) | F.col("code").isin(408, 429)
    return rows.select(
        "link_id",
        F.when(source.isNull(), F.lit("failed")).otherwise(F.lit("ready")).alias("status"),
        source.alias("source"),
        F.when(source == "feed", feed).when(source == "page", page).cast("long").alias("words"),
        F.when(source.isNull() & ~again, F.lit(MAX_ATTEMPTS)).otherwise(F.col("attempts")).cast("long").alias("attempts"),
    )


def keep_until(v: Views) -> DataFrame:
    """How long copies stay: without limit while queued or starred, else two weeks from now."""
    held = (F.col("status") == "queued") | F.col("is_reference")
    return v.links.select("link_id", F.when(~held, now() + F.expr("interval '14' day")).alias("keep_until"))


def last_places(v: Views) -> DataFrame:
    """The last reading place of each user and post: last write wins."""
    return v.places.select("user_id", "entry_id", "block", F.round("progress", 6).alias("progress"), "updated_at")


def undone_log(v: Views) -> DataFrame:
    """Stars after undo: events number actions, a sign-up undoes the user's purchase right before it."""
    w = Window.partitionBy("user_id").orderBy("stamp", "event_id")
    marked = v.actions.where("event_type in ('purchase', 'signup')").withColumn("next", F.lead("event_type").over(w))
    return marked.where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("stars"), F.count_if(F.coalesce(F.col("next") == "signup", F.lit(False))).alias("undone"))


def correction_examples(v: Views, limit: int = 10) -> DataFrame:
    """Each user's corrected placements with titles."""
    rows = v.item_categories.where("corrected").join(v.entries.select("entry_id", "title", "entry_date"), "entry_id").where("title is not null")
    return top_per(rows, ["user_id"], [F.desc("entry_date"), F.desc("entry_id")], limit).select("user_id", "entry_id", "title", F.col("primary_slug").alias("category"))


def item_texts(v: Views, most: int = 120) -> DataFrame:
    """The text of each queued link as a model sees it: note and the post's first words."""
    posts = v.entries.select(F.col("entry_id").alias("source_entry_id"), F.col("content"))
    rows = v.links.where("status = 'queued'").join(posts, "source_entry_id", "left")
    text = F.concat_ws("\n", F.col("note"), first_words(F.col("content"), most))
    return rows.select("link_id", "title", text.alias("text"))


def batches(v: Views) -> DataFrame:
    """Queued links in numbered batches of BATCH a user, as one text a batch."""
    rows = v.links.where("status = 'queued'").select("user_id", "link_id", "title", "site_name", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("saved_at"), F.desc("link_id"))).alias("rn"))
    number = (F.col("rn") - 1) % BATCH + 1
    line = F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.col("title"), F.lit(" ("), F.col("site_name"), F.lit(")"))
    grouped = rows.groupBy("user_id", F.floor((F.col("rn") - 1) / BATCH).alias("batch")).agg(F.array_sort(F.collect_list(F.struct(number.alias("k"), line.alias("line")))).alias("lines"))
    return grouped.select("user_id", "batch", F.array_join(F.transform("lines", lambda s: s["line"]), "\n").alias("state"), F.size("lines").cast("long").alias("items"))


def read_entries(v: Views) -> DataFrame:
    """Posts as an API gives them: the text cut, and whether it was."""
    return v.entries.select("entry_id", F.length(F.substring("content", 1, READ_CHARS)).cast("long").alias("chars"), (F.length("content") > READ_CHARS).alias("truncated"), summary(F.trim(F.regexp_replace("content", "\\s+", " "))).alias("summary"))


def suggestion_sample(v: Views) -> DataFrame:
    """The newest 25 posts of each user's feeds and 15 newest starred links: each cut by itself, then together."""
    newest = top_per(newest_left(v, v.entries, 25), ["user_id"], [F.desc("entry_date"), F.desc("entry_id")], 25).select("user_id", F.lit("post").alias("kind"), F.col("entry_id").alias("id"))
    stars = top_per(v.links.where("is_reference"), ["user_id"], [F.desc("starred_at"), F.desc("link_id")], 15).select("user_id", F.lit("link").alias("kind"), F.col("link_id").alias("id"))
    return newest.unionByName(stars)


def link_display(v: Views) -> DataFrame:
    """Titles, sites, tones and slugs of saved pages."""
    title = F.when(F.col("link_id") % 4 != 0, F.col("title"))
    return v.links.select("link_id", shown_title(title, F.col("url")).alias("shown"), site(F.col("url")).alias("site"), tone(site(F.col("url"))).alias("tone"), slug(F.col("title")).alias("slug"))


def link_json(v: Views) -> DataFrame:
    """Saved pages as JSON objects."""
    tags = v.link_tags.groupBy("link_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    rows = v.links.join(tags, "link_id", "left")
    return rows.select("link_id", F.to_json(F.struct(F.col("link_id").alias("id"), "url", "tags", F.col("is_reference").alias("starred"))).alias("json"))


def claimed_canonicals(v: Views) -> DataFrame:
    """Which canonical URL counts when a page names one: every third another site, every fourth the site's root."""
    k = F.col("page_id")
    claimed = F.when(k % 3 == 0, F.lit("https://elsewhere.example.org/x")).when(k % 4 == 0, F.concat(F.lit("https://"), site(F.col("url")), F.lit("/"))).otherwise(F.concat(F.lit("http://www."), site(F.col("url")), F.lit("/same?utm_x=1")))
    return v.raw("pages").select("page_id", chosen_canonical(F.col("url"), claimed).alias("canonical_url"))


def sortable_ids(v: Views) -> DataFrame:
    """Time parts of sortable ids of events, and the time read back."""
    millis = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    made = v.raw("events").select("event_id", millis.alias("millis"), sortable_time(millis).alias("sortable"))
    return made.select("event_id", "sortable", (time_of(F.col("sortable")) == F.col("millis")).alias("same"))


def parsed_answers(v: Views) -> DataFrame:
    """Chances in model answers of four shapes, one of them unreadable."""
    p = F.col("value") / 400
    shapes = [
        F.concat(F.lit('{"answers": {"open": '), p.cast("string"), F.lit("}}")),
        F.concat(F.lit('{"result": {"answers": {"open": {"noul": '), p.cast("string"), F.lit("}}}}")),
        F.concat(F.lit('{"answers": {"open": {"probability": '), p.cast("string"), F.lit("}}}")),
        F.lit("not json"),
    ]
    body = F.element_at(F.array(*shapes), (F.col("event_id") % 4 + 1).cast("int"))
    return v.raw("events").select("event_id", F.round(yes_chance(body, "open"), 9).alias("p"))


def new_users(v: Views) -> DataFrame:
    """Insert-if-absent by e-mail: users of January's second half that the first half does not have."""
    named = v.raw("events").select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("email"), "ts", "event_id")
    first = named.where("event_id % 97 < 3").select("email").distinct()
    return named.where("event_id % 97 >= 3").groupBy("email").agg(F.min("ts").alias("created_at")).join(first, "email", "left_anti")


def long_posts(v: Views) -> DataFrame:
    """Words of posts by feed: total and of long reads."""
    rows = v.entries.select("feed_id", "words")
    return rows.groupBy("feed_id").agg(F.sum("words").alias("words"), F.sum(F.when(F.col("words") >= 1035, F.col("words")).otherwise(0)).alias("long_words"))
