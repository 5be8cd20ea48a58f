"""The inbox as its page shows it: what was left partway, then posts and shared links in one list, each with all that is known of it.

Pages are chosen from ids and dates alone; titles, chances, categories and reading times are joined to the rows that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.display import shown_title, site
from quire.functions.texts import minutes
from quire.operators.reading import INBOX_LIMIT, inbox_posts, likely, link_words, long, top_per
from quire.plans.views import Views

PLACES, CONTINUED = 50, 4
KEEP_LEAST = 0.5
KEYS = ["user_id", "kind", "id"]


def newest_places(v: Views) -> DataFrame:
    """(user_id, kind, id, updated_at, progress): each user's newest reading places in posts and links."""
    posts = v.places.select("user_id", F.lit("post").alias("kind"), F.col("entry_id").alias("id"), "updated_at", "progress")
    links = v.link_places.select("user_id", F.lit("shared").alias("kind"), F.col("link_id").alias("id"), "updated_at", "progress")
    return top_per(posts.unionByName(links), ["user_id"], [F.desc("updated_at"), F.desc("kind"), F.desc("id")], PLACES)


def queued(v: Views) -> DataFrame:
    return v.links.where("status = 'queued'").select("user_id", F.lit("shared").alias("kind"), F.col("link_id").alias("id"), F.col("saved_at").alias("date"))


def left_partway(v: Views, places: DataFrame) -> DataFrame:
    """The newest few places in posts of followed feeds that are not dismissed, and in queued links."""
    posts = places.where("kind = 'post'").join(v.entries.select(F.col("entry_id").alias("id"), "feed_id", F.col("entry_date").alias("date")), "id")
    posts = posts.join(v.subscriptions.select("user_id", "feed_id"), ["user_id", "feed_id"], "left_semi")
    state = v.entry_state.select("user_id", F.col("entry_id").alias("id"), "read_at", "dismissed_at")
    posts = posts.join(state, ["user_id", "id"], "left").where("dismissed_at is null").select(*KEYS, "date", F.col("read_at").isNotNull().alias("read"), "updated_at")
    links = places.where("kind = 'shared'").join(queued(v), KEYS).select(*KEYS, "date", F.lit(False).alias("read"), "updated_at")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), F.desc("kind"), F.desc("id")))
    return posts.unionByName(links).withColumn("place", place).where(F.col("place") <= CONTINUED).drop("updated_at")


def enriched(v: Views, listed: DataFrame) -> DataFrame:
    """The rows (user_id, kind, id) with title, source, note, chances, categories, star, minutes and progress."""
    of = lambda kind, df, c: df.withColumnRenamed(c, "id").withColumn("kind", F.lit(kind))
    title = F.coalesce("title", F.substring("content", 1, 80), F.lit("Untitled"))
    posts = listed.where("kind = 'post'").select(*KEYS).distinct().join(v.entries.select(F.col("entry_id").alias("id"), title.alias("title"), "feed_id", "words"), "id")
    feeds = v.subscriptions.join(v.feeds.select("feed_id", "title", "url"), "feed_id").select("user_id", "feed_id", F.coalesce("title_override", "title", "url").alias("source"))
    starred = v.links.where("source_entry_id is not null").groupBy("user_id", F.col("source_entry_id").alias("id")).agg(F.bool_or("is_reference").alias("starred"))
    posts = posts.join(feeds, ["user_id", "feed_id"]).join(starred, ["user_id", "id"], "left").select(*KEYS, "title", "source", F.lit(False).alias("note"), F.coalesce("starred", F.lit(False)).alias("starred"), "words")
    saved = v.links.select(F.col("link_id").alias("id"), "title", "url", "site_name", "note", "is_reference")
    links = listed.where("kind = 'shared'").select(*KEYS).distinct().join(saved, "id").join(link_words(v).select(F.col("link_id").alias("id"), "words"), "id")
    source = F.coalesce(F.nullif("site_name", F.lit("")), site(F.col("url")))
    links = links.select(*KEYS, shown_title(F.col("title"), F.col("url")).alias("title"), source.alias("source"), F.coalesce(F.col("note") != "", F.lit(False)).alias("note"), F.col("is_reference").alias("starred"), "words")
    chances = of("post", v.predictions.where("error is null").select("user_id", "entry_id", "p_open", "p_keep"), "entry_id").unionByName(
        of("shared", v.link_predictions.where("error is null").select("user_id", "link_id", "p_open", "p_keep"), "link_id")
    )
    slugs = F.concat_ws(",", "primary_slug", "secondary_slug").alias("categories")
    categories = of("post", v.item_categories.select("user_id", "entry_id", slugs), "entry_id").unionByName(of("shared", v.link_categories.select("user_id", "link_id", F.col("slug").alias("categories")), "link_id"))
    about = posts.unionByName(links).join(chances, KEYS, "left").join(categories, KEYS, "left")
    candidate = ~F.col("starred") & (F.coalesce("p_keep", F.lit(0.0)) >= KEEP_LEAST)
    return listed.join(about.select(*KEYS, "title", "source", "note", "starred", "p_open", "p_keep", F.coalesce("categories", F.lit("")).alias("categories"), candidate.alias("candidate"), minutes(F.col("words")).alias("minutes")), KEYS)


def inbox(v: Views, sort: str = "newest", limit: int = INBOX_LIMIT) -> DataFrame:
    """Every user's whole inbox: ``continuing`` first, then ``list``: unread posts and shared links by date, then read posts.

    What continues is not listed again.  ``likely`` puts what is probably opened first within the unread, newer items favoured; links count as posts do.
    """
    places = newest_places(v)
    continuing = left_partway(v, places).withColumn("section", F.lit("continuing"))
    posts = inbox_posts(v, limit).select("user_id", F.lit("post").alias("kind"), F.col("entry_id").alias("id"), F.col("entry_date").alias("date"), (~F.col("unread")).alias("read")).distinct()
    links = top_per(queued(v), ["user_id"], [F.desc("date"), F.desc("id")], limit).withColumn("read", F.lit(False))
    listed = posts.unionByName(links).join(continuing.select(*KEYS), KEYS, "left_anti")
    order: list[Column] = [F.asc("read"), F.desc("date"), F.desc("id"), F.asc("kind")]
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    page = listed.withColumn("place", place).where(F.col("place") <= limit).withColumn("section", F.lit("list"))
    rows = enriched(v, continuing.unionByName(page.select(*continuing.columns))).join(places.select(*KEYS, F.round("progress", 6).alias("progress")), KEYS, "left")
    if sort == "likely":
        value = F.when(F.col("section") == "continuing", 0.0).when(F.col("read"), -1.0).otherwise(F.round(likely(F.col("p_open"), F.col("date")), 6))
        by_chance = Window.partitionBy("user_id", "section").orderBy(value.desc(), F.asc("place"))
        rows = rows.withColumn("place", F.row_number().over(by_chance))
    return rows.select("user_id", "section", long(F.col("place")).alias("place"), "kind", "id", "title", "source", "date", "read", "note", "starred", "categories", "p_open", "p_keep", "candidate", "minutes", "progress")
