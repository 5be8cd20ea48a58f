"""Exports: links as rows, JSON or CSV; followed feeds as OPML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.texts import csv_cell
from quire.plans.views import Views

# The heads of the columns of a CSV export, in order, each with the column that it shows.
CSV_COLUMNS = {
    "url": "url", "title": "title", "site": "site", "author": "author", "note": "note", "tags": "tags", "status": "status", "reference": "is_reference", "source": "source",
    "savedAt": "saved_at", "readAt": "read_at", "starredAt": "starred_at", "description": "description",
}


def iso(at: str) -> Column:
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z"))


def link_rows(v: Views) -> DataFrame:
    """Every link with its tags in order and ISO times; ``place`` numbers a user's links from 1, newest saved first."""
    tags = v.link_tags.groupBy("link_id").agg(F.array_join(F.array_sort(F.collect_list("tag")), " ").alias("tags"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("saved_at"), F.desc("link_id"))).cast("long")
    return v.links.join(tags, "link_id", "left").select(
        "user_id", place.alias("place"), "link_id", "url", "title", F.col("site_name").alias("site"), "author", "description", "note", "tags", "status", "is_reference", "source",
        *[iso(c).alias(c) for c in ("saved_at", "read_at", "starred_at")],
    )


def csv_lines(v: Views) -> DataFrame:
    """The lines of each user's CSV export: the heads in place 0, then the links."""
    rows = link_rows(v).select("user_id", "place", F.concat_ws(",", *[csv_cell(F.col(c)) for c in CSV_COLUMNS.values()]).alias("line"))
    heads = v.links.select("user_id").distinct().select("user_id", F.lit(0).cast("long").alias("place"), F.lit(",".join(CSV_COLUMNS)).alias("line"))
    return heads.unionByName(rows)


def write_csv(v: Views, path: str) -> None:
    """One folder a user with one file, lines in order with CRLF ends."""
    csv_lines(v).repartition("user_id").sortWithinPartitions("user_id", "place").select("user_id", "line").write.partitionBy("user_id").option("lineSep", "\r\n").text(path)


def write_json(v: Views, path: str) -> None:
    link_rows(v).write.partitionBy("user_id").json(path)


def escaped(text):
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def opml(v: Views) -> DataFrame:
    """(user, document): followed feeds, folders in order, then loose feeds."""
    title = F.coalesce("title_override", "title", "url")
    feeds = v.subscriptions.join(v.feeds.select("feed_id", "title", "url"), "feed_id").select("user_id", "folder", title.alias("title"), "url")
    line = F.concat(F.lit('<outline type="rss" text="'), escaped(F.col("title")), F.lit('" xmlUrl="'), escaped(F.col("url")), F.lit('"/>'))
    folders = feeds.groupBy("user_id", "folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.lower("title").alias("k"), "url", line.alias("line")))), lambda s: s["line"]), "\n").alias("lines"))
    block = F.when(F.col("folder").isNull(), F.col("lines")).otherwise(F.concat(F.lit('<outline text="'), escaped(F.col("folder")), F.lit('">\n'), F.col("lines"), F.lit("\n</outline>")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("folder").isNull().alias("loose"), "folder", block.alias("block"))))
    body = F.array_join(F.transform(ordered, lambda s: s["block"]), "\n")
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<opml version="2.0">\n<head><title>Feeds</title></head>\n<body>\n'
    return folders.groupBy("user_id").agg(F.concat(F.lit(head), body, F.lit("\n</body>\n</opml>\n")).alias("document"))
