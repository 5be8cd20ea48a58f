"""Feed documents to entries: RSS, RDF, Atom and JSON Feed, parsed by Spark's own XML and JSON functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.pages import absolute
from quire.functions.texts import strip_tags, summary

MAX_ENTRIES, MAX_CONTENT, MAX_GUID, MAX_TITLE = 50, 400_000, 1000, 500

LINK = "array<struct<_VALUE: string, _href: string, _rel: string>>"
ITEM = (
    "title: string, link: string, description: string, `content:encoded`: string, author: string, `dc:creator`: string, pubDate: string, `dc:date`: string, "
    "guid: struct<_VALUE: string, _isPermaLink: string>, enclosure: array<struct<_url: string, _type: string>>, `media:thumbnail`: struct<_url: string>"
)
RSS = f"channel struct<title: string, link: string, description: string, item: array<struct<{ITEM}>>>"
RDF = f"channel struct<title: string, link: string, description: string>, item array<struct<{ITEM}>>"
ATOM = (
    f"title string, subtitle string, link {LINK}, entry array<struct<id: string, title: string, link: {LINK}, content: string, summary: string, published: string, "
    "updated: string, author: struct<name: string>, `media:thumbnail`: struct<_url: string>>>"
)
JSON = (
    "title string, home_page_url string, description string, items array<struct<id: string, url: string, external_url: string, title: string, summary: string, content_html: string, "
    "content_text: string, image: string, banner_image: string, date_published: string, date_modified: string, author: struct<name: string>, authors: array<struct<name: string>>>>"
)


# Characters that XML does not allow; a parser refuses a whole document for one of them.
NOT_XML = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]"


def looks_like(body: Column) -> Column:
    """json, rss, atom or rdf by the start of a document; null for anything else."""
    start = F.ltrim(F.substring(body, 1, 1000))
    return (
        F.when(F.startswith(start, F.lit("{")), "json")
        .when(start.rlike("(?i)<rss[\\s>]"), "rss")
        .when(start.rlike("(?i)<feed[\\s>]"), "atom")
        .when(start.rlike("(?i)<rdf:RDF[\\s>]"), "rdf")
    )


def when_published(text: Column) -> Column:
    """ISO and RFC 822 dates as UTC timestamps; anything else is null."""
    trimmed = F.trim(text)
    plain = F.regexp_replace(F.regexp_replace(trimmed, "^[A-Za-z]{3,9},\\s*", ""), "\\s(?:GMT|UTC|UT|Z)$", " +0000")
    rfc = F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")])
    return F.coalesce(F.try_to_timestamp(trimmed), rfc).cast("timestamp_ntz")


def first_image(html: Column, base: Column) -> Column:
    source = F.regexp_extract(html, "(?is)<img\\b[^>]*?\\ssrc\\s*=\\s*[\"']([^\"']+)[\"']", 1)
    return absolute(F.when(source != "", source), base)


def paragraphs(text: Column) -> Column:
    """Plain text as HTML paragraphs."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit("<p>"), F.regexp_replace(safe, "\\n{2,}", "</p><p>"), F.lit("</p>"))


def text_or_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", F.trim(c))


def finish(rows: DataFrame) -> DataFrame:
    """Entries from raw fields: an identity (guid, link or title with date), clean texts, whole links; without identity none."""
    plain_title = F.substring(strip_tags(F.col("raw_title")), 1, MAX_TITLE)
    title = F.when(plain_title != "", plain_title)
    url = absolute(F.col("raw_url"), F.col("base"))
    date = when_published(F.col("raw_date"))
    identity = F.coalesce(text_or_null(F.col("guid")), url, F.when(title.isNotNull(), F.concat_ws("|", title, F.coalesce(F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("")))))
    author = F.substring(strip_tags(F.col("raw_author")), 1, MAX_TITLE)
    out = rows.select(
        "feed_id", "place", F.substring(identity, 1, MAX_GUID).alias("guid"), url.alias("url"), title.alias("title"), F.when(author != "", author).alias("author"),
        summary(strip_tags(F.col("raw_summary"))).alias("summary"), F.substring("content", 1, MAX_CONTENT).alias("content"),
        F.coalesce(absolute(F.col("raw_image"), F.col("base")), first_image(F.col("content"), F.coalesce(url, F.col("base")))).alias("image_url"), date.alias("published_at"),
    )
    return out.where("guid is not null")


def rss_items(parsed: DataFrame, items: Column, base: Column) -> DataFrame:
    rows = parsed.select("feed_id", base.alias("base"), F.posexplode(F.slice(items, 1, MAX_ENTRIES)).alias("place", "i"))
    guid = text_or_null(F.col("i.guid._VALUE"))
    permalink = F.when((F.coalesce(F.col("i.guid._isPermaLink"), F.lit("true")) != "false") & guid.rlike("(?i)^https?://"), guid)
    content = F.coalesce(text_or_null(F.col("i.content:encoded")), text_or_null(F.col("i.description")))
    enclosed = F.get(F.filter("i.enclosure", lambda e: F.startswith(e["_type"], F.lit("image/"))), F.lit(0))["_url"]
    return rows.select(
        "feed_id", "place", "base", guid.alias("guid"), F.coalesce(text_or_null(F.col("i.link")), permalink).alias("raw_url"), F.col("i.title").alias("raw_title"),
        F.coalesce("i.dc:creator", "i.author").alias("raw_author"), F.coalesce(text_or_null(F.col("i.description")), content).alias("raw_summary"), content.alias("content"),
        F.coalesce(F.col("i.media:thumbnail._url"), enclosed).alias("raw_image"), F.coalesce("i.pubDate", "i.dc:date").alias("raw_date"),
    )


def atom_link(links: Column) -> Column:
    chosen = F.coalesce(F.get(F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get(links, F.lit(0)))
    return F.coalesce(chosen["_href"], chosen["_VALUE"])


def atom_items(parsed: DataFrame) -> DataFrame:
    base = F.coalesce(absolute(atom_link(F.col("x.link")), F.col("feed_url")), F.col("feed_url"))
    rows = parsed.select("feed_id", base.alias("base"), F.posexplode(F.slice("x.entry", 1, MAX_ENTRIES)).alias("place", "i"))
    content, short = text_or_null(F.col("i.content")), text_or_null(F.col("i.summary"))
    return rows.select(
        "feed_id", "place", "base", F.col("i.id").alias("guid"), atom_link(F.col("i.link")).alias("raw_url"), F.col("i.title").alias("raw_title"), F.col("i.author.name").alias("raw_author"),
        F.coalesce(short, content).alias("raw_summary"), F.coalesce(content, short).alias("content"), F.col("i.media:thumbnail._url").alias("raw_image"),
        F.coalesce("i.published", "i.updated").alias("raw_date"),
    )


def json_items(parsed: DataFrame) -> DataFrame:
    base = F.coalesce(absolute(F.col("x.home_page_url"), F.col("feed_url")), F.col("feed_url"))
    rows = parsed.select("feed_id", base.alias("base"), F.posexplode(F.slice("x.items", 1, MAX_ENTRIES)).alias("place", "i"))
    content = F.coalesce("i.content_html", F.when(F.col("i.content_text") != "", paragraphs(F.col("i.content_text"))))
    return rows.select(
        "feed_id", "place", "base", F.col("i.id").alias("guid"), F.coalesce("i.url", "i.external_url").alias("raw_url"), F.col("i.title").alias("raw_title"),
        F.coalesce(F.get("i.authors", F.lit(0))["name"], F.col("i.author.name")).alias("raw_author"), F.coalesce("i.summary", content).alias("raw_summary"), content.alias("content"),
        F.coalesce("i.image", "i.banner_image").alias("raw_image"), F.coalesce("i.date_published", "i.date_modified").alias("raw_date"),
    )


def entries(feeds: DataFrame) -> DataFrame:
    """Entries of feed documents (feed_id, feed_url, body); documents of no known format give none (see ``unreadable``)."""
    kinds = feeds.select("feed_id", "feed_url", "body", looks_like(F.col("body")).alias("kind"))
    of = lambda kind, schema: kinds.where(F.col("kind") == kind).withColumn("x", F.from_xml(F.regexp_replace("body", NOT_XML, ""), schema))
    site = lambda c: F.coalesce(absolute(text_or_null(F.col(c)), F.col("feed_url")), F.col("feed_url"))
    raw = [
        rss_items(of("rss", RSS), F.col("x.channel.item"), site("x.channel.link")),
        rss_items(of("rdf", RDF), F.col("x.item"), site("x.channel.link")),
        atom_items(of("atom", ATOM)),
        json_items(kinds.where("kind = 'json'").withColumn("x", F.from_json("body", JSON))),
    ]
    out = raw[0]
    for more in raw[1:]:
        out = out.unionByName(more)
    return finish(out)


def unreadable(feeds: DataFrame) -> DataFrame:
    """Documents that are no feed."""
    return feeds.where(looks_like(F.col("body")).isNull()).select("feed_id", F.lit("not a feed").alias("problem"))


def fresh(found: DataFrame, known: DataFrame) -> DataFrame:
    """New entries: the first of each (feed, guid), unless it is known."""
    first = found.withColumn("__rn", F.row_number().over(Window.partitionBy("feed_id", "guid").orderBy("place"))).where("__rn = 1").drop("__rn")
    return first.join(known.select("feed_id", "guid"), ["feed_id", "guid"], "left_anti")


def opml_feeds(documents: DataFrame) -> DataFrame:
    """(user_id, url, title, site_url, folder) of OPML documents (user_id, body): nested groups count as the outermost, the first of a URL stays."""
    import xml.etree.ElementTree as ET

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for user, body in zip(frame["user_id"], frame["body"], strict=True):
                try:
                    root = ET.fromstring(body or "")
                except ET.ParseError:
                    continue
                todo = [(node, None) for node in root.findall("./body/outline")][::-1]
                while todo:
                    node, folder = todo.pop()
                    url, name = node.get("xmlUrl"), node.get("title") or node.get("text")
                    if url and url.lower().startswith(("http://", "https://")):
                        out.append((user, len(out), url, name, node.get("htmlUrl"), folder))
                    todo += [(child, folder or name) for child in node.findall("outline")][::-1]
            yield pd.DataFrame(out, columns=["user_id", "place", "url", "title", "site_url", "folder"])

    rows = documents.select("user_id", "body").mapInPandas(run, "user_id long, place long, url string, title string, site_url string, folder string")
    return rows.groupBy("user_id", "url").agg(F.min_by(F.struct("title", "site_url", "folder"), "place").alias("f")).select("user_id", "url", "f.*")
