"""Page columns: preview metadata, feed links, and the readable article, all native expressions over the HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.texts import decode_named, strip_tags, words

MAX_PAGE, MAX_ARTICLE = 1_500_000, 400_000

# Where preview metadata stands, in order of preference, and what links to a feed.
TITLE_KEYS = ("og:title", "twitter:title")
DESCRIPTION_KEYS = ("og:description", "twitter:description", "description")
SITE_KEYS = ("og:site_name", "application-name")
AUTHOR_KEYS = ("author", "article:author", "parsely-author", "dc.creator")
IMAGE_KEYS = ("og:image:secure_url", "og:image", "og:image:url", "twitter:image", "twitter:image:src")
FEED_TYPES = ("application/rss+xml", "application/atom+xml", "application/rdf+xml", "application/feed+json", "application/json", "application/xml", "text/xml")
CHROME = ("aside", "button", "canvas", "dialog", "footer", "form", "header", "iframe", "nav", "object", "select", "script", "style", "textarea", "title", "noscript", "template", "svg")
BLOCK_ENDS = "p|div|li|h[1-6]|pre|blockquote|tr|table|ul|ol|section|figure|br"


def clean(value: Column, most: int) -> Column:
    """Decoded, with single spaces; null if empty; cut with an ellipsis."""
    text = F.trim(F.regexp_replace(decode_named(value), "\\s+", " "))
    return F.when(text == "", None).when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in the text of a tag; null if it is not there."""
    quoted = F.regexp_extract(tag, f"(?i)\\s{name}\\s*=\\s*(?:\"([^\"]*)\"|'([^']*)'|([^\\s\"'=<>`]+))", 0)
    value = F.regexp_replace(quoted, "(?s)^[^=]*=\\s*[\"']?|[\"']$", "")
    return F.when(quoted != "", value)


def without_comments(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, "(?s)<!--.*?-->", ""), "(?is)<script\\b.*?</script>", "")


def absolute(href: Column, base: Column) -> Column:
    """An http(s) link seen from a page: whole, from the scheme, from the root, or beside the page."""
    link = F.trim(decode_named(href))
    origin = F.regexp_extract(base, "^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, "^(https?://[^?#]+)", 1), "(?<=[^/:])/[^/]*$", "")
    whole = (
        F.when(link.rlike("(?i)^https?://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.substring_index(base, "//", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(origin, link))
        .when(~link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:") & (link != ""), F.concat(folder, F.lit("/"), link))
    )
    return F.when(base.rlike("^https?://") | link.rlike("(?i)^https?://"), whole)


def metadata(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Preview metadata from the head: of repeated keys the first counts, of several keys the preferred one."""
    head = F.substring_index(F.substring(html_col, 1, 512_000), "</head>", 1)
    source = without_comments(head)
    tags = F.regexp_extract_all(source, F.lit("(?i)<meta\\b([^>]*)>"), F.lit(1))
    pairs = F.transform(tags, lambda t: F.struct(F.lower(F.coalesce(attribute(t, "property"), attribute(t, "name"), attribute(t, "itemprop"))).alias("k"), attribute(t, "content").alias("v")))
    known = F.filter(pairs, lambda p: p["k"].isNotNull() & (p["v"] != ""))
    links = F.regexp_extract_all(source, F.lit("(?i)<link\\b([^>]*)>"), F.lit(1))
    rows = pages.select(id_col, F.col(url_col).alias("__url"), known.alias("__meta"), links.alias("__links"), F.regexp_extract(source, "(?is)<title\\b[^>]*>(.*?)</title>", 1).alias("__title"))

    def first(*keys: str) -> Column:
        found = lambda key: F.get(F.filter("__meta", lambda p: p["k"] == key), F.lit(0))["v"]
        return F.coalesce(*map(found, keys))

    def link(rel: str) -> Column:
        fits = lambda t: F.array_contains(F.split(F.lower(F.coalesce(attribute(t, "rel"), F.lit(""))), "\\s+"), rel) & (attribute(t, "href") != "")
        return attribute(F.get(F.filter("__links", fits), F.lit(0)), "href")

    author = first(*AUTHOR_KEYS)
    base = F.col("__url")
    return rows.select(
        id_col,
        clean(F.coalesce(first(*TITLE_KEYS), F.col("__title")), 300).alias("title"),
        clean(first(*DESCRIPTION_KEYS), 1000).alias("description"),
        clean(first(*SITE_KEYS), 120).alias("site_name"),
        F.when(~author.rlike("(?i)^https?://"), clean(author, 120)).alias("author"),
        absolute(first(*IMAGE_KEYS), base).alias("image_url"),
        absolute(F.coalesce(link("apple-touch-icon"), link("icon"), F.lit("/favicon.ico")), base).alias("favicon_url"),
        absolute(F.coalesce(link("canonical"), first("og:url")), base).alias("canonical_url"),
    )


def feed_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, place, feed): the feeds a page names, each once, comment feeds last."""
    tags = F.regexp_extract_all(without_comments(F.col(html_col)), F.lit("(?i)<link\\b([^>]*)>"), F.lit(1))
    kind = lambda t: F.lower(F.substring_index(F.coalesce(attribute(t, "type"), F.lit("")), ";", 1))
    fits = lambda t: (
        F.array_contains(F.split(F.lower(F.coalesce(attribute(t, "rel"), F.lit(""))), "\\s+"), "alternate")
        & kind(t).isin(*FEED_TYPES)
        & ((kind(t) != "application/json") | F.contains(F.lower(attribute(t, "href")), F.lit("feed")))
    )
    found = pages.select(id_col, F.col(url_col).alias("__url"), F.posexplode(F.filter(tags, fits)).alias("place", "tag"))
    urls = found.select(id_col, "place", absolute(attribute(F.col("tag"), "href"), F.col("__url")).alias("feed")).where("feed is not null")
    once = urls.groupBy(id_col, "feed").agg(F.min("place").alias("place"))
    return once.withColumn("comments", F.contains(F.lower("feed"), F.lit("comment")))


def focus(html: Column) -> Column:
    """What stands inside the only article element, else inside main, else the body."""
    page = F.substring(html, 1, MAX_PAGE)
    only = F.size(F.regexp_extract_all(page, F.lit("(?i)<article[\\s>]"), F.lit(0))) == 1
    inside = lambda tag: F.regexp_extract(page, f"(?is)<{tag}\\b[^>]*>(.*)</{tag}>", 1)
    return F.coalesce(F.when(only & (inside("article") != ""), inside("article")), F.nullif(inside("main"), F.lit("")), F.nullif(inside("body"), F.lit("")), page)


def without_chrome(html: Column) -> Column:
    """Without elements that are never part of an article: navigation, forms, embedded and hidden things."""
    text = F.regexp_replace(html, "(?s)<!--.*?-->", "")
    for tag in CHROME:
        text = F.regexp_replace(text, f"(?is)<{tag}\\b[^>]*>.*?</{tag}>", " ")
    return text


def blocks(html: Column) -> Column:
    """Texts of the blocks of an article: split where blocks begin or end; link-heavy and empty ones left out."""
    pieces = F.split(without_chrome(focus(html)), f"(?i)</?(?:{BLOCK_ENDS})\\b[^>]*>")
    made = F.transform(pieces, lambda p: F.struct(strip_tags(p).alias("text"), F.length(strip_tags(F.array_join(F.regexp_extract_all(p, F.lit("(?is)<a\\b[^>]*>(.*?)</a>"), F.lit(1)), " "))).alias("linked")))
    return F.transform(F.filter(made, lambda b: (b["text"] != "") & (b["linked"] * 2 <= F.length(b["text"]))), lambda b: b["text"])


def articles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, words) of the readable part of every page."""
    text = F.substring(F.array_join(blocks(F.col(html_col)), "\n\n"), 1, MAX_ARTICLE)
    return pages.select(id_col, text.alias("text")).withColumn("words", words(F.col("text")))
