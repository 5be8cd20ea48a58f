"""Posts as safe markup: rebuilt from tokens, so nothing stands in the result that was not written by it.

Pages become tokens (``tokens.py``), elements that carry code or forms go with their contents, other unknown elements are unwrapped, and what
is kept is written anew: known elements and attributes only, every value escaped, links of known schemes seen from the post's address.  Elements are
closed where they end, so a stray end tag cannot close what stands around the post.  Null posts stay null; ids are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.pages import absolute
from quire.operators.articles import attribute
from quire.operators.tokens import OPEN, TEXT, VOID, tokens

# What a stored post may hold.
TAGS = "a abbr b blockquote br caption cite code dd del details div dl dt em figcaption figure h1 h2 h3 h4 h5 h6 hr i img ins kbd li mark ol p pre q s samp small span strong sub summary sup table tbody td tfoot th thead time tr u ul".split()
ATTRIBUTES = {
    "a": ("href", "title"), "abbr": ("title",), "blockquote": ("cite",), "img": ("src", "alt", "title", "width", "height"), "ol": ("start",),
    "td": ("colspan", "rowspan"), "th": ("colspan", "rowspan", "scope"), "time": ("datetime",),
}
EMPTIED = frozenset("script style iframe noscript svg math form object embed template".split())
RAW = frozenset("script style noscript template svg iframe".split())
LINK_EXTRAS = ' target="_blank" rel="noopener noreferrer nofollow"'
IMAGE_EXTRAS = ' loading="lazy" decoding="async" referrerpolicy="no-referrer"'


def escaped(text: Column) -> Column:
    for char, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def shown(base: Column) -> Column:
    """The token as markup."""
    tag = F.col("tag")

    def value(of: str, name: str) -> Column:
        raw = attribute(name)
        if (of, name) == ("a", "href"):
            mail = F.trim(raw)
            return F.coalesce(absolute(raw, base), F.when(mail.rlike("(?i)^mailto:"), mail))
        return absolute(raw, base) if name in ("src", "cite") else raw

    def written(of: str, name: str) -> Column:
        extras = {"href": LINK_EXTRAS, "src": IMAGE_EXTRAS}.get(name, "")
        given = value(of, name)
        # an ampersand in a value is escaped too, so that the value reads back as it was
        safe = escaped(F.replace(given, F.lit("&"), F.lit("&amp;")))
        return F.coalesce(F.concat(F.lit(f' {name}="'), safe, F.lit(f'"{extras}')), F.lit(""))

    attrs = F.lit("")
    for of, names in ATTRIBUTES.items():
        attrs = F.when(tag == of, F.concat(*[written(of, n) for n in names])).otherwise(attrs)
    opening = F.concat(F.lit("<"), tag, attrs, F.lit(">"))
    closing = F.when(tag.isin(*VOID), "").otherwise(F.concat(F.lit("</"), tag, F.lit(">")))
    text = F.replace(F.replace(F.col("text"), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.when(F.col("kind") == TEXT, text).when(~tag.isin(*TAGS), "").when(F.col("kind") == OPEN, opening).otherwise(closing)


def sanitized(posts: DataFrame, id_col: str, html_col: str, url_col: str) -> DataFrame:
    """(id, html) of every post, safe to show."""
    rows = tokens(posts, id_col, html_col, lambda tag, attrs: tag in EMPTIED, RAW, in_body=False)
    bases = posts.select(F.col(id_col).alias("id"), F.col(url_col).alias("base"), F.col(html_col).isNotNull().alias("there"))
    pieces = rows.join(bases, "id").select("id", "place", shown(F.col("base")).alias("piece")).where("piece <> ''")
    joined = pieces.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "piece"))), lambda p: p["piece"]), "").alias("html"))
    return bases.join(joined, "id", "left").select(F.col("id").alias(id_col), F.when(F.col("there"), F.trim(F.coalesce("html", F.lit("")))).alias("html"))


def without_opening_image(html: Column, image_url: Column) -> Column:
    """The markup without the picture that a reader shows above it, if it stands before the end of the second paragraph."""
    path = F.regexp_extract(image_url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    found = F.get(F.filter(F.regexp_extract_all(html, F.lit(r"(?i)(<img\b[^>]*>)")), lambda t: F.contains(t, path)), F.lit(0))
    before = F.call_function("substring_index", html, found, F.lit(1))
    rest = F.substr(html, F.length(before) + F.length(found) + 1)
    cut = F.trim(F.regexp_replace(F.concat(before, rest), r"<(figure|p)>\s*</\1>", ""))
    fits = image_url.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://") & found.isNotNull() & (F.regexp_count(before, F.lit("</p>")) <= 1)
    return F.when(fits, cut).otherwise(html)
