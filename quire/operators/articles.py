"""The readable part of a page, found by scores: for pages that name no article as well as for those that do.

Pages become tokens (``tokens.py``); what can be no part of an article is left out in that scan.  Elements have numbers where they open and close, so
sizes, words, commas and ends of sentences of all elements are differences of running sums over the tokens: text is read once, whatever
it is nested in.  Paragraphs give points to the five elements above them, the best element of each page is chosen with those beside it that are
as good.  Then link lists and poor or empty boxes go, from the leaves upward: an element is judged by what is left in it.  What stays is
written as text and as markup of a few elements and attributes, with whole addresses.

A page is parsed up to MAX_PAGE characters, which bounds what one page has.  Page ids are unique; pages may be null or empty.  A page without a
paragraph of 25 characters has no article and no row.  Sizes count code points.  Tokens and elements are written tables, deleted with ``done``.
"""

from __future__ import annotations

import functools
import re
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.pages import MAX_ARTICLE, MAX_PAGE, absolute
from quire.functions.texts import decode_named, words
from quire.operators.tokens import BLOCK, CLOSE, OPEN, TEXT, VOID, tokens
from quire.sources.scratch import scratch

# Elements by what they do, and names that speak for or against an element.
DROP = frozenset("aside button canvas dialog embed footer form header iframe input link meta nav object select base".split())
UNLIKELY = "-ad-|ad-break|agegate|banner|breadcrumb|combx|comment|community|cookie|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|modal|newsletter|pager|pagination|popup|promo|related|remark|replies|rss|share|shoutbox|sidebar|skyscraper|social|sponsor|subscribe|supplemental|yom-remote"
MAYBE = "and|article|body|column|content|main|shadow"
POSITIVE = "article|body|content|entry|h-entry|hentry|main|page|post|story|text|blog"
NEGATIVE = "-ad-|banner|combx|comment|com-|contact|foot|footnote|gdpr|hidden|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|tool|widget"
KEPT = frozenset("a abbr b blockquote br caption cite code dd del div dl dt em figcaption figure h2 h3 h4 h5 h6 hr i img ins kbd li mark ol p pre q s small strong sub sup table tbody td tfoot th thead tr u ul".split())
TIDIED = ("div", "section", "ul", "ol", "table", "p")
BASE_SCORES = {5: ("div", "article", "main", "section"), 3: ("pre", "td", "blockquote"), -3: ("ol", "ul", "dl", "dd", "dt", "li"), -5: ("h1", "h2", "h3", "h4", "h5", "h6", "th")}
# points for the five elements above, in 36ths: 1, 1/2, 1/6, 1/9, 1/12
SHARES, WHOLE = (36, 18, 6, 4, 3), 36

NEVER, PERHAPS = re.compile(UNLIKELY, re.I), re.compile(MAYBE, re.I)
LINES = sorted(BLOCK | {"li", "br", "tr"})
SPACE = "[\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: the characters of SPACE
SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
LAZY = ("data-src", "data-original", "data-lazy-src")


def declared(style: str) -> dict[str, str]:
    """The declarations of a style attribute; later ones count."""
    pairs = (d.partition(":") for d in style.lower().split(";"))
    return {name.strip(): value.strip() for name, _, value in pairs}


def left_out(tag: str, attrs: dict[str, str]) -> bool:
    """Elements that are never part of an article: by what they are, hidden ones, and those whose names say so."""
    if tag in DROP or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in ("navigation", "dialog"):
        return True
    style = declared(attrs.get("style", ""))
    if style.get("display", "").startswith("none") or style.get("visibility", "").startswith("hidden"):
        return True
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    return tag not in ("body", "article", "main") and bool(NEVER.search(names)) and not PERHAPS.search(names)


def focused(html: Column) -> Column:
    """The only article element, else main, else the whole page."""
    page = F.substring(html, 1, MAX_PAGE)
    element = lambda tag: F.nullif(F.regexp_extract(page, f"(?is)<{tag}[\\s>].*</{tag}>", 0), F.lit(""))
    return F.coalesce(F.when(F.regexp_count(page, F.lit("(?i)<article[\\s>]")) == 1, element("article")), element("main"), page)


def weight(names: Column) -> Column:
    speaks = lambda pattern: F.when(names.rlike(f"(?i){pattern}"), 25).otherwise(0)
    return speaks(POSITIVE) - speaks(NEGATIVE)


def base_score(tag: Column, names: Column) -> Column:
    base = F.lit(0)
    for points, tags in BASE_SCORES.items():
        base = F.when(tag.isin(*tags), points).otherwise(base)
    return base + weight(names)


def attribute(name: str) -> Column:
    """The value of an attribute of the token; null if it has none."""
    return F.get(F.filter("attrs", lambda a: a["name"] == name), F.lit(0))["value"]


def measured(rows: DataFrame) -> DataFrame:
    """One row an element: where it opens and closes, and what its text and the links in it have, from running sums over the tokens of its page."""
    # each pattern once a text; the counts come from lengths
    spaced = rows.withColumn("decoded", decode_named(F.col("text"))).withColumn("plain", F.regexp_replace("decoded", f"{SPACE}+", " "))
    without = lambda text, *parts: functools.reduce(lambda t, p: F.replace(t, F.lit(p), F.lit("")), parts, text)
    plain, there = F.col("plain"), F.col("plain") != ""
    known = spaced.select(
        "id", "place", "kind", "node", "parent", "tag", "attrs", "alone", "above", "level",
        F.length(F.btrim("text", F.lit(SPACES))).alias("size"),
        F.length(without(plain, " ")).alias("solid"), F.length(plain).alias("whole"),
        (F.length(plain) - F.length(without(plain, ",", "，"))).alias("commas"),
        F.floor((F.length(plain) - F.length(without(plain, ". "))) / 2).alias("stops"),
        F.when(there, F.startswith(plain, F.lit(" "))).alias("opens"),  # begins with space; null for what is no text
        F.when(there, F.endswith(plain, F.lit(" "))).alias("shuts"),
        F.when(there, F.endswith(plain, F.lit("."))).alias("dot"),
    )
    number = lambda c: F.col(c).cast("int")
    facts = known.withColumn("words", F.when(F.col("solid") > 0, F.col("whole") - F.col("solid") + 1 - number("opens") - number("shuts")))
    onward = Window.partitionBy("id").orderBy("place")
    before, upto = onward.rowsBetween(Window.unboundedPreceding, -1), onward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a word that goes on from the text before is none of its own; a stop before the next text's space ends a sentence
    joined = facts.withColumns({"shut": F.last("shuts", True).over(before), "then": F.expr("lead(opens) ignore nulls over (partition by id order by place)")})
    goes_on = lambda opens: ~F.col(opens) & ~F.coalesce("shut", F.lit(True))
    ended = F.when(F.col("dot") & F.coalesce("then", F.lit(True)), 1).otherwise(0)
    summed = joined.select(
        "id", "place", "kind", "node", "parent", "tag", "attrs", "alone", "above", "level", goes_on("then").alias("first_goes_on"),
        *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in ("size", "solid", "commas")],
        F.coalesce(F.sum(F.col("stops") + ended).over(upto), F.lit(0)).alias("stops"),
        F.coalesce(F.sum(F.col("words") - F.when(goes_on("opens"), 1).otherwise(0)).over(upto), F.lit(0)).alias("words"),
        F.last("dot", True).over(upto).alias("dot"),
    ).where(F.col("kind") != TEXT)
    # the outermost links inside an element have as many links above them as the element has
    link = F.col("tag") == "a"
    running = F.sum(F.when(link, F.when(F.col("kind") == CLOSE, F.col("size")).otherwise(-F.col("size"))).otherwise(0))
    linked = summed.withColumn("inside", running.over(Window.partitionBy("id", "level").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    names = F.concat_ws(" ", F.coalesce(attribute("class"), F.lit("")), F.coalesce(attribute("id"), F.lit("")))
    whole = linked.withColumn("names", F.when(F.col("kind") == OPEN, names)).groupBy("id", "node").agg(
        F.first("parent").alias("parent"), F.first("tag").alias("tag"), F.max("names").alias("names"), at("alone", CLOSE).alias("alone"), F.first("above", True).alias("above"), F.first("level").alias("level"),
        at("place", OPEN).alias("enter"), at("place", CLOSE).alias("leave"), at("first_goes_on", OPEN).alias("first_goes_on"), at("dot", CLOSE).alias("dot"),
        *[(at(c, CLOSE) - at(c, OPEN)).alias(c) for c in ("size", "solid", "commas", "stops", "words", "inside")],
    )
    length = F.when(F.col("solid") > 0, F.col("solid") + F.col("words") + F.when(F.col("first_goes_on"), 1).otherwise(0) - 1).otherwise(0)
    found = whole.select(
        "id", "node", "parent", "tag", "names", "alone", "above", "level", "enter", "leave", "size", "commas", length.alias("length"),
        ((F.col("stops") > 0) | ((F.col("solid") > 0) & F.coalesce("dot", F.lit(False)))).alias("ends"),
        F.when(link, F.col("size")).otherwise(F.col("inside")).alias("linked"),
    )
    return found.withColumn("density", F.when(F.col("size") > 0, F.col("linked") / F.col("size")).otherwise(0.0))


def scores(found: DataFrame) -> DataFrame:
    """(id, node, score, seen): the points that paragraphs give to the elements above them, less what is links."""
    paragraph = F.col("tag").isin("p", "pre", "td") | ((F.col("tag") == "div") & F.col("alone"))
    points = 1 + F.col("commas") + F.least(F.floor(F.col("length") / 100), F.lit(3))
    given = found.where(paragraph & (F.col("length") >= 25)).select("id", F.col("enter").alias("from"), points.alias("points"), F.posexplode("above").alias("step", "el"))
    share = F.get(F.array(*map(F.lit, SHARES)), F.col("step"))
    # whole numbers, so that sums are the same in any order
    summed = (
        given.where(~F.col("el.tag").isin("html", "body"))
        .groupBy("id", F.col("el.node").alias("node"))
        .agg(F.sum(F.col("points") * share).alias("points"), F.min(F.struct("from", "step")).alias("seen"))
    )
    score = (base_score(F.col("tag"), F.col("names")) + F.col("points") / WHOLE) * (1 - F.col("density"))
    return summed.join(found.select("id", "node", "tag", "names", "density"), ["id", "node"]).select("id", "node", score.alias("score"), "seen")


def chosen(found: DataFrame) -> DataFrame:
    """(id, node, enter, leave, bare): the elements that are a page's article, side by side; bare: one alone, whose own tag does not count."""
    scored = found.join(scores(found), ["id", "node"], "left")
    order = F.struct("score", -F.col("seen.from"), -F.col("seen.step"), "node", "parent", F.get("above", F.lit(0))["tag"].alias("inside"))
    best = scored.where("score is not null").groupBy("id").agg(F.max(order).alias("best"))
    beside = (F.col("best.parent") >= 0) & (F.col("best.inside") != "body")
    sentence = (F.col("tag") == "p") & (((F.col("size") > 80) & (F.col("density") < 0.25)) | ((F.col("size") > 0) & (F.col("density") == 0) & F.col("ends")))
    good = F.coalesce(F.col("score") >= F.greatest(F.lit(10.0), F.col("best.score") * 0.2), F.lit(False)) | sentence
    kept = (F.col("node") == F.col("best.node")) | (beside & (F.col("parent") == F.col("best.parent")) & good)
    return scored.join(best, "id").where(kept).select("id", "node", "enter", "leave", (~beside).alias("bare"))


def left_over(table: pa.Table) -> pa.Table:
    """The elements of an article that go, each judged by what is left of those in it."""
    rows = sorted(table.to_pylist(), key=lambda r: r["leave"])
    under, size, linked, image, gone = (defaultdict(int) for _ in range(5))
    for r in rows:
        n, up = r["node"], r["parent"]
        left = r["size"] - under[n] + size[n]
        links = left if r["tag"] == "a" else linked[n]
        pictured = r["tag"] == "img" or image[n]
        if r["tag"] not in ("img", "br", "hr") and not r["bare"]:
            poor = r["boxed"] and ((left and links / left > 0.5 and left < 400) or (r["against"] and left < 200))
            gone[n] = (not left and not pictured) or poor
        under[up] += r["size"]
        if not gone[n]:
            size[up] += left
            linked[up] += links
            image[up] |= pictured
    out = [r for r in rows if gone[r["node"]]]
    return pa.table({"id": pa.array([r["id"] for r in out], table.schema.field("id").type), "enter": pa.array([r["enter"] for r in out], pa.int32()), "leave": pa.array([r["leave"] for r in out], pa.int32())})


def bounds(marks: DataFrame, name: str, outside: Column) -> DataFrame:
    """Two rows an element of ``marks``, which sort around its tokens (``outside``: or right inside them): ``name`` goes up by one and down again."""
    step = F.when(outside, 1).otherwise(-1)
    ends = F.array(F.struct(F.col("enter").alias("place"), step.alias("step"), F.lit(1).alias(name)), F.struct(F.col("leave").alias("place"), (-step).alias("step"), F.lit(-1).alias(name)))
    return marks.select("id", F.inline(ends))


def escaped(text: Column, quotes: bool = False) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *([('"', "&quot;")] if quotes else [])):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def addressed(pieces: DataFrame) -> DataFrame:
    """The tokens with ``href`` of links and ``source`` of pictures, as whole addresses."""
    sets = F.coalesce(attribute("data-srcset"), attribute("srcset"))
    candidates = F.filter(F.transform(F.split(sets, ","), lambda c: F.regexp_extract(c, "(\\S+)", 1)), lambda c: c != "")
    source = F.coalesce(*map(attribute, LAZY), F.element_at(F.nullif(candidates, F.array().cast("array<string>")), -1), attribute("src"))
    # one address a token: ``absolute`` names it many times
    given = pieces.withColumn("given", F.when(F.col("tag") == "a", attribute("href")).when((F.col("tag") == "img") & (F.col("kind") == OPEN), source))
    return given.withColumn("address", F.when(F.col("given").isNotNull(), absolute(F.col("given"), F.col("base")))).drop("given")


def markup() -> Column:
    """The token as markup of the kept elements: links and pictures by whole addresses, headings from the second on."""
    tag = F.when(F.col("tag") == "h1", "h2").otherwise(F.col("tag"))
    address = F.col("address")
    given = lambda name, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f' {name}="'), escaped(value, True), F.lit('"'))).otherwise("")
    attrs = F.when(F.col("tag") == "a", given("href", address)).when(F.col("tag").isin("td", "th"), given("colspan", attribute("colspan"))).otherwise("")
    opening = (
        F.when((F.col("tag") == "img") & address.isNull(), "")
        .when(F.col("tag") == "img", F.concat(F.lit("<img"), given("src", address), given("alt", attribute("alt")), F.lit(">")))
        .otherwise(F.concat(F.lit("<"), tag, attrs, F.lit(">")))
    )
    unwrapped = ~tag.isin(*KEPT) | ((F.col("tag") == "a") & address.isNull())
    closing = F.when(tag.isin(*VOID), "").otherwise(F.concat(F.lit("</"), tag, F.lit(">")))
    return F.when(F.col("kind") == TEXT, escaped(decode_named(F.col("text")))).when(unwrapped, "").when(F.col("kind") == OPEN, opening).otherwise(closing)


def tidied(text: Column) -> Column:
    """Plain text with single spaces and at most one blank line."""
    for pattern, new in (("[ \\t\\r\\f\\x0b\u00a0]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, new)
    return F.btrim(text, F.lit(SPACES))


class Reader:
    """The articles of pages; its tables can be deleted when the result has been used."""

    def __init__(self, pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = None) -> None:
        self.spark, self.id_col, self.tables = pages.sparkSession, id_col, []
        page = F.substring(html_col, 1, MAX_PAGE)
        base = F.regexp_extract(page, "(?i)<base\\s[^>]*href\\s*=\\s*[\"']?([^\"'\\s>]+)", 1)
        url = F.col(url_col) if url_col else F.lit(None).cast("string")
        linked = pages.select(F.col(id_col).alias("id"), F.nullif(base, F.lit("")).alias("named"), url.alias("url"))
        bases = linked.select("id", F.when(F.col("named").isNull(), F.col("url")).otherwise(F.coalesce(absolute(F.col("named"), F.col("url")), "url")).alias("base"))
        rows = self.written(tokens(pages.select(F.col(id_col).alias("id"), focused(F.col(html_col)).alias("html")), "id", "html", left_out), "tokens")
        found = self.written(measured(rows), "elements")
        kept = self.written(chosen(found), "kept")
        # kept elements stand side by side, so the last one that opened holds an element or none does
        held = F.max("until").over(Window.partitionBy("id").orderBy("enter").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        judged = found.join(kept.select("id", "node", "bare", F.col("leave").alias("until")), ["id", "node"], "left").withColumn("held", held).where("held >= leave")
        facts = judged.select("id", "node", "parent", "tag", "enter", "leave", "size", F.coalesce("bare", F.lit(False)).alias("bare"), F.col("tag").isin(*TIDIED).alias("boxed"), (weight(F.col("names")) < 0).alias("against"))
        kind = pages.schema[id_col].dataType.simpleString()
        gone = facts.groupBy("id").applyInArrow(left_over, f"id {kind}, enter int, leave int")
        # the bounds of elements are sorted in between the tokens; a bare element's own tags are outside
        marked = rows.select("id", "place", "kind", "tag", "attrs", "text", F.lit(0).alias("step"))
        for more in (bounds(kept, "inside", F.col("bare")), bounds(gone, "lost", F.lit(False))):
            marked = marked.unionByName(more, allowMissingColumns=True)
        upto = Window.partitionBy("id").orderBy("place", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = marked.select("id", "place", "kind", "tag", "attrs", "text", F.sum("inside").over(upto).alias("within"), F.coalesce(F.sum("lost").over(upto), F.lit(0)).alias("lost"), "inside")
        # bounds stay as empty pieces, so that an article of nothing has its row
        own = summed.where("inside is not null or (kind is not null and within > 0 and lost = 0)").join(bases, "id")
        line = F.when(F.col("kind") == TEXT, F.col("text")).when(F.col("tag").isin(*LINES), "\n").otherwise("")
        pieces = addressed(own).select("id", "place", F.coalesce(markup(), F.lit("")).alias("html"), line.alias("text"))
        joined = pieces.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "html", "text"))).alias("pieces"))
        whole = lambda c: F.array_join(F.col(f"pieces.{c}"), "")
        texts = joined.select("id", F.substring(F.btrim(whole("html"), F.lit(SPACES)), 1, MAX_ARTICLE).alias("html"), decode_named(whole("text")).alias("text"))
        self.articles = texts.select(F.col("id").alias(id_col), "html", tidied(F.col("text")).alias("text")).withColumn("words", words(F.col("text")))

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """The same rows, read from a table in the shared folder."""
        where = f"{scratch(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.tables.append(where)
        df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def done(self) -> None:
        """Delete the written tables; the articles cannot be read after that."""
        for where in self.tables:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_articles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = None) -> DataFrame:
    """(id, html, text, words) of the article of every page that has one."""
    return Reader(pages, id_col, html_col, url_col).articles
