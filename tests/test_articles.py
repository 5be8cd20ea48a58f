"""The scored reader against a recursive version over trees that another parser makes, which measures again after each removal."""

from __future__ import annotations

import html as references
import re
import xml.etree.ElementTree as ET
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest

from quire.operators import articles, tokens

LONG = "This paragraph, which is long enough to count, has commas, and it ends well. "
URL = "https://example.com/a/page.html"
LINKS = '<ul><li><a href="/1">Related story number one, a teaser of some length</a></li><li><a href="/2">Related story number two, another teaser</a></li></ul>'


def page(body: str) -> str:
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


CASES = {
    1: page(f'<div class="menu"><p>{LONG * 3}</p></div><div id="story"><p>{LONG * 2}</p><p>{LONG}</p><p>Short end.</p></div><div><p>{LONG}</p></div>'),
    2: page(f'<div><div class="part"><p>{LONG * 4}</p></div><div class="part"><p>{LONG * 3}</p></div><p>A note beside it.</p><p>no stop</p><div class="sidebar"><p>{LONG * 5}</p></div></div>'),
    3: page(f'<section><div>{LONG * 2}<b>bold</b> tail, here</div>{LINKS}<p>{LONG}</p></section>'),
    4: page("<div><p>too short</p></div>"),
    5: page(f'<article class="post"><h1>Head</h1><p>{LONG * 2}</p><div class="promo-box-content"><p>Buy it now.</p></div><p hidden="hidden">{LONG}</p></article><div><p>{LONG * 9}</p></div>'),
    6: page(f'<main><table><tr><td colspan="2">{LONG}</td><td>{LONG * 2}</td></tr></table></main>'),
    7: page(f'<div><p>{LONG}</p><p><a href="/z">{LONG}</a></p></div><div><p>{LONG}</p></div>'),
    8: page(f'<div class="widget"><div><div><div><div><div><p>{LONG * 4}</p></div></div></div></div></div></div>'),
    # boxes that are mostly links until their list of links has gone
    9: page("<div id='story'><h2>Heading</h2>" + "".join(f"<div><p>{LONG}</p>{LINKS}{LINKS}</div>" for _ in range(4)) + "</div>"),
    # nested lists of links, boxes that are empty after it, and a picture that keeps its box
    10: page(f'<div class="entry"><p>{LONG * 3}</p><div><div>{LINKS}<div>{LINKS}</div></div></div><div><ul><li>{LINKS}</li></ul><img src="/i.png" alt=\'a "b" &amp; c\'></div><div class="tags"><p>Tags: one two</p>{LINKS}</div></div>'),
    # links around and inside links; words, stops and spaces that pass from run to run
    11: page(f'<div><p>{LONG}en<b>d</b>ed wi<i>th</i> <i> </i> pieces<b>.</b> More</p><p>A sent<b>ence.</b></p><a href="x"><div>{LONG}<a href="y">inner link text</a></div></a><p>{LONG}<a href="javascript:x()">no link</a><a href="mailto:a@b.c">mail</a></p></div>'),
    12: page(f'<div><p>{LONG}&amp;lt; &lt;b&gt; &#8212;&nbsp;x&#160;y</p><p><img data-src="lazy.jpg" src="data:x"><img srcset="s.png 1x, /l.png 2x"><img src="javascript:1"><span class="x">unwrapped</span><h1>One</h1></p><pre>  a\n   b  </pre></div>'),
    13: f'<base href="https://other.example/dir/"><body><div><p>{LONG}<a href="rel">r</a><p>{LONG}<ul><li>one, which has enough words to stay here<li>two</ul><p style="color: red; DISPLAY : none">{LONG}<p>{LONG}<br>x',
    14: page(f"<div><p>{LONG}</p><p title='a > b' title=second>{LONG} 1 < 2 <!-- no <b> --><?php no ?><script>'<p>'</script></p></div>"),
}


class Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = ET.Element("root")
        self.open, self.raw = [self.root], None

    def ended(self, *tags):
        if len(self.open) > 1 and self.open[-1].tag in tags:
            self.open.pop()

    def handle_starttag(self, tag, attrs):
        if self.raw or tag in tokens.RAW:
            self.raw = self.raw or tag
            return
        if tag in tokens.BLOCK:
            self.ended("p")
        if tag in ("td", "th", "tr"):
            self.ended("td", "th")
        if tag == "tr":
            self.ended("tr")
        if tag == "li":
            self.ended("li")
        if tag in ("dt", "dd"):
            self.ended("dt", "dd")
        e = ET.SubElement(self.open[-1], tag, {k: v or "" for k, v in reversed(attrs)})
        if tag not in tokens.VOID:
            self.open.append(e)

    def handle_endtag(self, tag):
        if self.raw:
            self.raw = None if tag == self.raw else self.raw
        elif tag in [e.tag for e in self.open[1:]]:
            while self.open.pop().tag != tag:
                pass

    def say(self, data):
        if self.raw:
            return
        e = self.open[-1]
        if len(e):
            e[-1].tail = (e[-1].tail or "") + data
        else:
            e.text = (e.text or "") + data

    handle_data = say

    def handle_entityref(self, name):
        self.say(f"&{name};")

    def handle_charref(self, name):
        self.say(f"&#{name};")


def expected(html: str, url: str = URL):
    """(html, text) of an article by recursion over a tree."""
    base = re.search(r"<base\s[^>]*href\s*=\s*[\"']?([^\"'\s>]+)", html)
    url = urljoin(url, base[1]) if base else url
    for tag in ("article", "main"):
        m = re.search(f"<{tag}[\\s>].*</{tag}>", html, re.S)
        if m and (tag != "article" or len(re.findall(r"<article[\s>]", html)) == 1):
            html = m[0]
            break
    tree = Tree()
    tree.feed(html)
    tree.close()
    root = next(tree.root.iter("body"), tree.root)
    names = lambda e: f"{e.get('class', '')} {e.get('id', '')}"

    def remove(e, c):
        at = list(e).index(c)
        if c.tail:
            if at:
                e[at - 1].tail = (e[at - 1].tail or "") + "\0" + c.tail  # texts stay apart
            else:
                e.text = (e.text or "") + "\0" + c.tail
        e.remove(c)

    def prune(e):
        for c in list(e):
            bad = re.search(articles.UNLIKELY, names(c), re.I) and not re.search(articles.MAYBE, names(c), re.I)
            hidden = "hidden" in c.attrib or re.search(r"display\s*:\s*none", c.get("style", ""), re.I)
            if c.tag in articles.DROP or hidden or (bad and c.tag not in ("body", "article", "main")):
                remove(e, c)
            else:
                prune(c)

    prune(root)
    up = {c: p for p in root.iter() for c in p}
    own = lambda t: sum(len(x.strip()) for x in (t or "").split("\0"))

    def size(e):
        total, linked = own(e.text), 0
        for c in e:
            a, b = size(c)
            total, linked = total + a + own(c.tail), linked + b
        return total, total if e.tag == "a" else linked

    density = lambda e: size(e)[1] / size(e)[0] if size(e)[0] else 0.0
    squashed = lambda e: " ".join(references.unescape("".join(e.itertext()).replace("\0", "")).split())
    weight = lambda e: 25 * bool(re.search(articles.POSITIVE, names(e), re.I)) - 25 * bool(re.search(articles.NEGATIVE, names(e), re.I))
    score: dict = {}
    for e in root.iter():
        if e is root or not (e.tag in ("p", "pre", "td") or (e.tag == "div" and not any(c.tag in tokens.BLOCK for c in e))) or len(squashed(e)) < 25:
            continue
        points, a = 1 + len(re.findall("[,，]", squashed(e))) + min(len(squashed(e)) // 100, 3), up.get(e)
        for level in range(5):
            if a is None:
                break
            if a.tag not in ("root", "html", "body"):
                start = next((s for s, tags in articles.BASE_SCORES.items() if a.tag in tags), 0) + weight(a)
                score[a] = score.get(a, start) + points / (1, 2, 6, 9, 12)[level]
            a = up.get(a)
    if not score:
        return None
    score = {e: s * (1 - density(e)) for e, s in score.items()}
    best = max(score, key=lambda e: round(score[e], 9))
    parent = up[best]
    content = best
    if parent.tag not in ("root", "body"):
        least = max(10, score[best] * 0.2)
        sentence = lambda e: e.tag == "p" and ((size(e)[0] > 80 and density(e) < 0.25) or (size(e)[0] and not density(e) and re.search(r"\.( |$)", squashed(e))))
        content = ET.Element("div")
        for e in [e for e in parent if e is best or score.get(e, -1e9) >= least or sentence(e)]:
            e.tail = None
            content.append(e)

    def tidy(e):
        for c in list(e):
            tidy(c)
            if c.tag in ("img", "br", "hr"):
                continue
            poor = c.tag in articles.TIDIED and ((density(c) > 0.5 and size(c)[0] < 400) or (weight(c) < 0 and size(c)[0] < 200))
            if poor or (not size(c)[0] and not any(x.tag == "img" for x in c.iter())):
                remove(e, c)

    tidy(content)

    def whole(value):
        out = urljoin(url, value.strip()) if value and value.strip() else ""
        return out if re.match("https?://", out) else None

    def text(e):
        line = "\n" if e.tag in articles.LINES else ""
        return line + (e.text or "") + "".join(text(c) + (c.tail or "") for c in e) + line

    decoded = lambda t: references.unescape((t or "").replace("\0", "").replace("&nbsp;", " "))
    plain = lambda t: references.escape(decoded(t), quote=False)
    value = lambda t: references.escape(t, quote=False).replace('"', "&quot;")

    def shown(e):
        out = plain(e.text)
        for c in e:
            tag, attrs = "h2" if c.tag == "h1" else c.tag, ""
            if tag == "img":
                sets = [x.split()[0] for x in (c.get("data-srcset") or c.get("srcset") or "").split(",") if x.split()]
                src = whole(next((c.get(k) for k in articles.LAZY if k in c.attrib), None) or (sets[-1] if sets else c.get("src")))
                out += (f'<img src="{value(src)}"' + (f' alt="{value(c.get("alt"))}"' if c.get("alt") else "") + ">" if src else "") + plain(c.tail)
                continue
            if tag == "a":
                attrs = f' href="{value(whole(c.get("href")))}"' if whole(c.get("href")) else None
            elif tag in ("td", "th") and c.get("colspan"):
                attrs = f' colspan="{c.get("colspan")}"'
            if tag not in articles.KEPT or attrs is None:
                out += shown(c)
            else:
                out += f"<{tag}{attrs}>" + (shown(c) + f"</{tag}>" if tag not in tokens.VOID else "")
            out += plain(c.tail)
        return out

    out = decoded(text(content))
    out = re.sub(r" *\n *", "\n", re.sub("[ \t\r ]+", " ", out))
    return shown(content).strip(), re.sub(r"\n{3,}", "\n\n", out).strip()


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([(k, h, URL) for k, h in [*CASES.items(), (90, None), (91, "")]], "page_id long, html string, url string")
    return {r.page_id: r for r in articles.read_articles(df, url_col="url").collect()}


@pytest.mark.parametrize("k", sorted(CASES))
def test_like_the_recursive_version(read, k):
    want = expected(CASES[k])
    assert ((read[k].html, read[k].text) if k in read else None) == want
    if want:
        assert read[k].words == len(want[1].split())


def test_boxes_with_related_links_keep_their_paragraphs(read):
    assert read[9].text.count(LONG.strip()) == 4 and "Related" not in read[9].text


def test_pages_without_text_have_no_article(read, spark):
    assert not {4, 90, 91} & set(read)
    assert articles.read_articles(spark.createDataFrame([], "page_id long, html string")).count() == 0


@pytest.mark.parametrize("query", ["scored_articles", "unmarked_articles"])
def test_all_pages_of_the_table(spark, query):
    from quire.plans import formats
    from quire.plans.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    html = {r.page_id: r for r in v.raw("pages").collect()}
    if query == "unmarked_articles":
        html = {k: type("P", (), {"html": re.sub(r"(?i)(</?)(?:article|main|nav|footer|header|aside)\b[^>]*>", r"\1div>", r.html), "url": r.url}) for k, r in html.items()}
    got = {r.page_id: (r.html, r.text) for r in getattr(formats, query)(v).collect()}
    want = {k: e for k, r in html.items() if (e := expected(r.html, r.url)) is not None}
    assert got == want and len(got) > 40


def test_long_and_deep_pages(spark):
    """A page of a hundred thousand tokens and one that nests ten thousand elements."""
    wide = page("<div>" + f"<p>{LONG}</p>" * 20_000 + "</div>")
    deep = page("<div><span>" * 5000 + f"<p>{LONG}</p>" + "</span></div>" * 5000)
    df = spark.createDataFrame([(1, wide), (2, deep)], "page_id int, html string")
    reader = articles.Reader(df)
    got = {r.page_id: r for r in reader.articles.collect()}
    assert got[1].text.count("This paragraph") >= 5000 and got[2].text == LONG.strip()
    reader.done()


def test_tokens_are_measured_in_one_shuffle_and_written_in_one(spark):
    """Elements were measured twice, and tokens joined and sorted again for each kind of mark: the time grew to more than its limit."""
    df = spark.createDataFrame([(k, h, URL) for k, h in CASES.items()], "page_id long, html string, url string")
    reader = articles.Reader(df, url_col="url")
    tokens_table = reader.tables[0].rsplit("/", 1)[-1]
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    measures = plan(articles.measured(spark.read.parquet(reader.tables[0])))
    assert measures.count("Exchange hashpartitioning") == 1 and measures.count("FileScan") == 1
    assert plan(reader.articles).count(tokens_table) == 1
    reader.done()


def test_spaces_that_are_not_ascii_and_pieces_of_words(spark):
    """Sizes, words and stops by lengths are those of the recursive version where spaces are not ASCII and words and sentences pass from text to text."""
    texts = ["\u3000one\u2003 two.", "three", "\u2003four. five", ".", "\u2028six，seven, eight.", "nine.\n"]
    body = "".join(f"<div><span>{a}</span>{b}<p>{a}{LONG}<i>{b}</i>{LONG}</p></div>" for a in texts for b in texts)
    got = articles.read_articles(spark.createDataFrame([(1, page(f"<div>{body}</div>"), URL)], "page_id long, html string, url string"), url_col="url").first()
    assert (got.html, got.text) == expected(page(f"<div>{body}</div>"))
