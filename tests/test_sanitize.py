"""Safe markup: hostile posts, nested elements of one name, broken attributes, and the test pages against another parser."""

import re
from html.parser import HTMLParser

import pytest

from quire.operators import sanitize
from quire.operators.sanitize import ATTRIBUTES, EMPTIED, TAGS, sanitized, without_opening_image

URL = "https://example.com/a/b.html"
LINK = 'target="_blank" rel="noopener noreferrer nofollow"'
CASES = {
    "<p>a<script>alert('<p>x</p>')</script>b": "<p>ab</p>",
    "<scr<script>ipt>alert(1)</scr</script>ipt>": "ipt&gt;alert(1)ipt&gt;",
    "<div><div>in</div>out</div></div><p>x": "<div><div>in</div>out</div><p>x</p>",
    "<form><form>a</form>b</form>c": "c",
    '<a href="javascript:alert(1)" onclick=x>t</a>': "<a>t</a>",
    '<a href=" java\nscript:x">t</a>': None,  # stays a path, never a scheme
    '<a href="/x?a=1&amp;b=2" title=\'"q" <i>\'>t</a>': f'<a href="https://example.com/x?a=1&amp;b=2" {LINK} title="&quot;q&quot; &lt;i&gt;">t</a>',
    '<a HREF="mailto:a@b.c">m</a>': f'<a href="mailto:a@b.c" {LINK}>m</a>',
    '<img src="x.png" onerror=alert(1) width="3" style="x">': '<img src="https://example.com/a/x.png" loading="lazy" decoding="async" referrerpolicy="no-referrer" width="3">',
    '<img src="data:image/png;base64,x" alt="a>b">': '<img alt="a&gt;b">',
    '<img src="x" title="a"b" onload="y">': None,
    '<p title="not closed>text</p>': "&lt;p title=\"not closed&gt;text",
    "1 < 2 & 3 &lt;b&gt; <!-- <b> --><!DOCTYPE x><?p ?>": "1 &lt; 2 & 3 &lt;b&gt;",
    "<svg><script>x</script><a href='x'>y</a></svg>z": "z",
    "<math><mi>x</mi></math><iframe src=x><p>in</p></iframe>z": "z",
    "<textarea><b>t</b></textarea><custom-tag>c</custom-tag><title>u</title>": "<b>t</b>cu",
    "<ul><li>a<li>b</ul><table><tr><td colspan=2>c<td>d<tr><th scope=row>e": '<ul><li>a</li><li>b</li></ul><table><tr><td colspan="2">c</td><td>d</td></tr><tr><th scope="row">e</th></tr></table>',
    "<<b>x</b>": "&lt;<b>x</b>",
    "<b/>x<br/>": "<b></b>x<br>",
    '<blockquote cite="vbscript:x">q</blockquote><ol start="3" type="a"><li>x</ol>': '<blockquote>q</blockquote><ol start="3"><li>x</li></ol>',
    "": "",
}


class Shape(HTMLParser):
    """What a browser would see in the result."""

    def __init__(self):
        super().__init__()
        self.seen, self.open = [], []

    def handle_starttag(self, tag, attrs):
        self.seen.append((tag, dict(attrs)))
        if tag not in ("br", "hr", "img"):
            self.open.append(tag)

    def handle_endtag(self, tag):
        assert self.open.pop() == tag


def harmless(html):
    shape = Shape()
    shape.feed(html)
    assert not shape.open
    for tag, attrs in shape.seen:
        assert tag in TAGS and tag not in EMPTIED
        assert set(attrs) <= {*ATTRIBUTES.get(tag, ()), "target", "rel", "loading", "decoding", "referrerpolicy"}
        for name in {"href", "src", "cite"} & set(attrs):
            assert re.match("https?://|mailto:", attrs[name])


@pytest.fixture(scope="module")
def made(spark):
    df = spark.createDataFrame([(k, h, URL) for k, h in enumerate([*CASES, None])], "k int, body string, url string")
    return [r.html for r in sanitized(df, "k", "body", "url").orderBy("k").collect()]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_cases(made, k):
    want = list(CASES.values())[k]
    harmless(made[k])
    assert want is None or made[k] == want


def test_null(made):
    assert made[-1] is None


def test_own_result_stays(spark, made):
    """What is safe is left as it is, but that ampersands of values are read and written again."""
    df = spark.createDataFrame([(k, h, URL) for k, h in enumerate(made[:-1])], "k int, body string, url string")
    assert [r.html for r in sanitized(df, "k", "body", "url").orderBy("k").collect()] == made[:-1]


def test_pages(spark):
    from quire.plans import formats
    from quire.plans.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    pages = {r.page_id: r for r in v.raw("pages").collect()}
    got = {r.page_id: r for r in formats.sanitized_pages(v).collect()}
    assert set(got) == set(pages)
    for k, r in got.items():
        harmless(r.html)
        drop = lambda h: re.sub(r"\s+", "", re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1>|<[^>]*>", "", h))
        assert drop(r.html) == drop(pages[k].html)  # no text is lost
        assert r.html.count("<a href=") == len(re.findall(r"<a href=", pages[k].html))


@pytest.mark.parametrize(("html", "image", "want"), [
    ('<p><img src="https://c.d/i/a.png?w=1"></p><p>x</p>', "https://example.com/i/a.png", "<p>x</p>"),
    ('<p>a</p><figure><img src="/i/a.png"></figure><p>x</p>', "https://e.f/i/a.png", "<p>a</p><p>x</p>"),
    ('<p>a</p><p>b</p><img src="/i/a.png">', "https://e.f/i/a.png", '<p>a</p><p>b</p><img src="/i/a.png">'),
    ('<img src="/i/b.png"><img src="/i/a.png"><p>x</p>', "https://e.f/i/a.png", '<img src="/i/b.png"><p>x</p>'),
    ('<img src="/i/a.png">', None, '<img src="/i/a.png">'),
    ('<img src="/i/a.png">', "no address", '<img src="/i/a.png">'),
    (None, "https://e.f/i/a.png", None),
])
def test_opening_image(spark, html, image, want):
    df = spark.createDataFrame([(html, image)], "h string, i string")
    assert df.select(without_opening_image(df.h, df.i)).first()[0] == want
    assert sanitize.RAW <= EMPTIED
