"""Column functions, parsers and search on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from quire.functions import display, pages, texts, urls
from quire.operators import jobs, reading, search
from quire.sources import feeds


def values(spark, cases, column, kind="string"):
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], f"k int, x {kind}")
    return [r.y for r in df.select("k", column(F.col("x")).alias("y")).orderBy("k").collect()]


def test_canonical_urls(spark):
    """Addresses put together from parts, in all ways: the parts that say where a page is stay, in one form."""
    hosts = {"News.Site.org": "news.site.org", "www.a-b.net": "a-b.net", "WWW.x.io:80": "x.io", "me:secret@y.dev:9000": "y.dev:9000", "z.co:443": "z.co"}
    paths = {"": "/", "/": "/", "/One/two//": "/One/two", "/p.html": "/p.html"}
    queries = {"": "", "?": "", "?z=1&b&a=x=y": "?a=x=y&b=&z=1", "?UTM_Medium=m&GCLID=2&si=3": "", "?k=2&utm_id=0&k=1&&j=": "?j=&k=2&k=1"}
    made = {f"{scheme}://{h}{p}{q}{f}": f"https://{hosts[h]}{paths[p]}{queries[q]}" for scheme in ("http", "HTTPS") for h in hosts for p in paths for q in queries for f in ("", "#top?x=1")}
    assert values(spark, list(made), urls.canonical) == list(made.values())


def test_web_urls(spark):
    """A scheme other than http(s) is never a page, whatever follows it; a host has a dot or is this machine; spaces stand only around."""
    for scheme in ("data", "file", "tel", "urn", "view-source", "git+ssh"):
        assert values(spark, [f"{scheme}:{rest}" for rest in ("//host.tld/p", "x", "text,1.2")], urls.web_url) == [None] * 3
    assert values(spark, ["nodots", "https://nodots/a.b", "http://", "two. words.tld", "https://h.tld/a b", "\t"], urls.web_url) == [None] * 6
    good = ["https://h.tld", "HTTP://H.TLD/?q#f", "localhost", "localhost:80/x", "sub.h.tld/a.b?c"]
    assert values(spark, [f"  {u} " for u in good], urls.web_url) == ["https://h.tld", "HTTP://H.TLD/?q#f", "https://localhost", None, "https://sub.h.tld/a.b?c"]
    assert values(spark, [None], urls.web_url) == [None]


def test_texts(spark):
    assert values(spark, ["a  b\nc", "", None], texts.words) == [3, 0, None]
    assert values(spark, [0, 1, 1034, 1035, None], texts.minutes, "long") == [None, 1, 4, 5, None]
    assert values(spark, ["<p>a&amp;b</p><script>x</script>c<br>d"], texts.strip_tags) == ["a&b c d"]
    assert values(spark, ["Architecture, #two  go go é"], texts.tags) == [["architecture", "two", "go", "é"]]
    assert values(spark, ["word " * 100], texts.summary)[0].endswith("word…")
    assert values(spark, ["plain", "=1+1", 'a "b", c', "-x"], texts.csv_cell) == ["plain", "'=1+1", '"a ""b"", c"', "'-x"]
    notes = spark.createDataFrame([("a B", "a  b"), (None, "n"), ("old", "new"), ("old", None), (None, " ")], "a string, b string")
    assert [r.n for r in notes.select(texts.merge_note(F.col("a"), F.col("b")).alias("n")).collect()] == ["a B", "n", "old\n\nnew", "old", None]


def test_display(spark):
    assert values(spark, ["Café & Bar", "", "--", "x" * 50], display.slug) == ["cafe-bar", "category", "category", "x" * 40]
    millis = [0, 1, 1_700_000_000_123, 2**48 - 1]
    made = values(spark, millis, display.sortable_time, "long")
    assert made == sorted(made) and all(len(m) == 10 for m in made)
    assert values(spark, [m + "ZZZZ" for m in made], display.time_of) == millis
    assert values(spark, ["UUUUUUUUUU"], display.time_of) == [None]
    assert values(spark, ['{"answers": {"p": 0.5}}', '{"result": {"answers": {"p": {"noul": 1}}}}', '{"answers": {"p": 2}}', "x"], lambda c: display.yes_chance(c, "p")) == [0.5, 1.0, None, None]


def test_schedule(spark):
    ages = spark.createDataFrame([(2,), (30,), (240,), (2160,), (None,)], "hours int")
    latest = F.expr("timestamp_ntz'2024-02-01 00:00:00' - make_dt_interval(0, hours, 0, 0)")
    assert [r.m for r in ages.select(jobs.poll_minutes(latest).alias("m")).collect()] == [30, 60, 180, 360, 360]
    assert values(spark, [0, 1, 4, 50], jobs.backoff_minutes, "int") == [120, 240, 1440, 1440]
    assert values(spark, [3000, 1_000_000], lambda t: jobs.neurons(t, "small"), "long") == [25, 8182]


def test_rules_of_jobs(spark):
    from quire.operators import upkeep

    df = spark.createDataFrame([(["topic", "topic", "topic-2", "other", "topic", "other"],), ([],)], "s array<string>")
    assert [r.f for r in df.select(upkeep.free_slugs(F.col("s")).alias("f")).collect()] == [["topic", "topic-2", "topic-2-2", "other-2", "topic-3", "other-3"], []]
    picked = values(spark, ["a", "ab", ""], lambda q: F.array_max(jobs.stub_probabilities(q, ["x", "y", "z"]))["slug"])
    assert picked == [["x", "y", "z"][n % 3] for n in (97, 97 + 98, 0)]


def test_ranking(spark):
    rows = spark.createDataFrame([(0.8, 3), (None, 0)], "p double, days int")
    date = F.expr("timestamp_ntz'2024-02-01 00:00:00' - make_dt_interval(days, 0, 0, 0)")
    assert [round(r.v, 6) for r in rows.select(reading.likely(F.col("p"), date).alias("v")).collect()] == [0.4, 0.5]


def test_fold_with_undo(spark):
    rows = [(1, 1, "error", "2024-01-01 00:00:00", 1), (1, 1, "purchase", "2024-01-02 00:00:00", 2), (1, 2, "error", "2024-01-01 00:00:00", 3), (1, 2, "purchase", "2024-01-02 00:00:00", 4), (1, 2, "error", "2024-01-03 00:00:00", 5)]
    df = spark.createDataFrame(rows, "user_id long, entry_id long, event_type string, stamp string, event_id long").withColumn("stamp", F.col("stamp").cast("timestamp_ntz"))
    got = {r.entry_id: (r.dismissed_at, r.read_at) for r in jobs.fold_entry_state(df).collect()}
    assert got[1][0] is None and got[1][1] is not None and got[2][0].day == 3


def test_placement(spark):
    df = spark.createDataFrame([([(0.6, "a"), (0.36, "b")],), ([(0.6, "a"), (0.4, "other")],), ([(0.9, "a"), (0.1, "b")],)], "p array<struct<p: double, slug: string>>")
    assert [tuple(r.x) for r in df.select(jobs.placement(F.col("p")).alias("x")).collect()] == [("a", "b"), ("a", None), ("a", None)]


def test_search_language():
    """Each rule on its own, then several in one search."""
    for text, field, expected in (
        ("slow cooking", "terms", ["slow", "cooking"]),
        ("8:30 key:val", "terms", ["8:30", "key:val"]),
        ('"  deep sea  " ""', "phrases", ["deep sea"]),
        ('-"loud noise" -raw', "excluded", ["loud noise", "raw"]),
        ("TAG:#Jazz #Blues tag:jazz", "tags", ["jazz", "blues"]),
        ("site:HTTPS://www.Example.ORG/path site:example.org", "sites", ["example.org"]),
        ("is:reference IS:queue is:unknown is:ref", "states", ["ref", "queued"]),
        ("-site:a.example", "excluded", ["site:a.example"]),
        ('"open end', "terms", ['"open', "end"]),
        ("- # tag:", "terms", ["-", "#", "tag:"]),
    ):
        assert getattr(search.parse_search(text), field) == expected, text
    q = search.parse_search('wine tag:red "old vines" -corked is:finished')
    assert (q.terms, q.phrases, q.excluded, q.tags, q.states) == (["wine"], ["old vines"], ["corked"], ["red"], ["archived"])
    assert search.match_text(q) == (["wine"], ["old vines"], ["corked"])
    assert search.match_text(search.parse_search("rock&roll it's")) == (["rock", "roll", "it's"], [], [])
    for text in ("-corked", "tag:red -corked", "+++"):
        assert search.match_text(search.parse_search(text)) is None
    assert search.parse_search(" -corked ").is_empty and not search.parse_search("tag:red").is_empty


RSS = """<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>T</title><link>https://example.com</link>
<item><title>A &amp; B</title><link>/a</link><guid isPermaLink="false">id-1</guid><dc:creator>Ann</dc:creator><description><![CDATA[<p>Hello <img src="/i.png"></p>]]></description><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item>
<item><title>C</title><guid>https://example.com/c</guid><pubDate>junk</pubDate></item><item></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><link rel="self" href="https://example.com/f"/><link href="https://example.com/"/>
<entry><id>x1</id><title>E</title><link rel="alternate" href="/e"/><published>2024-01-02T10:00:00Z</published><summary>short</summary></entry></feed>"""
JSON = '{"home_page_url": "https://example.com/", "items": [{"id": 7, "url": "https://example.com/j", "content_text": "one <b>\\n\\ntwo", "authors": [{"name": "Jo"}]}, {"title": ""}]}'
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><channel><title>T</title><link>https://example.com</link></channel><item><title>R</title><link>https://example.com/r</link><dc:date>2024-01-02T10:00:00Z</dc:date></item></rdf:RDF>"""


def test_feeds(spark):
    df = spark.createDataFrame([(1, RSS), (2, ATOM), (3, JSON), (4, RDF), (5, "<html>no</html>"), (6, "")], "feed_id int, body string").withColumn("feed_url", F.lit("https://example.com/feed"))
    got = {(r.feed_id, r.guid): r for r in feeds.entries(df).collect()}
    assert set(got) == {(1, "id-1"), (1, "https://example.com/c"), (2, "x1"), (3, "7"), (4, "https://example.com/r")}
    a = got[1, "id-1"]
    assert (a.url, a.title, a.author, a.image_url, a.published_at.hour) == ("https://example.com/a", "A & B", "Ann", "https://example.com/i.png", 10)
    assert got[1, "https://example.com/c"].published_at is None and got[1, "https://example.com/c"].url == "https://example.com/c"
    assert got[2, "x1"].url == "https://example.com/e" and got[2, "x1"].content == "short"
    assert got[3, "7"].content == "<p>one &lt;b&gt;</p><p>two</p>" and got[3, "7"].author == "Jo"
    assert {r.feed_id for r in feeds.unreadable(df).collect()} == {5, 6}
    again = feeds.entries(df)
    assert feeds.fresh(again.unionByName(again), again.where("feed_id = 1")).count() == 3


def test_opml(spark):
    body = '<opml><body><outline text="G"><outline text="H"><outline text="a" xmlUrl="https://a.example/f"/></outline></outline><outline text="b" xmlUrl="https://b.example/f"/><outline text="dup" xmlUrl="https://b.example/f"/><outline xmlUrl="ftp://x"/></body></opml>'
    df = spark.createDataFrame([(1, body), (2, "<opml><body>"), (3, None)], "user_id long, body string")
    assert sorted((r.user_id, r.url, r.title, r.folder) for r in feeds.opml_feeds(df).collect()) == [(1, "https://a.example/f", "a", "G"), (1, "https://b.example/f", "b", None)]


def test_pages(spark):
    html = """<html><head><title> Bare </title><meta property="og:title" content="Shared &amp; fine"><meta property="og:title" content="second"><meta name="author" content="https://profile"/>
    <meta name="description" content="d"><link rel="icon" href="/i.png"><link rel="canonical" href="https://example.com/c"><!-- <meta property="og:site_name" content="no"> -->
    <link rel="alternate" type="application/rss+xml" href="/comments/feed"><link rel="alternate" type="application/rss+xml" href="/feed"><link rel="alternate" type="application/json" href="/data"></head>
    <body><nav>menu</nav><article><h1>Head</h1><p>Some text.</p><aside>no</aside><ul><li><a href="/x">only a link</a></li></ul></article></body></html>"""
    df = spark.createDataFrame([(1, "https://example.com/p/q", html), (2, "https://example.com/", ""), (3, "https://example.com/", None)], "page_id int, url string, html string")
    m = {r.page_id: r for r in pages.metadata(df).collect()}
    assert (m[1].title, m[1].description, m[1].author, m[1].site_name) == ("Shared & fine", "d", None, None)
    assert (m[1].favicon_url, m[1].canonical_url, m[2].favicon_url) == ("https://example.com/i.png", "https://example.com/c", "https://example.com/favicon.ico")
    found = sorted((r.comments, r.feed) for r in pages.feed_links(df).collect())
    assert found == [(False, "https://example.com/feed"), (True, "https://example.com/comments/feed")]
    a = {r.page_id: (r.text, r.words) for r in pages.articles(df).collect()}
    assert a[1] == ("Head\n\nSome text.", 3) and a[2] == ("", 0)


def test_markup(spark):
    from quire.functions import markup

    assert values(spark, ["<p>a</p><ul><li>b<li>c</ul><p>d<br>e</p>", "", None], markup.block_text) == ["a\n\n• b\n• c\n\nd\ne", "", None]
    pieces = values(spark, ["One. Two! " + "w " * 30, "", "a b " * 10], lambda c: markup.spoken(c, 20), "string")
    assert pieces[0][:1] == ["One. Two!"] and all(len(p) <= 20 for p in pieces[0]) and pieces[1] == [] and " ".join(pieces[2]).split() == ["a", "b"] * 10
    places = spark.createDataFrame([("Hello  big World", "BIG world"), ("abc", "abc"), ("  abc", "abc"), ("abc", "zz"), ("abc", "")], "t string, q string")
    assert [r.at for r in places.select(markup.locate(F.col("t"), F.col("q")).alias("at")).collect()] == [7, 0, 2, None, None]
