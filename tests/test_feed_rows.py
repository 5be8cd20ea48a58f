"""No post is lost on its way through a feed document: not one without a text, not one with characters that XML does not allow."""

from __future__ import annotations

from quire.plans.catalog import feed_parse


class Documents:
    def __init__(self, df):
        self.df = df

    def raw(self, name):
        return self.df


def test_every_post_is_a_row(spark):
    rows = [(1, "some text", "a"), (2, None, "a"), (3, "before\x01 after", None), (4, "a \x0b b￿", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["feed_id"]: (r["guid"], r["title"], r["summary"]) for r in feed_parse(Documents(docs)).collect()}
    assert found == {1: ("g1", "Post 1 a", "some text"), 2: ("g2", "Post 2 a", None), 3: ("g3", "Post 3", "before after"), 4: ("g4", "Post 4 a", "a b")}
