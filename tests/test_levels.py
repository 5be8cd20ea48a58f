"""What followers of a feed meet when one of them has handled many posts."""

from quire.operators.reading import by_level


def test_a_heavy_reader_makes_no_pairs_for_others(spark):
    posts = spark.range(1, 20_001).selectExpr("1L as feed_id", "id as place")
    needs = [(u, 1, 60) for u in range(200)] + [(900, 1, 20_000), (901, 1, 1), (902, 1, 64), (903, 2, 5)]
    asked = spark.createDataFrame(needs, "user_id long, feed_id long, need long")
    made = by_level(asked, posts)
    needed = 200 * 60 + 20_000 + 1 + 64
    assert made.where("place <= need").count() == needed and made.count() < 2 * needed
    assert sorted(r.place for r in made.where("user_id = 902 and place <= need").collect()) == list(range(1, 65))
