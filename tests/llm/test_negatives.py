"""Spanning trees, bounds and mined negatives against brute force, on awkward vectors and the smallest tables."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import negatives
from quire.llm.negatives import Packed, Search, mine, spanning

TINY = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def test_spanning_tree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 60):
        v = rng.integers(-200, 200, (n, 8))
        v[n // 2 :: 3] = v[0]
        order, parent, length = spanning(v)
        assert sorted(order) == list(range(n)) and all(p < k for k, p in enumerate(parent))
        # Kruskal's sum, by another algorithm
        edges, group, total = sorted((math.dist(v[a], v[b]), a, b) for a in range(n) for b in range(a)), list(range(n)), 0.0
        for d, a, b in edges:
            if group[a] != group[b]:
                total += d
                group = [group[a] if g == group[b] else g for g in group]
        assert math.isclose(length.sum(), total, rel_tol=1e-8)


def opened(number, ids, labels, v):
    table = pa.table({"number": [number], "id": [np.array(ids, np.int64).tobytes()], "label": [np.array(labels, np.int64).tobytes()], "v": [np.array(v, np.int32).tobytes()]})
    return Packed(table, 0, len(v[0]))


@pytest.mark.parametrize("same", [True, False])
def test_search_scores_few_rows_again(same):
    """Anchors near each other: the same results as by all scores, from a part of them."""
    rng = np.random.default_rng(4)
    centers = rng.normal(0, 200, (20, 16))
    point = lambda n: np.rint(centers[rng.integers(0, 20, n)] + rng.normal(0, 4, (n, 16))).astype(int)
    anchors, rows = point(60), point(3000)
    labels, own = rng.integers(0, 3, 3000), rng.integers(0, 3, 60)
    windows = [[(0, -np.inf, np.inf)] if same else [(1, 100_000, 200_000), (2, 300_000, 310_000)] for _ in anchors]
    search = Search(opened(9, range(60), own, anchors), windows, same, 5)
    for a in range(0, 3000, 1000):
        search.meet(opened(a, range(1000 + a, 2000 + a), labels[a : a + 1000], rows[a : a + 1000]))
    want = []
    for k in range(60):
        score = rows @ anchors[k]
        for number, low, high in windows[k]:
            fit = [j for j in range(3000) if (labels[j] == own[k]) == same and low <= score[j] <= high]
            want += [(9, k, k, number, 1000 + j, score[j]) for j in sorted(fit, key=lambda j: (-score[j], j))[:5]]
    assert search.results() == want and search.scored < 0.5 * search.met


def brute(rows, every=100, flip=7):
    fine = [(i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if flip and i is not None and i % flip == 0 else label) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    big = lambda i: (i is None, i or 0)
    out, done = [], set()
    for i, a, label in fine:
        if i is None or i % every or (i, tuple(a), label) in done:
            continue
        done.add((i, tuple(a), label))
        score = [(sum(x * y for x, y in zip(a, b, strict=True)), j, other) for j, b, other in fine]
        best = sorted(((s, j) for s, j, other in score if other == label and j != i), key=lambda r: (-r[0], big(r[1])))[:5]
        for p, j in best:
            hard = sorted(((s, n) for s, n, other in score if other != label and 80 * p <= 100 * s <= 100 * p), key=lambda r: (-r[0], big(r[1])))[:5]
            out += [(i, j, rank, n, p, s) for rank, (s, n) in enumerate(hard, 1)]
    return sorted(out, key=str)


def awkward():
    rng = random.Random(8)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(16)], rng.choice([0, 1, 2])) for k in range(1200)]
    rows += [(2000 + k, rows[100][1], k % 3) for k in range(500)]  # a third is one vector
    rows += [(300, *rows[300][1:]), (200, rows[5][1], 2), (7, *rows[7][1:]), (None, rows[400][1], 1), (None, rows[400][1], 2)]
    rows += [(9000, None, 1), (9100, rows[1][1], None), (9200, [math.nan] * 16, 1), (9300, [None] * 16, 1), (9400, [math.inf] + [0.0] * 15, 2), (9500, [0.0] * 16, 0), (9600, [0.1] * 16, 77)]
    return rows


@pytest.mark.parametrize("small", [True, False])
def test_mining(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(negatives, "BLOCK_NUMBERS", 16 * 70)
        monkeypatch.setattr(negatives, "TREE_NUMBERS", 16 * 16)
        monkeypatch.setattr(negatives, "BAND", 1)
        monkeypatch.setattr(negatives, "SPREAD", 3)
        monkeypatch.setattr(negatives, "STRIPE", 5)
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = mine(df, F.col("vec_id") % 100 == 0, label=moved)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert dict(got.dtypes) == {c: "int" if c == "rank" else "bigint" for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")}
    clashing = df.select("*", *[F.lit(7).alias(c) for c in ("v", "number", "anchor", "windows", "stripe", "band", "score", "a.b")])
    assert mine(clashing, F.col("vec_id") % 100 == 0, label=moved).count() == got.count()


def test_no_rows(spark):
    for rows in ([], [(100, None, 1)], [(1, [0.5] * 16, 1)], [(100, [0.5] * 16, 1)], [(100, [], 1), (101, [], 1), (102, [], 2)], [(100, [0.5] * 16, 1), (101, [0.5] * 16, 1), (102, [0.5], 2)]):
        got = mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
        assert got.count() == 0 and len(got.columns) == 6


def test_large_components(spark):
    """Scores beyond what floats hold exactly are still right."""
    rows = [(k, [60000.0 + k % 5] * 40 + [float(k)] * 8, k % 2) for k in range(300)]
    got = mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, flip=None)


def test_matches_sql(spark):
    from quire.llm.queries import ORACLES, QUERIES
    from tests.oracle import connect, difference

    for folder in (TINY, "/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        assert difference(QUERIES["op12_spanning_tree_negatives"](spark, folder), connect(folder), ORACLES["op12_spanning_tree_negatives"]) == ""
