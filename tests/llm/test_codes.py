"""Metric trees and code compression against brute force, on awkward vectors and the smallest tables."""

import hashlib
import math
import random

import numpy as np
import pytest

from quire.llm import balls, codes

TINY = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def cloud(seed, n, width=4, spread=90):
    rng = np.random.default_rng(seed)
    out = np.rint(rng.normal(0, spread, (n, width))).astype(np.int64)
    out[rng.random(n) < 0.3] = out[0]  # a third is one point
    return out


@pytest.mark.parametrize(("n", "spread"), [(1, 90), (2, 0), (48, 90), (49, 90), (900, 90), (900, 1), (3000, 90), (500, 0)])
def test_trees(n, spread):
    points = cloud(n, n, spread=spread)
    tree = balls.build(points)
    assert sorted(tree.order) == list(range(n)) and tree.begin[0] == 0 and tree.end[0] == n
    for k in range(len(tree.begin)):
        inside = points[tree.order[tree.begin[k] : tree.end[k]]]
        assert len(inside) and (tree.total[k] == inside.sum(0)).all()
        assert (np.sqrt(((inside - tree.pivot[k]) ** 2).sum(1)) <= tree.radius[k] + 1e-6).all()
        if tree.left[k] >= 0:
            a, b = tree.left[k], tree.right[k]
            assert (tree.begin[a], tree.end[a], tree.end[b]) == (tree.begin[k], tree.begin[b], tree.end[k]) and a > k and b > k


@pytest.mark.parametrize("seed", range(6))
def test_owners(seed):
    points = cloud(seed, 2000, spread=(3, 90)[seed % 2])
    entries = cloud(seed + 50, 64, spread=(3, 90)[seed % 2])  # with equal entries among them
    which, entry, looked = balls.shares(tree := balls.build(points), points, entries)
    got = np.full(len(points), -1)
    for w, e in zip(which, entry, strict=True):
        got[tree.order[tree.begin[w] : tree.end[w]] if w >= 0 else ~w] = e
    assert (got == ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)).all() and looked < 0.9 * len(points) * len(entries)


def test_balls_are_owned_whole():
    """Points in clusters far apart take a few distances, not one for each point."""
    rng = np.random.default_rng(2)
    centers = rng.integers(-9000, 9000, (16, 4))
    points = np.concatenate([c + rng.integers(-9, 9, (400, 4)) for c in centers])
    which, _, looked = balls.shares(balls.build(points), points, centers)
    assert (which >= 0).all() and looked < 0.1 * len(points) * 16


def brute(rows, parts=16, entries=64, rounds=2):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(whole[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[cut(v, p) for _, v, _ in whole[:entries]] for p in range(parts)]
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (gap(books[p][e], x), e))
    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in whole:
                held.setdefault(nearest(p, cut(v, p)), []).append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*held[e], strict=True)] if e in held else b for e, b in enumerate(books[p])]
    out = []
    for i, v, label in whole:
        own = [nearest(p, cut(v, p)) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for e in own), sum(gap(books[p][e], cut(v, p)) for p, e in enumerate(own))))
    by = {}
    for _, label, _, error in out:
        by[label] = by.get(label, 0) + error
    seal = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by[label], seal) for i, label, c, e in out), key=str)


def awkward(n=260, width=32):
    rng = random.Random(n)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(width)], rng.choice([0, 1, 2, None])) for k in range(n)]
    rows += [(1000 + k, rows[7][1], 1) for k in range(n // 2)]  # a third is one vector
    rows += [(3, rows[3][1], rows[3][2]), (3, rows[9][1], 2), (None, rows[5][1], None)]  # a repeated row, an id with two vectors, no id
    rows += [(2000, None, 1), (2001, [None] + [0.5] * (width - 1), 1), (2002, [math.nan] * width, 1), (2003, [math.inf] + [0.0] * (width - 1), 1), (2004, [-0.001] * width, 0), (-5, [0.0] * width, 0)]
    return rows


@pytest.mark.parametrize("chunk", [50, 8192])
def test_codes(spark, monkeypatch, chunk):
    monkeypatch.setattr(codes, "CHUNK", chunk)
    monkeypatch.setattr(balls, "LEAF", 6)
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = codes.digest(df)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    from pyspark.sql import functions as F

    clashing = df.select("*", *[F.lit(7).alias(c) for c in ("v", "code", "error", "same", "label_error", "trees", "place", "a.b")])
    assert sorted(map(tuple, codes.digest(clashing).collect()), key=str) == brute(rows)


def test_few_rows_and_none(spark):
    rows = awkward()[:5]
    assert sorted(map(tuple, codes.digest(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)
    empty = codes.digest(spark.createDataFrame([(1, None, 3)], SCHEMA))
    assert empty.count() == 0 and dict(empty.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}


def test_lengths_and_sizes(spark):
    rows = [(1, [0.5] * 16, 1), (2, [0.5] * 32, 1), (0, [None], 1), (3, [], 1), (4, [0.25] * 16, 1)]
    assert sorted(r.vec_id for r in codes.digest(spark.createDataFrame(rows, SCHEMA)).collect()) == [1, 4]
    with pytest.raises(ValueError):
        codes.digest(spark.createDataFrame([(1, [0.5] * 17, 1)], SCHEMA))
    with pytest.raises(Exception, match="below 65536"):
        codes.digest(spark.createDataFrame([(1, [1e30] * 16, 1)], SCHEMA)).collect()


def test_restored(spark):
    """With an entry for each vector, the codes give the vectors back."""
    rows = awkward()[:40]
    made, books = codes.compress(spark.createDataFrame(rows, SCHEMA))
    for r in codes.restored(made, books).collect():
        assert r.error == 0 and r.vector == [math.floor(256 * float(np.float32(x))) / 256 for x in rows[r.vec_id][1]]


def test_matches_sql(spark):
    from quire.llm.queries import ORACLES, QUERIES
    from tests.oracle import connect, difference

    for folder in (TINY, "/root/testdata/sf0.01"):
        assert difference(QUERIES["op11_anchors_hierarchy_codes"](spark, folder), connect(folder), ORACLES["op11_anchors_hierarchy_codes"]) == ""
