"""The order of shingles on inputs so large that chance counts hide what many documents share."""

from __future__ import annotations

import numpy as np
import pytest

from quire.llm import graph, jaccard


@pytest.fixture
def noisy(spark):
    """300 documents of words of their own, and eight of 60 phrases in each; a phrase stands in 40 of them."""
    rng = np.random.default_rng(5)
    owners = [[] for _ in range(300)]
    for k in range(60 * 40):
        owners[k % 300].append(f"p{k // 40}")
    rows = []
    for k, phrases in enumerate(owners):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 250)]
        for n, p in enumerate(phrases):
            words[30 * n : 30 * n + 5] = [f"{p}-{j}" for j in range(5)]
        rows.append((k, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_usual_shingles_make_no_cluster(noisy, monkeypatch):
    found = []
    clusters = graph.clusters

    def counted(*args):
        made = clusters(*args)
        found.append(made[0].count())
        return made

    monkeypatch.setattr(graph, "clusters", counted)
    monkeypatch.setattr(graph, "HOT", 4)
    monkeypatch.setattr(jaccard.frequency_classes, "__defaults__", (10,))
    assert jaccard.keep_first(noisy).count() == 300
    assert found == [0]


def test_what_is_hot_follows_the_error_of_counters():
    rng = np.random.default_rng(6)
    small, few = jaccard.order_classes(rng.poisson(31, 1 << 14))
    counts = rng.poisson(1860, 1 << 14)
    large, more = jaccard.order_classes(counts)
    assert few == graph.HOT and 150 < more < 200
    assert np.all(np.diff(large[np.argsort(counts, kind="stable")].astype(int)) >= 0)
    assert len(np.unique(small)) > 10
    assert jaccard.order_classes(np.array([0, 0, 0, 1 << 40]))[0].tolist()[0] < 64
