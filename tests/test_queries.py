"""Every reading query against its SQL on DuckDB, and those without SQL against plain Python."""

from collections import defaultdict
from datetime import timedelta

import pytest

from quire.plans import catalog
from quire.plans.views import Views
from tests.oracle import connect, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    assert difference(catalog.queries()[name](spark, FOLDER), duck, catalog.ORACLES[name]) == ""


def test_budget_ledger(spark):
    from quire.operators import jobs

    v = Views(spark, FOLDER)
    requests = sorted((r.day, r.stamp, r.event_id, r.asked) for r in jobs.budget_requests(v).collect())
    for cap in (50, 2000, 10**9):
        expected = defaultdict(lambda: [0, 0, 0])
        for day, _, _, asked in requests:
            d = expected[day]
            if d[2] + asked <= cap:
                d[0] += 1
                d[2] += asked
            else:
                d[1] += 1
        assert {r.day: [r.accepted, r.refused, r.spent] for r in jobs.budget_ledger(v, cap).collect()} == dict(expected)


def test_token_last_used(spark):
    from quire.operators import jobs

    v = Views(spark, FOLDER)
    expected = {}
    for r in sorted(v.raw("events").select("user_id", "ts").collect()):
        n, last = expected.get(r.user_id, (0, None))
        if last is None or r.ts - last > timedelta(hours=1):
            expected[r.user_id] = (n + 1, r.ts)
    assert {r.user_id: (r.writes, r.last_used) for r in jobs.last_used(v).collect()} == expected


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(e.queries()) and set(catalog.ORACLES) <= set(e.oracle_sql())
