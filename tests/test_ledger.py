"""The daily ledger and the times of writing against plain Python, on days that are many slices, and with the cap and the floor at work."""

import datetime
import random
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quire.operators import ledger as ld

DAY = datetime.date(2024, 1, 1)
STEPS = st.lists(st.tuples(st.sampled_from([ld.RESERVE, ld.CORRECT]), st.integers(-40, 40)).map(lambda s: (s[0], abs(s[1]) if s[0] == ld.RESERVE else s[1])), max_size=40)


@given(STEPS, st.integers(0, 60), st.integers(0, 120))
def test_functions(steps, cap, total):
    """Steps put together do to any total what they do one by one; a cut anywhere changes nothing."""
    made = ld.composed([ld.step(k, a, cap) for k, a in steps])
    want = ld.replayed(total, [k for k, _ in steps], [a for _, a in steps], cap)[0]
    assert ld.applied(made, total) == want
    half = len(steps) // 2
    parts = [ld.composed([ld.step(k, a, cap) for k, a in some]) for some in (steps[:half], steps[half:])]
    assert ld.applied(ld.then(*parts), total) == want
    assert [p[0] for p in made] == sorted({p[0] for p in made}) and made[0][0] == 0


def brute(rows, cap):
    out = {}
    for day, _, _, _, kind, amount in sorted(rows):
        if day not in out:
            if kind == ld.RESERVE and amount <= cap:
                out[day] = [amount, 1, 0]
            continue
        d = out[day]
        if kind == ld.CORRECT:
            d[0] = max(0, d[0] + amount)
        elif d[0] + amount <= cap:
            d[0], d[1] = d[0] + amount, d[1] + 1
        else:
            d[2] += 1
    return {k: tuple(v) for k, v in out.items()}


def made(n=1500):
    rng = random.Random(n)
    rows = []
    for k in range(n):  # the second day has two thirds of all steps
        day = DAY + datetime.timedelta(days=rng.choice([0, 1, 1, 1, 1, 2]))
        at = datetime.datetime.combine(day, datetime.time(rng.randrange(24), rng.randrange(60), rng.randrange(3)))
        kind = rng.choice([ld.RESERVE, ld.CORRECT])
        rows.append((day, at, kind, k, kind, rng.randrange(0, 90) if kind == ld.RESERVE else rng.randrange(-90, 60)))
    late = DAY + datetime.timedelta(days=9)
    rows += [(late, datetime.datetime.combine(late, datetime.time(1)), ld.CORRECT, 9000, ld.CORRECT, 50), (late, datetime.datetime.combine(late, datetime.time(2)), ld.RESERVE, 9001, ld.RESERVE, 10**6)]
    return rows


@pytest.mark.parametrize(("cap", "size", "fan"), [(100, 7, 3), (3000, 40, 2), (10**5, 7, 64), (100, 50_000, 64)])
def test_ledger(spark, monkeypatch, cap, size, fan):
    monkeypatch.setattr(ld, "SLICE", size)
    monkeypatch.setattr(ld, "FAN", fan)
    rows = made()
    steps = spark.createDataFrame(rows, "day date, at timestamp_ntz, rank int, id long, kind int, amount long").repartition(3)
    got = {r.day: (r.neurons, r.calls, r.refused) for r in ld.ledger(steps, cap).collect()}
    assert got == brute(rows, cap)
    largest = ld.sliced(steps, cap).groupBy("day", "slice").count().agg({"count": "max"}).first()[0]
    assert largest <= size  # a day that has most steps is many slices


def test_no_steps(spark):
    assert ld.ledger(spark.createDataFrame([], "day date, at timestamp_ntz, rank int, id long, kind int, amount long"), 10).count() == 0


def test_last_writes(spark):
    rng = random.Random(4)
    base = datetime.datetime(2024, 1, 1)
    rows = [(u, base + datetime.timedelta(seconds=rng.choice([0, 3600, 3601, 7200, rng.randrange(10**6)]))) for u in (1, 1, 1, 2, None) for _ in range(200)]
    rows += [(3, base), (3, base + datetime.timedelta(hours=1)), (3, base + datetime.timedelta(hours=1, microseconds=1)), (4, base), (4, base)]
    expected = defaultdict(list)
    for u, at in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if not expected[u] or at - expected[u][-1] > datetime.timedelta(hours=1):
            expected[u].append(at)
    known = [r for r in rows if r[0] is not None]
    got = defaultdict(list)
    for r in ld.last_writes(spark.createDataFrame(known, "u int, stamp timestamp_ntz"), ["u"]).orderBy("u", "stamp").collect():
        got[r.u].append(r.stamp)
    assert got == {u: x for u, x in expected.items() if u is not None}
    assert ld.last_writes(spark.createDataFrame([], "u int, stamp timestamp_ntz"), ["u"]).count() == 0
