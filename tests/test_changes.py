"""Edits with undo against a replay in Python, and merges into bucketed tables: retries, buckets that are left alone, rules."""

import datetime
import random

import pytest

from quire.operators.changelog import FIELDS, flat, logged
from quire.sources.buckets import Buckets, absent_only, filled

T0 = datetime.datetime(2024, 1, 1)
PAGES = "link_id long, user_id long, note string, status string, reference boolean, tags array<string>"
EDITS = "event_id long, action_id long, link_id long, user_id long, at timestamp_ntz, note string, more string, status string, reference boolean, tags string"
UNDOS = "event_id long, action_id long, user_id long, at timestamp_ntz"


def made():
    rng = random.Random(12)
    pages = [(k, k % 3, rng.choice([None, "old"]), rng.choice(["queued", "archived"]), bool(k % 2), sorted({"a", rng.choice("bc")})) for k in range(12)]
    edits, undos, actions = [], [], []
    for k in range(900):
        at = T0 + datetime.timedelta(seconds=rng.randrange(400) * 10)
        if actions and rng.random() < 0.25:
            action, user, _ = rng.choice(actions)
            undos.append((10_000 + k, action, rng.choice([user, user, 77]), at))
            continue
        action = rng.choice([a for a, _, _ in actions[-3:]] or [k]) if rng.random() < 0.2 and actions else k
        user = next((u for a, u, _ in actions if a == action), None)
        link = 0 if rng.random() < 0.4 else rng.randrange(12)  # a page with more than a third of all edits
        user = link % 3 if user is None else user
        actions.append((action, user, at))
        edits.append((k, action, link, user, at, rng.choice([None, None, "set", ""]), rng.choice([None, "one", "Two  words", "set"]), rng.choice([None, "queued", "archived"]), rng.choice([None, True, False]), rng.choice([None, "#X y", ""])))
    return pages, edits, undos


def merge(old, new):
    old, new = (old or "").strip(), (new or "").strip()
    plain = lambda t: " ".join(t.split()).lower()
    return old if not new or (old and plain(new) in plain(old)) else f"{old}\n\n{new}" if old else new


def replay(pages, edits, undos):
    owner = {p[0]: p[1] for p in pages}
    edits = [e for e in edits if owner.get(e[2]) == e[3]]
    state = {p[0]: {"note": p[2], "status": p[3], "reference": p[4], "tags": p[5]} for p in pages}
    done = {}
    for e in edits:
        done[e[1], e[3]] = max(done.get((e[1], e[3]), T0), e[4])
    used, valid = set(), set()
    for u in sorted(undos, key=lambda u: (u[3], u[0])):
        if (u[1], u[2]) in done and u[3] > done[u[1], u[2]] and u[1] not in used:
            used.add(u[1])
            valid.add(u[0])
    first, log = {}, {}
    events = [(e[4], e[0], e) for e in edits] + [(u[3], u[0], u) for u in undos if u[0] in valid]
    for _, _, x in sorted(events, key=lambda e: e[:2]):
        if len(x) == 4:
            for (action, link), image in list(first.items()):
                if action == x[1]:
                    log[x[0], link] = (dict(state[link]), dict(image), "undo", False)
                    state[link] = dict(image)
            continue
        before = dict(state[x[2]])
        first.setdefault((x[1], x[2]), before)
        now = dict(before)
        if x[5] is not None:
            now["note"] = x[5] or None
        elif x[6] is not None:
            now["note"] = merge(now["note"], x[6]) or None
        for f, v in (("status", x[7]), ("reference", x[8])):
            now[f] = v if v is not None else now[f]
        if x[9] is not None:
            now["tags"] = sorted({t.lstrip("#").lower() for t in x[9].split()})
        state[x[2]] = now
        log[x[0], x[2]] = (before, dict(now), "link.update", x[1] in used)
    return state, log


def test_edits_and_undo(spark):
    pages, edits, undos = made()
    want, log = replay(pages, edits, undos)
    now, rows = logged(spark.createDataFrame(pages, PAGES), spark.createDataFrame(edits, EDITS), spark.createDataFrame(undos, UNDOS))
    shown = lambda s: (s["note"], s["status"], s["reference"], ",".join(s["tags"]))
    assert {r.link_id: (r.note, r.status, r.reference, r.tags) for r in now.collect()} == {k: shown(s) for k, s in want.items()}
    got = {(r.event_id, r.link_id): r for r in flat(rows).collect()}
    assert set(got) == set(log) and sum(r.undone for r in got.values()) > 20
    for k, (before, after, action, undone) in log.items():
        r = got[k]
        assert (r.action, r.undone) == (action, undone)
        assert tuple(r[f"{f}_before"] for f in FIELDS) == shown(before) and tuple(r[f"{f}_after"] for f in FIELDS) == shown(after)


def test_no_edits(spark):
    pages = made()[0]
    now, log = logged(spark.createDataFrame(pages, PAGES), spark.createDataFrame([], EDITS), spark.createDataFrame([], UNDOS))
    assert log.count() == 0 and now.count() == len(pages)


@pytest.fixture
def table(spark, tmp_path):
    return Buckets(spark, str(tmp_path / "t"), ["k"], "k long, a string, b long", 8)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_merge_rules_and_retry(spark, table):
    df = lambda rows: spark.createDataFrame(rows, "k long, a string, b long")
    assert rows_of(table.read()) == []
    table.merge(df([(k, f"a{k}", k) for k in range(20)] + [(None, "null", 0)]), "one")
    table.merge(df([(3, "", 30), (4, "new", None), (None, None, 7), (99, "x", 1)]), "two", filled)
    want = sorted([(k, f"a{k}", k) for k in range(20) if k not in (3, 4)] + [(3, "a3", 30), (4, "new", 4), (None, "null", 7), (99, "x", 1)], key=str)
    assert rows_of(table.read()) == want
    assert table.merge(df([(3, "again", 0)]), "two", filled) == [] and rows_of(table.read()) == want
    table.merge(df([(3, "no", 0), (100, "y", 2)]), "three", absent_only)
    assert rows_of(table.read()) == sorted([*want, (100, "y", 2)], key=str)
    table.prune()
    assert rows_of(table.read()) == sorted([*want, (100, "y", 2)], key=str)


def test_only_the_buckets_of_incoming_rows_are_written(spark, table, tmp_path):
    df = lambda rows: spark.createDataFrame(rows, "k long, a string, b long")
    table.merge(df([(k, "a", k) for k in range(200)]), "one")
    assert len(table.manifest()) == 8
    written = table.merge(df([(5, "b", 5)]), "two")
    assert len(written) == 1 and sum(f.endswith("two") for f in table.manifest().values()) == 1
    assert [p.name for p in (tmp_path / "t/files/00000001-two").glob("bucket=*")] == [f"bucket={written[0]}"]


def test_a_commit_without_its_manifest_is_not_seen(spark, table, tmp_path):
    """A writer that is lost after its files and before its manifest leaves the table as it was, and can be run again."""
    df = lambda rows: spark.createDataFrame(rows, "k long, a string, b long")
    table.merge(df([(1, "a", 1)]), "one")
    table.merge(df([(1, "b", 1)]), "two")
    (tmp_path / "t/manifests/00000001-two/_SUCCESS").unlink()
    assert rows_of(table.read()) == [(1, "a", 1)]
    table.merge(df([(1, "b", 1)]), "two")
    assert rows_of(table.read()) == [(1, "b", 1)]


def test_links_meet_one_post_a_url(spark):
    """Links are joined with the newest post of a URL, not with all its posts."""
    from quire.operators.edits import entry_links
    from quire.plans.views import Views

    plan = entry_links(Views(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    by_url = plan[plan.index("Union") :].split("Join Inner")[-1]
    assert "Aggregate [" in by_url


def test_only_undos_are_led_to_each_other(spark, monkeypatch):
    """The tables that doubling writes have a row an undo, none an edit."""
    from quire.operators import changelog

    sizes = {"ways": [], "versions": []}
    write = changelog.written

    def counted(df, name):
        out = write(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(changelog, "written", counted)
    pages, edits, undos = made()
    logged(spark.createDataFrame(pages, PAGES), spark.createDataFrame(edits, EDITS), spark.createDataFrame(undos, UNDOS))
    assert sizes["ways"] and max(sizes["ways"]) < sizes["versions"][0] / 2
