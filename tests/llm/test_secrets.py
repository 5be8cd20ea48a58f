"""The combined automaton against Python's expressions, on made texts, awkward documents and the smallest tables."""

import functools
import hashlib
import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm.automaton import Pattern, backwards, compiled, shortest
from quire.llm.secretscan import BASE_KINDS, RULES, Rule, Scanner, digest, find, redact

TINY = "/root/testdata/sf0.001"


shared = functools.cache(Scanner)


@pytest.fixture
def scanner():
    return shared()


def brute(text, rules=RULES):
    data, out = (text or "").encode(), []
    for k, r in enumerate(rules):
        flags = re.I if r.any_case else 0
        for m in re.finditer((r.head + (r.tail + "+" if r.tail else "")).encode(), data, flags):
            if not r.tail or len(m[0]) - re.match(r.head.encode(), m[0], flags).end() >= r.least:
                out.append((len(data[: m.start()].decode()), k, len(data[: m.end()].decode())))
    return [(rules[k].kind, a, b) for a, k, b in sorted(out)]


PIECES = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "=", ":", ": ", " = ", "'", '"', " ", "\n", "AKIA", "AKIAAKIA", "ABCDEFGH1234", "deadbeef", "0123456789abcdef" * 2, "0" * 31, "a" * 40, "g", "é", "漢", "-", ".", "gh", "ghp_", "xoxb-", "AIza", "sk_live_", "eyJh.", "eyJ", "Bearer ", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "://", "me:you@", "value-123", "/+", "\0"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=30).map("".join), max_size=4))
def test_spans(texts):
    made = shared()
    assert made.find(pa.array([*texts, None], pa.string())) == [*map(brute, texts), []]


def test_long_texts_and_many_lanes(scanner):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.choice([0, 5, 300]))) for _ in range(400)]
    texts += ["".join(rng.choice(PIECES) for _ in range(40_000)), "f" * 300_000, "token=" + "x" * 200_000 + "\ntoken=short", "password" * 30_000, "token" + " " * 100_000 + "=abcdefgh"]
    assert scanner.find(pa.array(texts)) == [brute(t) for t in texts]


@pytest.mark.parametrize(("text", "spans"), [
    ("token=token: abcdefghij", ""),  # the first match ends before the colon, is too short and gives nothing back
    ("token==abcdefg", "assign:0:14"),
    ("é API_KEY\" : 'abcd.efgh' ", "assign:2:23"),
    ("ſecret=abcdefgh", ""),  # letters of either case are ASCII letters
    ("AKIA" + "A" * 11 + " AKIA" + "A" * 12, "access:16:32"),
    ("0" * 31 + " " + "0" * 32 + "G", "hex:32:64"),
    ("secret=" + "a" * 32, "assign:0:39,hex:7:39"),
])
def test_base_rules(scanner, text, spans):
    assert ",".join(f"{k}:{a}:{b}" for k, a, b in scanner.find(pa.array([text]))[0]) == spans


@pytest.mark.parametrize("pattern", ["a|bc*|d+", "(ab|a)(c|bcd)?", "[^a-c]x{2}", "x{2,}y?", "\\.\\x41[\\]\\-]", "(a|b)*abb", "()", "a?b?c?"])
def test_automata(pattern):
    """Every text of up to five letters: matched whole or not, as by Python's expressions."""
    tree = Pattern(pattern).tree
    made, back = compiled([tree], anywhere=False), compiled([backwards(tree)], anywhere=False)
    letters, seen = "abcdxyA.]-", [""]
    for _ in range(4):
        seen += [t + c for t in seen if len(t) == max(map(len, seen)) for c in letters]
    for t in seen:
        longest = max((k for k in range(len(t) + 1) if re.fullmatch(pattern, t[:k])), default=-1)
        assert made.ending(t.encode(), 0, len(t)) == longest
        assert (back.ending(t[::-1].encode(), 0, len(t)) == len(t)) == bool(re.fullmatch(pattern, t))
    assert shortest(tree) == min(len(t) for t in seen if re.fullmatch(pattern, t))


def test_minimal():
    """(a|b)*abb has four states, and equal states of several patterns are one."""
    assert len(compiled([Pattern("(a|b)*abb").tree], anywhere=False).table) == 4
    assert len(compiled([Pattern("abb").tree], anywhere=True).table) == 4
    assert len(compiled([Pattern("xa{3}|ya{3}").tree], anywhere=False).table) == 5


def test_tables(spark, docs, clashing, no_docs):
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    want = sorted(((i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in brute(t) if k in BASE_KINDS).encode()).hexdigest()) for i, t in texts), key=str)
    for df in (docs, clashing.withColumn("Found", F.lit(1)).withColumn("a.b", F.lit(2))):
        assert sorted(((r.doc_id, r.base_sha256) for r in digest(df).collect()), key=str) == want
    named = clashing.withColumn("Found", F.lit(1)).withColumn("a.b", F.lit(2))
    kept = find(named)
    assert kept.columns == [*named.columns, "found_"] and kept.count() == docs.count()
    assert digest(no_docs).count() == 0 and dict(digest(no_docs).dtypes)["n_hex"] == "bigint"


def test_matches_sql(spark):
    from quire.llm.queries import ORACLES, QUERIES
    from tests.oracle import connect, difference

    for folder in (TINY, "/root/testdata/sf0.01"):
        assert difference(QUERIES["op13_combined_automaton_secrets"](spark, folder), connect(folder), ORACLES["op13_combined_automaton_secrets"]) == ""


def test_redact_and_own_rules(spark):
    df = spark.createDataFrame([(1, "my token: abcdefgh, and key-77"), (2, None), (3, "")], "id int, body string")
    assert [r.body for r in redact(df, "body").orderBy("id").collect()] == ["my <assign>, and key-77", None, ""]
    own = (Rule("key", "key-", "[0-9]", 2),)
    assert [[tuple(s) for s in r.found] for r in find(df, "body", own).orderBy("id").collect()] == [[("key", 24, 30)], [], []]
