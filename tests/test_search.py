"""Stems against Porter's algorithm in Python; searches of several users against a version that reads every text for every search."""

import functools
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.operators import index as ix
from quire.operators.search import B, K1, LEAST_IDF, WEIGHTS, match_text, parse_search
from quire.operators.stems import STEP_2, STEP_3, STEP_4, folded, stem_sql, stems

WORDS = """caresses ponies ties cats feed agreed bled motoring sing conflated troubled sized hopping falling hissing failing filing happy sky relational conditional
rational valenci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti
sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner adjustable defensible irritant replacement adjustment
dependent adoption homologou communism activate angulariti effective bowdlerize probate rate cease controll roll yes yellow syzygy toy by as b12 été naïve Running universities
generously ion ss Äpfel yields eying sayings""".split()


def plain(word):
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))


def porter(word):
    """By letters and measures, as the paper tells it."""
    if not re.fullmatch("[a-z]{3,}", word):
        return word
    kinds = lambda w: functools.reduce(lambda s, c: s + ("v" if c in "aeiou" or (c == "y" and s and s[-1] == "c") else "c"), w, "")
    m = lambda w: len(re.findall("v+c+", kinds(w)))
    has_vowel = lambda w: "v" in kinds(w)
    cvc = lambda w: kinds(w).endswith("cvc") and w[-1] not in "wxy"
    short = lambda w: m(w) == 1 and cvc(w)

    def swap(w, rules, least):
        for k in range(1, len(w)):
            if w[k:] in rules:
                return w[:k] + rules[w[k:]] if m(w[:k]) > least else w
        return w

    if word.endswith(("sses", "ies")) and len(word) > 3:
        word = word[:-2]
    elif word[-1] == "s" and word[-2] != "s":
        word = word[:-1]
    if word.endswith("eed") and len(word) > 3:
        word = word[:-1] if m(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            root = word[: -len(suffix)]
            if word.endswith(suffix) and has_vowel(root):
                if root.endswith(("at", "bl", "iz")) or (short(root) and root[-2:-1] != root[-1]):
                    word = root + "e"
                elif root[-1:] == root[-2:-1] and kinds(root).endswith("cc") and root[-1] not in "lsz":
                    word = root[:-1]
                else:
                    word = root
                break
    if word.endswith("y") and has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = swap(swap(word, STEP_2, 0), STEP_3, 0)
    if any(word.endswith(s) and len(word) > len(s) for s in STEP_4):
        word = swap(word, dict.fromkeys(STEP_4, ""), 1)
    elif word.endswith(("sion", "tion")) and m(word[:-3]) > 1:
        word = word[:-3]
    if word.endswith("e") and (m(word[:-1]) > 1 or (m(word[:-1]) == 1 and not cvc(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and m(word) > 1 else word


def test_stems(spark):
    rng = random.Random(1)
    parts = ["".join(rng.choice("bcdlstz") + rng.choice("aeiouy") for _ in range(rng.randint(1, 3))) + rng.choice(["", "n", "tt", "ss", "y"]) for _ in range(40)]
    words = WORDS + [p + s for p in parts for s in (*STEP_2, *STEP_3, *STEP_4, "s", "es", "ed", "ing", "eed", "y", "sion", "e", "ll")]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.s for r in df.select("w", F.get(stems(F.array(folded("w"))), F.lit(0)).alias("s")).collect()}
    assert got == {w: porter(plain(w)) for w in words}
    import duckdb

    source = " union ".join(f"select '{plain(w)}' as w" for w in sorted(set(words)))
    assert dict(duckdb.connect().execute(stem_sql(source)).fetchall()) == {plain(w): porter(plain(w)) for w in words}


TOKEN = re.compile(r"[^\W_]+")


def tokens(text):
    return [porter(plain(w)) for w in TOKEN.findall(text or "")]


def brute(searches, docs, limit=50):
    """Results by reading every text for every search."""
    columns = list(WEIGHTS)
    cut = {d["id"]: [tokens(d[c]) for c in columns] for d in docs}
    sizes = {i: sum(map(len, t)) for i, t in cut.items()}
    mean = sum(sizes.values()) / len(sizes)
    out = []

    def places(part, prefix, i):
        words = tokens(part)
        for c, text in enumerate(cut[i]):
            for k in range(len(text) - len(words) + 1 if words else 0):
                run = text[k : k + len(words)]
                if run[:-1] == words[:-1] and (run[-1].startswith(words[-1]) if prefix else run[-1] == words[-1]):
                    yield c, k, len(words)

    for sid, user, typed in searches:
        q = parse_search(typed or "")
        if q.is_empty:
            continue
        words, phrases, excluded = match_text(q) or ([], [], [])
        parts = [(w, True) for w in words] + [(p, False) for p in phrases]
        own = [d for d in docs if d["user_id"] == user and set(q.tags) <= set(d["tag_names"]) and all(d["is_reference"] if s == "ref" else d["status"] == s for s in q.states)]
        own = [d for d in own if not q.sites or any(re.match(rf"https://(.*\.)?{re.escape(s)}[/:]", d["url"]) or (d["site"] or "").lower() == s for s in q.sites)]
        if not parts:
            best = sorted(own, key=lambda d: (d["saved_at"], d["id"]), reverse=True)
            out += [(sid, k, d["id"], None, None) for k, d in enumerate(best[:limit], 1)]
            continue
        found = [{d["id"]: list(places(*p, d["id"])) for d in docs} for p in parts]
        scored = []
        for d in own:
            i = d["id"]
            if not all(f[i] for f in found) or any(any(True for _ in places(e, False, i)) for e in excluded):
                continue
            score = 0.0
            for f in found:
                n = sum(bool(x) for x in f.values())
                tf = sum(WEIGHTS[columns[c]] for c, _, _ in f[i])
                score += max(LEAST_IDF, math.log((len(docs) - n + 0.5) / (n + 0.5))) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[i] / mean))
            scored.append((round(score, 6), i, snippet(d, [(p, *x) for p, f in enumerate(found) for x in f[i]], columns)))
        out += [(sid, k, i, s, t) for k, (s, i, t) in enumerate(sorted(scored, key=lambda r: (r[0], r[1]), reverse=True)[:limit], 1)]
    return sorted(out, key=str)


def snippet(d, at, columns):
    best = None
    for _, c, k, _ in sorted(at, key=lambda x: (x[1], x[2])):
        near = [x for x in at if x[1] == c and k <= x[2] < k + 14]
        kinds = len({x[0] for x in near})
        worth, last = 1000 * kinds + len(near) - kinds, max(x[2] + x[3] for x in near)
        if best is None or worth > best[0]:
            best = worth, c, k - (14 - (last - k)) // 2
    _, c, first = best
    text = d[columns[c]]
    spans = [m.span() for m in TOKEN.finditer(text)]
    first = max(0, min(first, len(spans) - 14))
    stop = min(len(spans), first + 14)
    covered = {k + j for _, col, k, n in at if col == c for j in range(n)}
    joined = {k + j for _, col, k, n in at if col == c for j in range(n - 1)}
    out, pos = "", 0 if first == 0 else spans[first][0]
    for k in range(first, stop):
        a, b = spans[k]
        out += text[pos:a] + ("\x01" if k in covered and k - 1 not in joined else "") + text[a:b] + ("\x02" if k in covered and k not in joined else "")
        pos = b
    return ("…" if first else "") + out + (text[pos:] if stop == len(spans) else "…")


SCHEMA = "id long, user_id long, title string, description string, note string, tags string, site string, author string, url string, body string, saved_at timestamp_ntz, is_reference boolean, status string, tag_names array<string>"
SEARCHES = ["walk", "walk*", '"red garden"', '"red gardens" -house', "runs -walking -zzz", "tag:t1 hous", "#t1 is:ref", "is:queued site:a.org", "site:www.b.net walk", "", "-walk", "it's", "Café", '"walked the dog"', "e", "nothing-here", "!!", 'run "the the"', "is:archived -walk", None]


def made():
    import datetime

    rng = random.Random(6)
    vocabulary = "the the the a red garden gardens walked walking walks dog runs running house houses café cafe it's e-mail naïve universities 42 ,. -- (x)".split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, n))) or None
    docs = []
    for k in range(60):
        tags = sorted({f"t{rng.randrange(3)}" for _ in range(rng.randrange(3))})
        host = rng.choice(["a.org", "sub.a.org", "b.net:80", "c.io"])
        docs.append(dict(id=k, user_id=0 if k < 20 else k % 4, title=text(6), description=text(12), note=text(4), tags=" ".join(tags), site=rng.choice([host, None]), author=text(2), url=f"https://{host}/{k}", body=text(90),
                         saved_at=datetime.datetime(2024, 1, 1 + k % 20), is_reference=bool(k % 2), status=rng.choice(["queued", "archived"]), tag_names=tags))
    return docs, [(100 * u + k, u, s) for u in range(5) for k, s in enumerate(SEARCHES)]


@pytest.fixture(scope="module")
def tables(spark):
    docs, searches = made()
    return docs, searches, spark.createDataFrame([tuple(d.values()) for d in docs], SCHEMA).repartition(3), spark.createDataFrame(searches, "search_id long, user_id long, text string")


def test_search_all(tables):
    docs, searches, df, asked = tables
    index = ix.postings(df, list(WEIGHTS))
    assert sorted(map(tuple, ix.search_all(asked, df, index).collect()), key=str) == brute(searches, docs)
    assert sorted(map(tuple, ix.search_all(asked.where("search_id = 0"), df, index, limit=3).collect()), key=str) == brute(searches[:1], docs, 3)


def test_stored_and_merged(spark, tables, tmp_path):
    """A stored index with changed documents merged in is that of the new documents."""
    docs, _, df, _ = tables
    index = ix.stored(ix.postings(df, list(WEIGHTS)), str(tmp_path / "index"), 4)
    new = [d | {"title": "altogether new"} if d["id"] % 7 == 0 else d for d in docs if d["id"] % 11]
    now = spark.createDataFrame([tuple(d.values()) for d in new], SCHEMA)
    changed = now.where("id % 7 = 0")
    gone = df.where("id % 7 = 0 or id % 11 = 0").select("id")
    rows = lambda x: sorted(map(tuple, x.select("id", "column", "position", "stem").collect()))
    assert rows(ix.merged(index.drop("bucket"), ix.postings(changed, list(WEIGHTS)), gone)) == rows(ix.postings(now, list(WEIGHTS)))
    assert (tmp_path / "index" / "bucket=0").exists()


def test_phrases_that_share_words(spark):
    """Postings of a frequent word are not led to every phrase that has it: what is shuffled follows the postings and the phrases, not their product."""
    n = 300
    texts = spark.createDataFrame([(k, " ".join(f"zeta w{j}q" for j in range(k, k + 20))) for k in range(n)], "id long, title string")
    index = ix.written(ix.postings(texts.repartition(4), ["title"]), "postings")
    parts = spark.createDataFrame([(f"zeta w{j}q", ["zeta", f"w{j}q"], False) for j in range(n)] + [("w5q zeta w6*", ["w5q", "zeta", "w6"], True)], "key string, stems array<string>, prefix boolean")
    sc = spark.sparkContext
    java = sc._jvm.java.util.ArrayList

    def shuffled():
        stages = sc._jsc.sc().statusStore().stageList(java(), False, False, sc._gateway.new_array(sc._jvm.double, 0), java())
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = shuffled()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        found = {(r.key, r.id, r.start, r.size) for r in ix.occurrences(index, parts).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    moved = shuffled() - before
    assert 0 < moved < 10 * index.count()
    wanted = {(f"zeta w{j}q", k, 2 * (j - k), 2) for k in range(n) for j in range(k, min(k + 20, n))}
    assert found == wanted | {("w5q zeta w6*", k, 2 * (5 - k) + 1, 3) for k in range(6)}
