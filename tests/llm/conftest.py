"""Documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "text2 string, component_id long, shard int, slot int, copy int, mix_key string, kept boolean, score double, h long, id long, token long, gone int, need int, one int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    rng = random.Random(5)
    out = []
    for k in range(60):
        text = " ".join(words(rng, rng.choice([8, 30, 90, 200])))
        out.append((k, text, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "c", None]), len(text)))
    base = words(rng, 120)
    for k in range(60, 100):  # near copies of one text, some closer than others
        changed = list(base)
        for at in rng.sample(range(120), rng.choice([0, 1, 1, 2, 3])):
            changed[at] = f"x{k}-{at}"
        text = " ".join(changed)
        out.append((k, text, "en", "a", len(text)))
    chain = words(rng, 100)
    for k in range(100, 112):  # each is linked with the next, not with all
        chain[(k * 7) % 100] = f"y{k}"
        text = " ".join(chain)
        out.append((k, text, "de", "b", len(text)))
    out += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \n\t ", "en", "a", 4), (203, "one", "en", "b", 3), (204, "One", "en", "b", 3), (205, "two words", "fr", "c", 9)]
    out += [(206, "é… “quoted” 漢字 word", "fr", "c", 20), (None, "no id at all here " * 4, "en", "a", 72), (207, "same text twice " * 9, "en", "a", 144), (207, "same text twice " * 9, "en", "a", 144)]
    long_text = " ".join(words(rng, 30_000, 5_000))
    out += [(208, long_text, "en", "a", len(long_text)), (209, "z" * 60_000, "en", "a", 60_000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    out = docs
    for c in CLASHING.split(", "):
        name, kind = c.split()
        out = out.withColumn(name, F.lit(None).cast(kind))
    return out


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
