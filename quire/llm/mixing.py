"""Mixing sources to target weights: Poisson replication.

A source of size n_s (code points of text) and target share w_s is repeated at the mean rate
r_s = w_s * N / n_s, with N the size of all.  Each document's count inverts the Poisson distribution
of that mean at a number in (0, 1) drawn from a hash of its key and a seed: deterministic, and alike on
a retry.  Documents are exploded by their counts and sorted by a hash of (key, copy): a global shuffle.

Source sizes come from one aggregation with partial sums.  The table of sources is written, so that Spark knows
its size: below its own limit it is broadcast and the documents stay where they are, above it is shuffled.  The counts are native columns; the explode adds
rows in proportion to the target, never to the square of a group.

Defined results: a null source is a source of its own; sources without a stated weight get the share
``rest`` (default: none of them is kept when weights are given, all equal when none are); a null or
empty text has size 0; a source of size 0 in all keeps each document once; no documents, no rows;
repeated rows are drawn alike, as are rows of equal or null ids in one source; equal order keys (rows of equal ids) are not
ordered further; extra columns stay, ``copy`` and ``mix_key`` are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.store import Tables, unused

NO_SOURCE = "\x00null"
MAX_RATE = 500.0


def uniform(*parts: Column) -> Column:
    """A number inside (0, 1) from the upper 52 bits of an md5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def inverse_poisson(u: Column, rate: Column) -> Column:
    """The least k whose cumulative Poisson probability reaches u; the rate is at most MAX_RATE."""
    limit = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * rate / i
        return F.when(s["cdf"] >= u, s).otherwise(F.struct(i.cast("int").alias("k"), p.alias("p"), (s["cdf"] + p).alias("cdf")))

    return F.aggregate(F.sequence(F.lit(1), limit), start, step, lambda s: s["k"])


def poisson_count(seed: Column, key: Column, rate: Column) -> Column:
    """A Poisson count drawn from (seed, key).

    exp(-rate) underflows for large rates, so a rate above MAX_RATE is the sum of equal parts, each
    drawn on its own: sums of independent Poisson counts are Poisson counts.
    """
    parts = F.greatest(F.lit(1), F.ceil(rate / MAX_RATE).cast("int"))
    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, i: n + inverse_poisson(uniform(seed, key, i), rate / parts))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, rest: float = 0.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, rate) of every source: the mean number of copies of each of its documents, null without any text."""
    name = F.coalesce(F.col(source), F.lit(NO_SOURCE))
    sizes = docs.groupBy(name.alias("__source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        share = F.lit(1.0)
    else:
        share = F.coalesce(F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))])[F.col("__source")], F.lit(float(rest)))
    shares = sizes.withColumn("share", share)
    total, all_shares = (shares.agg(F.sum(c)).scalar() for c in ("size", "share"))
    # no rate for a source without text: it is kept as it is
    rate = F.when(F.col("size") > 0, F.col("share") * total / (all_shares * F.col("size")))
    return shares.select("__source", rate.alias("__rate"))


def replicate(
    docs: DataFrame, weights: Mapping[str, float] | None = None, rest: float = 0.0, seed: str = "mix", key: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """Every document as often as drawn, with ``copy`` (from 0) and ``mix_key``; not yet in shuffled order."""
    known = Tables(docs.sparkSession, "mix").keep(rates(docs, weights, rest, source, text), "rates")
    name, rate, times = (unused(c, docs) for c in ("source_name", "rate", "times"))
    known = known.select(F.col("__source").alias(name), F.col("__rate").alias(rate))
    rated = docs.withColumn(name, F.coalesce(F.col(source), F.lit(NO_SOURCE))).join(known, name)
    count = F.when(F.col(rate).isNull(), 1).otherwise(poisson_count(F.lit(seed), F.col(key), F.coalesce(rate, F.lit(0.0))))
    drawn = rated.withColumn(times, count).where(F.col(times) > 0).drop(name, rate, "copy", "mix_key")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(times) - 1))).drop(times)
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.col("copy").cast("string")).cast("binary"))
    return copies.withColumn("mix_key", order)


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, **how: str) -> DataFrame:
    """The mixture in its global order: sorted by a hash of (key, copy)."""
    return replicate(docs, weights, **how).orderBy("mix_key")
