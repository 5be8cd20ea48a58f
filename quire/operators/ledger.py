"""A daily budget as a ledger: reservations under a cap, and corrections that never take a total below nothing.

A step changes a day's total by a rule that depends on the total: a reservation adds its amount if that stays within the cap, else nothing; a
correction adds its difference, but at least nothing is left.  Steps are cut into slices of bounded size in the order of (day, at, rank, id), by range, so a day
with any share of all steps is many slices.  What a slice does to a total is a function of a few pieces; functions of slices are put together in
groups, level by level, which gives the total that each slice starts from, and slices whose totals touch neither cap nor floor are not looked at again.
The others are replayed, each on its own.

A day begins with its first reservation that the cap allows at all: before it there is nothing to correct.  A total may pass the cap by corrections.
Whether a correction's call was accepted is for those to know who wrote the log.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.scratch import written

SLICE, FAN = 50_000, 64
RESERVE, CORRECT = 0, 1

#: A function of the total, as pieces (from, fixed, value): from there on the total becomes ``value``, or ``value`` is added to it.
Pieces = list[tuple[int, bool, int]]
FUNCTION = "array<struct<start: long, fixed: boolean, value: long>>"
SAME: Pieces = [(0, False, 0)]


def applied(pieces: Pieces, total: int) -> int:
    _, fixed, value = pieces[bisect_right(pieces, total, key=lambda p: p[0]) - 1]
    return value if fixed else total + value


def then(first: Pieces, second: Pieces) -> Pieces:
    """The function that does the first and then the second."""
    out: Pieces = []
    for k, (start, fixed, value) in enumerate(first):
        stop = first[k + 1][0] if k + 1 < len(first) else None
        if fixed:
            out.append((start, True, applied(second, value)))
            continue
        at = bisect_right(second, start + value, key=lambda p: p[0]) - 1
        while at < len(second) and (stop is None or second[at][0] - value < stop):
            begin, constant, more = second[at]
            out.append((max(start, begin - value), constant, more if constant else value + more))
            at += 1
    return [p for k, p in enumerate(out) if not k or p[1:] != out[k - 1][1:]]


def step(kind: int, amount: int, cap: int) -> Pieces:
    if kind == RESERVE:
        if amount > cap:
            return SAME
        return [(0, False, amount), (cap - amount + 1, False, 0)] if amount else SAME
    return [(0, False, amount)] if amount >= 0 else [(0, True, 0), (-amount, False, amount)]


def composed(functions: list[Pieces]) -> Pieces:
    """All functions in order, put together by halves, so that pieces that make no difference go early."""
    while len(functions) > 1:
        functions = [then(*functions[k : k + 2]) if k + 1 < len(functions) else functions[k] for k in range(0, len(functions), 2)]
    return functions[0] if functions else SAME


def replayed(total: int, kinds: list[int], amounts: list[int], cap: int) -> tuple[int, int, int]:
    """(total, accepted, refused) after the steps."""
    accepted = refused = 0
    for kind, amount in zip(kinds, amounts, strict=True):
        if kind == CORRECT:
            total = max(0, total + amount)
        elif total + amount <= cap:
            total, accepted = total + amount, accepted + 1
        else:
            refused += 1
    return total, accepted, refused


def pieces_of(value: list) -> Pieces:
    return [(p["start"], p["fixed"], p["value"]) for p in value]


def stored(pieces: Pieces) -> list[dict]:
    return [{"start": a, "fixed": f, "value": v} for a, f, v in pieces]


def sliced(steps: DataFrame, cap: int) -> DataFrame:
    """The steps from each day's beginning on, numbered within their day, with the number of their slice; no task sorts a day."""
    order = ["day", "at", "rank", "id"]
    first = steps.where((F.col("kind") == RESERVE) & (F.col("amount") <= cap)).groupBy("day").agg(F.min(F.struct("at", "rank", "id")).alias("begin"))
    known = steps.join(first, "day").where(F.struct("at", "rank", "id") >= F.col("begin")).drop("begin")
    # numbers within a minute, and how many steps the day had before it; a minute is the finest piece that is sorted whole
    counted = known.withColumn("minute", F.date_trunc("minute", "at"))
    minutes = counted.groupBy("day", "minute").agg(F.count("*").alias("n"))
    before = Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = minutes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy("day", "minute").orderBy(*order[1:])) + F.col("before") - 1
    return counted.join(minutes, ["day", "minute"]).select("day", number.alias("number"), "kind", "amount").withColumn("slice", F.floor(F.col("number") / SLICE))


def starts(functions: DataFrame) -> DataFrame:
    """(day, slice, total): what each slice of a day starts from, given (day, slice, pieces) with slices numbered from 0."""
    levels = [functions]
    while levels[-1].agg(F.max("slice")).first()[0] not in (None, *range(FAN)):

        def joined(group: pd.DataFrame) -> pd.DataFrame:
            ordered = group.sort_values("slice")
            return pd.DataFrame({"day": ordered["day"].iloc[:1], "slice": ordered["slice"].iloc[:1] // FAN, "pieces": [stored(composed([pieces_of(p) for p in ordered["pieces"]]))]})

        wider = levels[-1].groupBy("day", F.floor(F.col("slice") / FAN).alias("group")).applyInPandas(joined, f"day date, slice long, pieces {FUNCTION}")
        levels.append(written(wider, "functions"))

    def opened(group: pd.DataFrame) -> pd.DataFrame:
        ordered, totals = group.sort_values("slice"), []
        total = int(ordered["total"].iloc[0])
        for p in ordered["pieces"]:
            totals.append(total)
            total = applied(pieces_of(p), total)
        return pd.DataFrame({"day": ordered["day"], "slice": ordered["slice"], "total": totals})

    above = levels[-1].select("day", F.lit(0).cast("long").alias("group"), F.lit(0).cast("long").alias("total")).distinct()
    for level in reversed(levels):
        inside = level.withColumn("group", F.floor(F.col("slice") / FAN)).join(above, ["day", "group"])
        found = inside.groupBy("day", "group").applyInPandas(opened, "day date, slice long, total long")
        above = found.select("day", F.col("slice").alias("group"), "total")
    return found


def ledger(steps: DataFrame, cap: int) -> DataFrame:
    """(day, neurons, calls, refused) of steps (day, at, rank, id, kind, amount); days without a reservation that fits under the cap have no row."""
    rows = written(sliced(steps, cap), "steps")
    schema = f"day date, slice long, pieces {FUNCTION}, up long, down long, total long, calls long"

    def summary(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("number")
        sums = ordered["amount"].cumsum()
        pieces = composed([step(int(k), int(a), cap) for k, a in zip(ordered["kind"], ordered["amount"], strict=True)])
        return pd.DataFrame({"day": ordered["day"].iloc[:1], "slice": ordered["slice"].iloc[:1], "pieces": [stored(pieces)], "up": sums.max(), "down": sums.min(), "total": sums.iloc[-1], "calls": int((ordered["kind"] == RESERVE).sum())})

    functions = written(rows.groupBy("day", "slice").applyInPandas(summary, schema), "functions")
    known = functions.drop("pieces").withColumnRenamed("total", "change").join(starts(functions.select("day", "slice", "pieces")), ["day", "slice"])
    known = written(known.withColumn("calm", (F.col("total") + F.col("up") <= cap) & (F.col("total") + F.col("down") >= 0)), "starts")
    calm = known.where("calm").select("day", "slice", (F.col("total") + F.col("change")).alias("neurons"), "calls", F.lit(0).cast("long").alias("refused"))

    def replay(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("number")
        total, accepted, refused = replayed(int(ordered["total"].iloc[0]), ordered["kind"].tolist(), ordered["amount"].tolist(), cap)
        return pd.DataFrame({"day": ordered["day"].iloc[:1], "slice": ordered["slice"].iloc[:1], "neurons": total, "calls": accepted, "refused": refused})

    tight = rows.join(known.where("not calm").select("day", "slice", "total"), ["day", "slice"])
    every = tight.groupBy("day", "slice").applyInPandas(replay, "day date, slice long, neurons long, calls long, refused long").unionByName(calm)
    return every.groupBy("day").agg(F.max_by("neurons", "slice").alias("neurons"), F.sum("calls").alias("calls"), F.sum("refused").alias("refused"))


def last_writes(uses: DataFrame, keys: list[str], minutes: int = 60) -> DataFrame:
    """The rows (keys, stamp) at which "last used" is written: the first use, then any more than ``minutes`` after the last write.

    Each use has a successor, the first use later than that: the next one in the minute where the wait ends, else the first of the next minute
    that has any, so no user is sorted whole.  Writes are the uses reached from the first along successors, found by doubling: each round doubles the
    length of the jumps and the number of uses reached.
    """
    wait, fine = minutes * 60_000_000, 60_000_000
    points = written(uses.select(*keys, F.unix_micros(F.col("stamp").cast("timestamp")).alias("at")).distinct(), "uses")
    ends = points.select(*keys, (F.col("at") + wait).alias("v"), F.col("at").alias("of"), F.lit(None).cast("long").alias("use"))
    both = points.select(*keys, F.col("at").alias("v"), F.lit(None).cast("long").alias("of"), F.col("at").alias("use")).unionByName(ends)
    both = both.withColumn("minute", F.floor(F.col("v") / fine))
    later = Window.partitionBy(*keys, "minute").orderBy(F.desc("v"), F.desc_nulls_last("of")).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.last("use", True).over(later)).where("of is not null").select(*keys, "minute", "of", "near")
    after = Window.partitionBy(*keys).orderBy(F.desc("minute")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = both.groupBy(*keys, "minute").agg(F.min("use").alias("first")).select(*keys, "minute", F.last("first", True).over(after).alias("next"))
    jumps = written(near.join(firsts, [*keys, "minute"]).select(*keys, F.col("of").alias("at"), F.coalesce("near", "next").alias("to")), "jumps")
    reached = written(jumps.groupBy(*keys).agg(F.min("at").alias("at")), "reached")
    while True:
        # what the jumps of this length reach from all that is reached so far
        landed = reached.join(jumps, [*keys, "at"]).where("to is not null").select(*keys, F.col("to").alias("at"))
        wider = written(reached.unionByName(landed).distinct(), "reached")
        further = jumps.select(*keys, F.col("at").alias("to"), F.col("to").alias("further"))
        jumps_next = jumps.where("to is not null").join(further, [*keys, "to"], "left").select(*keys, "at", F.col("further").alias("to"))
        if wider.count() == reached.count():
            return wider.select(*keys, F.timestamp_micros("at").cast("timestamp_ntz").alias("stamp"))
        reached, jumps = wider, written(jumps_next, "jumps")
