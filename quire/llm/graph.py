"""Connected groups over pairs, and groups of records that share keys.

Everything stays in Spark tables: no link, component or fingerprint reaches the driver, which only
learns whether edges are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.store import Tables

HOT = 64  # records that share a token, above which they are compared in blocks, if the caller names no number
BLOCK = 32_000  # sizes of a block's records together
# which of the records a given one is linked with
Similar = Callable[[np.ndarray, Sequence[np.ndarray]], np.ndarray]
# whether a pair is worth a look, by columns of both
Close = Callable[[dict[str, Column], dict[str, Column]], Column]


def _first(column: Column) -> Column:
    """Orders ids at random but alike everywhere, so that chains shrink by a constant share each round."""
    return F.struct(F.xxhash64(column).alias("h"), column.alias("id"))


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(id, root) of every id in the edges (u, v), one root a connected group.

    Each round hooks every id to the neighbour (or itself) that comes first, then contracts the edges; the
    rounds grow with the logarithm of the longest chain.  The tables of hooks are written, so that the joins
    read two plain exchanges and Spark can split a hot id.
    """
    left = tables.keep(edges.select("u", "v").where("u <> v").distinct(), f"{name}-edges-0")
    roots, k = None, 0
    while not left.isEmpty():
        both = left.select("u", "v").union(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooks = both.groupBy("u").agg(F.least(F.min(_first(F.col("v"))), _first(F.col("u")))["id"].alias("m"))
        hooks = tables.keep(hooks, f"{name}-hooks-{k}")
        as_v = hooks.select(F.col("u").alias("v"), F.col("m").alias("mv"))
        next_left = left.join(hooks.select("u", F.col("m").alias("mu")), "u").join(as_v, "v").where("mu <> mv")
        next_left = next_left.select(F.col("mu").alias("u"), F.col("mv").alias("v")).distinct()
        if roots is None:
            roots = hooks.select(F.col("u").alias("id"), F.col("m").alias("root"))
        else:
            moved = hooks.select(F.col("u").alias("root"), F.col("m").alias("__m"))
            roots = roots.join(moved, "root", "left").select("id", F.coalesce("__m", "root").alias("root"))
            roots = tables.keep(roots, f"{name}-roots-{k}")
        left = tables.keep(next_left, f"{name}-edges-{k + 1}")
        k += 1
    if roots is None:
        return left.select(F.col("u").alias("id"), F.col("v").alias("root"))
    # a hook may itself have been hooked in the same round: follow the pointers to their ends
    while True:
        further = roots.select(F.col("id").alias("root"), F.col("root").alias("__m"))
        jumped = roots.join(further, "root", "left").select("id", F.coalesce("__m", "root").alias("root"), (F.coalesce("__m", "root") != F.col("root")).alias("__moved"))
        jumped = tables.keep(jumped, f"{name}-jump-{k}")
        k += 1
        roots = jumped.select("id", "root")
        if jumped.where("__moved").isEmpty():
            return roots


def shared_postings(postings: DataFrame, tables: Tables, name: str, rank: str = "id") -> DataFrame:
    """The postings whose token more than one id has, with that number ``n`` and the token's first id ``center`` by ``rank``.

    What stands earlier is more often the source of copies than one of them, so a rank by age makes the stars larger.
    """
    shared = postings.groupBy("token").agg(F.count("*").alias("n"), F.min_by("id", rank).alias("center")).where("n > 1")
    return tables.keep(postings.join(tables.keep(shared, f"{name}-shared"), "token"), f"{name}-postings")


def verified(pairs: DataFrame, held: DataFrame, similar: Similar) -> DataFrame:
    """The linked ones of the pairs (u, v), by the records (id, record) of both."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("ru"), batch.column("rv"), strict=True)
            keep = [bool(similar(np.frombuffer(a.as_buffer(), np.uint64), [np.frombuffer(b.as_buffer(), np.uint64)])[0]) for a, b in both]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    full = pairs.join(held.select(F.col("id").alias("u"), F.col("record").alias("ru")), "u").join(held.select(F.col("id").alias("v"), F.col("record").alias("rv")), "v")
    return full.mapInArrow(check, "u long, v long")


def clusters(postings: DataFrame, groups: DataFrame, tables: Tables, name: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(id, cluster) of records that share hot tokens, directly or in chains, and the blocks in which to compare them.

    A cluster of one group needs no comparison and has no blocks.  Records of a large group fill blocks of their own, which
    are not compared with each other; small groups share blocks.  The second table is (id, comp, pair, side):
    each record once for every pair of blocks that its block is in.
    """
    hot = postings.where((F.col("n") > most) & (F.col("id") != F.col("center"))).select(F.col("id").alias("u"), F.col("center").alias("v"))
    found = tables.keep(components(hot, tables, f"{name}-hot").withColumnRenamed("root", "cluster"), f"{name}-clusters")
    sizes = postings.groupBy("id").agg(F.min("size").cast("long").alias("size"))
    members = found.join(sizes, "id").join(groups.withColumnRenamed("root", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    members = tables.keep(members, f"{name}-members")
    by_group = members.groupBy("cluster", "comp").agg(F.sum("size").alias("total"))
    small = F.sum(F.when(F.col("total") < BLOCK, F.col("total")).otherwise(0)).alias("small")
    by_cluster = by_group.groupBy("cluster").agg(small, F.count("*").alias("groups")).where("groups > 1").drop("groups")
    own = F.col("total") >= BLOCK
    count = F.ceil(F.when(own, F.col("total")).otherwise(F.col("small")) / BLOCK)
    number = F.pmod(F.xxhash64(F.when(own, F.col("id")).otherwise(F.col("comp"))), F.greatest(F.lit(1), count))
    key = F.struct(F.when(own, F.col("comp")).alias("own"), number.alias("number"))
    placed = members.join(by_group, ["cluster", "comp"]).join(by_cluster, "cluster").select("id", "comp", "cluster", key.alias("block"))
    placed = tables.keep(placed, f"{name}-placed")
    blocks = tables.keep(placed.select("cluster", "block").distinct(), f"{name}-blocks")
    a, b = blocks.withColumnRenamed("block", "a"), blocks.withColumnRenamed("block", "b")
    apart = (F.col("a.own") != F.col("b.own")) | F.col("a.own").isNull() | F.col("b.own").isNull()
    pairs = a.join(b, "cluster").where((F.col("a") <= F.col("b")) & apart).withColumn("pair", F.xxhash64("cluster", "a", "b"))
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("block")), F.struct(F.lit(1).alias("side"), F.col("b").alias("block")))
    )
    wanted = pairs.select("cluster", "pair", F.inline(sides))
    return found, placed.join(wanted, ["cluster", "block"]).select("id", "comp", "pair", "side")


def block_links(rows: DataFrame, held: DataFrame, similar: Similar) -> DataFrame:
    """Links (u, v) between groups that the blocks' records show; enough of them to connect what is connected."""

    def compare(table: pa.Table) -> pa.Table:
        ids, comps, sides = (table[c].to_numpy() for c in ("id", "comp", "side"))
        records = [np.frombuffer(r.as_buffer(), np.uint64) for r in table["record"]]
        parent = {c: c for c in comps.tolist()}

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        out: list[tuple[int, int]] = []
        for k, i in enumerate(left):
            others = right if len(right) else left[k + 1 :]
            mine = top(int(comps[i]))
            others = [j for j in others if top(int(comps[j])) != mine]
            if others:
                for j in np.array(others)[similar(records[i], [records[j] for j in others])]:
                    x, y = top(int(comps[i])), top(int(comps[j]))
                    if x != y:
                        parent[x] = y
                        out.append((int(ids[i]), int(ids[j])))
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return rows.join(held, "id").groupBy("pair").applyInArrow(compare, "u long, v long")


def connect(
    postings: DataFrame, percent: int, fetch: Callable[[DataFrame], DataFrame], similar: Similar, tables: Tables, name: str, close: Close = lambda a, b: F.lit(True), marks: tuple[str, ...] = (), most: int | None = None
) -> DataFrame:
    """(id, root) of the groups that links make among records that share tokens.

    ``postings`` (token, id, need, size, n, center): a pair is a candidate if it shares at least the smaller ``need``
    of tokens and the smaller size is at least ``percent`` of the larger, which any link implies.
    ``fetch(ids)`` gives (id, record), ``similar`` tells which records are linked.  ``close`` may rule out pairs before their
    records are fetched, by the size and the columns ``marks`` of the postings of each.  ``most`` stands for HOT.
    With a column ``lead``, a pair shares at least the ``need`` of its larger record (of equal ones, of any) in tokens with which that one leads.

    Pairs within a group are not all made, and no link between groups is lost:
    1. each record meets the first record of its tokens (a star, linear in the postings) and verified stars
       join into groups;
    2. records with a token that more than ``most`` share fall into clusters.  Within a cluster, records of
       different groups are compared in blocks: a task gets two blocks and returns only links that connect;
    3. other candidates share only tokens of at most ``most`` records, so their number is linear; those of
       different groups and clusters are made and verified.
    """

    most = HOT if most is None else most

    def alike(a: str, b: str) -> Column:
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    def by(prefix: str) -> dict[str, Column]:
        return {c: F.col(prefix + c) for c in ("size", *marks)}

    heads = postings.where("id = center").select(F.col("id").alias("center"), *[F.col(c).alias(f"c_{c}") for c in ("size", *marks)])
    heads = tables.keep(heads.dropDuplicates(["center"]), f"{name}-heads")
    stars = (
        postings.where("id <> center")
        .groupBy("center", "id")
        .agg(F.count("*").alias("shared"), F.min("need").alias("need"), F.min("size").alias("size"), *[F.min(c).alias(c) for c in marks])
        .where("shared >= need")
        .join(heads, "center")
        .where(alike("size", "c_size") & close(by(""), by("c_")))
        .select(F.col("center").alias("u"), F.col("id").alias("v"))
    )
    stars = tables.keep(stars, f"{name}-stars")
    held = tables.keep(fetch(stars.select(F.explode(F.array("u", "v")).alias("id")).distinct()), f"{name}-records-1")
    links = tables.keep(verified(stars, held, similar), f"{name}-links-1")
    groups = components(links, tables, f"{name}-c1")
    tables.drop(f"{name}-records-1", f"{name}-stars", f"{name}-heads")

    clustered, rows = clusters(postings, groups, tables, name, most)
    rows = tables.keep(rows, f"{name}-rows")

    led = "lead" in postings.columns
    cold = postings.where(F.col("n") <= most).select("token", "id", "need", "size", (F.col("lead") if led else F.lit(True)).alias("lead"), *marks).join(groups.withColumnRenamed("root", "comp"), "id", "left")
    cold = cold.join(clustered, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    cold = tables.keep(cold, f"{name}-cold")
    mixed = cold.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("lead").alias("lead")).where("lo <> hi and lead").select("token")
    rest = tables.keep(cold.join(tables.keep(mixed, f"{name}-mixed"), "token"), f"{name}-rest")
    x, y = (some.select("token", *[F.col(c).alias(f"{k}_{c}") for c in ("id", "need", "size", "comp", "cluster", *marks)]) for k, some in (("x", rest.where("lead")), ("y", rest)))
    once = (F.col("x_size") > F.col("y_size")) | ((F.col("x_size") == F.col("y_size")) & (F.col("x_id") < F.col("y_id"))) if led else F.col("x_id") < F.col("y_id")
    u, v = (f("x_id", "y_id") for f in (F.least, F.greatest))
    cross = (
        x.join(y, "token")
        .where(once & (F.col("x_comp") != F.col("y_comp")) & alike("x_size", "y_size") & close(by("x_"), by("y_")) & F.coalesce(F.col("x_cluster") != F.col("y_cluster"), F.lit(True)))
        .groupBy(u.alias("u"), v.alias("v"))
        .agg(F.count("*").alias("shared"), F.min("x_need" if led else F.least("x_need", "y_need")).alias("need"))
        .where("shared >= need")
        .select("u", "v")
    )
    cross = tables.keep(cross, f"{name}-cross")
    tables.drop(*(f"{name}-{t}" for t in ("cold", "mixed", "rest", "placed", "members")))
    held = tables.keep(fetch(cross.select(F.explode(F.array("u", "v")).alias("id")).union(rows.select("id")).distinct()), f"{name}-records-2")
    more = tables.keep(verified(cross, held, similar).union(block_links(rows, held, similar)), f"{name}-links-2")
    tables.drop(*(f"{name}-{t}" for t in ("postings", "rows", "shared", "records-2")))
    return components(links.union(more), tables, f"{name}-c2")
