"""Hard-negative mining with bounds along a spanning tree of the anchors.

Anchors are the rows that negatives are asked for, a stated set.  They are sorted so that near ones meet, cut into groups of bounded size, and
each group gets its minimum spanning tree.  All rows are packed into blocks of bounded size.  A task takes a stripe of blocks and a band of trees; for
a block it scores the root of a tree exactly, and goes down the tree: a row's score with a child lies within its score with the parent
plus or minus the length of the edge times the row's norm.  Only rows whose bounds overlap the window in which the anchor still
looks for something are scored again; the others keep their bounds for the next edge.

Two passes: the first finds each anchor's positives (the best rows of its label; the window is above the worst of those found so far), the second
its negatives (rows of other labels whose score lies in a window below a positive's).  A task returns a few rows for each of its anchors,
and Spark ranks those of all stripes.  Scores are exact integers; bounds carry a margin for rounding.

Components become floor(256 x).  Rows take no part if the label or vector is null, or the vector is empty or holds a null or a number that is not finite, or has
another length than the first row's (that with the smallest id, nulls last; ties by the shorter vector).  Components of 65536 and more raise ValueError.
Ties of score go to the smaller id, a null id last.  A row that repeats is a row each time, as positive and as negative; a repeated anchor is
one anchor, and rows that share an anchor's id are not its positives.  Anchors of one id with different vectors or labels are asked for each.  Anchors without
positives, or without rows in a window, give no rows; no rows give no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.codes import gathered, kept, steps
from quire.llm.store import Tables

BLOCK_NUMBERS = 1 << 18  # of a block of rows: 4096 rows of 64 components
TREE_NUMBERS = 1 << 15  # of a group of anchors: 512 of 64 components
STRIPE, BAND, SPREAD = 64, 128, 32
NO_ID = np.iinfo(np.int64).max
MARGIN = 1e-9
PACKED = "number long, id binary, label binary, v binary"
FOUND = "tree long, anchor int, anchor_id long, window int, id long, score long"


def packed(rows: DataFrame, dimension: int, size: int, by_label: bool) -> DataFrame:
    """Up to ``size`` rows as one, numbered by partition and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for k, table in enumerate(gathered(batches, size)):
            v = steps(table["v"].combine_chunks(), dimension).astype(np.int32)
            ids, labels = (table[c].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vec_id", "label"))
            order = np.argsort(labels, kind="stable") if by_label else slice(None)
            yield pa.RecordBatch.from_pydict({"number": [first + k], "id": [ids[order].tobytes()], "label": [labels[order].tobytes()], "v": [v[order].tobytes()]})

    return rows.select("vec_id", "label", "v").mapInArrow(run, PACKED)


class Packed:
    """A packed row, opened."""

    def __init__(self, table: pa.Table, k: int, dimension: int) -> None:
        self.number = table["number"][k].as_py()
        self.id, self.label = (np.frombuffer(table[c][k].as_py(), np.int64) for c in ("id", "label"))
        self.v = np.frombuffer(table["v"][k].as_py(), np.int32).reshape(-1, dimension)
        self.largest = int(np.abs(self.v).max()) if self.v.size else 0

    def numbers(self, other: int) -> np.ndarray:
        """Its vectors as floats if all scores with components up to ``other`` are exact in these, else as integers."""
        return self.v.astype(np.float64 if self.largest * other * self.v.shape[1] < 1 << 53 else np.int64)


def spanning(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, length) of the minimum spanning tree from the most central vector: the k-th vector is order[k], its parent the parent[k]-th."""
    x = v.astype(np.float64)
    square = (x**2).sum(1)
    apart = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * (x @ x.T), 0))
    root = int(apart.sum(1).argmin())
    order, parent, length = [root], [-1], [0.0]
    near, link = apart[root].copy(), np.zeros(len(v), np.int64)
    near[root] = np.inf
    for k in range(1, len(v)):
        new = int(near.argmin())
        order.append(new)
        parent.append(int(link[new]))
        length.append(float(np.sqrt(((x[new] - x[order[link[new]]]) ** 2).sum())) * (1 + MARGIN))
        near[new] = np.inf
        closer = apart[new] < near
        closer &= np.isfinite(near)
        near[closer], link[closer] = apart[new][closer], k
    return np.array(order), np.array(parent), np.array(length)


class Best:
    """The best few (score, id) so far: higher scores first, then smaller ids."""

    def __init__(self, size: int) -> None:
        self.size, self.score, self.id = size, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        """What a score must reach to count."""
        return float(self.score[-1]) if len(self.score) == self.size else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > 4 * self.size:
            bar = np.partition(score, len(score) - self.size)[len(score) - self.size]
            score, ids = score[score >= bar], ids[score >= bar]
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        top = np.lexsort((ids, -score))[: self.size]
        self.score, self.id = score[top], ids[top]


class Search:
    """A group of anchors with its tree, and for each anchor the windows in which it looks for rows.

    windows: for each anchor (number, lowest, highest) of score; same: rows of the anchor's label (and another id), or of other labels.
    """

    def __init__(self, anchors: Packed, windows: list[list[tuple[int, float, float]]], same: bool, size: int) -> None:
        self.anchors, self.same = anchors, same
        self.order, self.parent, self.length = spanning(anchors.v)
        self.reach = np.zeros(len(self.order))
        for k in range(1, len(self.order)):
            self.reach[k] = self.reach[self.parent[k]] + self.length[k]
        self.windows = windows
        self.best = [[Best(size) for _ in w] for w in windows]
        self.scored = self.met = 0

    def meet(self, block: Packed) -> None:
        if not any(self.windows) or not len(block.id):
            return
        wide, a = block.numbers(self.anchors.largest), self.anchors.v.astype(np.int64)
        rows = np.arange(len(block.id))
        norm = np.sqrt((wide.astype(np.float64) ** 2).sum(1)) * (1 + MARGIN)
        own = wide @ a[self.order[0]].astype(wide.dtype)
        self.met += len(rows) * len(self.order)
        self.scored += len(rows)
        root = own.astype(np.float64)
        low = min(max(lowest, b.least) for w, bs in zip(self.windows, self.best, strict=True) for (_, lowest, _), b in zip(w, bs, strict=True))
        high = max(highest for w in self.windows for _, _, highest in w)
        slack = self.reach.max() * norm + MARGIN * (np.abs(root) + norm) + MARGIN
        rows = rows[(root + slack >= low) & (root - slack <= high)]
        wide, norm, ids, labels, own = wide[rows], norm[rows], block.id[rows], block.label[rows], own[rows]
        lows, highs = np.empty((len(self.order), len(rows))), np.empty((len(self.order), len(rows)))
        for k, anchor in enumerate(self.order.tolist()):
            if k:
                wider = self.length[k] * norm
                above, below = highs[self.parent[k]], lows[self.parent[k]]
                highs[k] = above + wider + MARGIN * np.abs(above)
                lows[k] = below - wider - MARGIN * np.abs(below)
            else:
                highs[k] = lows[k] = root[rows]
            if not self.windows[anchor] or not len(rows):
                continue
            fit = labels == self.anchors.label[anchor] if self.same else labels != self.anchors.label[anchor]
            if self.same:
                fit = fit & (ids != self.anchors.id[anchor])
            asked = np.zeros(len(rows), bool)
            for (_, lowest, highest), best in zip(self.windows[anchor], self.best[anchor], strict=True):
                asked |= (highs[k] >= max(lowest, best.least) - 0.5) & (lows[k] <= highest + 0.5)
            at = np.flatnonzero(fit & asked)
            if not len(at):
                continue
            score = (own[at] if not k else wide[at] @ a[anchor].astype(wide.dtype)).astype(np.int64)
            self.scored += len(at) if k else 0
            highs[k, at] = lows[k, at] = score
            for (_, lowest, highest), best in zip(self.windows[anchor], self.best[anchor], strict=True):
                inside = (score >= lowest) & (score <= highest)
                best.add(score[inside], ids[at[inside]])

    def results(self) -> list[tuple[int, int, int, int, int, int]]:
        whose = self.anchors
        return [(whose.number, k, int(whose.id[k]), w[0], int(i), int(s)) for k, (ws, bs) in enumerate(zip(self.windows, self.best, strict=True)) for w, b in zip(ws, bs, strict=True) for s, i in zip(b.score, b.id, strict=True)]


def met(blocks: DataFrame, trees: DataFrame, dimension: int, same: bool, size: int) -> DataFrame:
    """What the anchors find in each stripe of blocks.

    Stripes and bands bound what a task holds; every block meets every tree once, as the anchors are queries against all rows.  A block is sent
    once for each band, and a tree once for each stripe.
    """
    n_blocks, n_trees = blocks.count(), trees.count()
    stripes = max(1, min(n_blocks, SPREAD), -(-n_blocks // STRIPE))
    bands = max(1, -(-n_trees // BAND))
    names = ["tree", "anchor", "anchor_id", "window", "id", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        searches = []
        for k in range(right.num_rows):
            anchors = Packed(right, k, dimension)
            windows = [[(0, -np.inf, np.inf)] for _ in anchors.id] if same else [[] for _ in anchors.id]
            for w in () if same else right["windows"][k].as_py():
                # integer bounds: low * p <= 100 * s <= high * p
                windows[w["anchor"]].append((w["window"], -(-w["low"] // 100), w["high"] // 100))
            searches.append(Search(anchors, windows, same, size))
        for k in range(left.num_rows) if searches else ():
            block = Packed(left, k, dimension)
            for search in searches:
                search.meet(block)
        rows = [r for s in searches for r in s.results()]
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), KINDS, strict=True)] if rows else [pa.array([], kind) for kind in KINDS], names)

    dealt = lambda df, name, n: df.withColumn(name, F.pmod(F.xxhash64("number"), F.lit(n)).cast("int"))
    left = dealt(blocks, "stripe", stripes).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    right = dealt(trees, "band", bands).withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    return left.groupBy("stripe", "band").cogroup(right.groupBy("stripe", "band")).applyInArrow(run, FOUND)


KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())


def ranked(found: DataFrame, size: int) -> DataFrame:
    """The first ``size`` of each anchor and window, with their rank from 1."""
    by = Window.partitionBy("tree", "anchor", "window").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= size)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    label: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` and ``label`` (labels in place of the column) are expressions over vec_id and label; ids and labels are integers.  Negatives of a
    positive with score p have scores s with low * p <= 100 * s <= high * p.
    """
    rows = kept(vectors, id_col, vector_col, label_col).withColumn("vec_id", F.col("vec_id").cast("long"))
    rows = rows.withColumn("label", (F.col("label") if label is None else label).cast("long")).where("label is not null")
    first = rows.select("vec_id", F.size("v").alias("n")).orderBy(F.col("vec_id").asc_nulls_last(), "n").limit(1).collect()
    if not first:
        return rows.select(*[F.lit(0).cast("int" if c == "rank" else "long").alias(c) for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")]).where("false")
    dimension = first[0].n
    rows = rows.where(F.size("v") == dimension)
    tables = Tables(vectors.sparkSession, "negatives")
    blocks = tables.keep(packed(rows, dimension, max(64, BLOCK_NUMBERS // dimension), by_label=True), "blocks")

    # anchors that are alike stand near each other: by label, then by the signs of their first components
    asked = tables.keep(rows.where(is_anchor).dropDuplicates(["vec_id", "label", "v"]), "anchors")
    per = max(16, min(512, TREE_NUMBERS // dimension))
    signs = F.expr(f"aggregate(slice(v, 1, {min(16, dimension)}), 0, (s, x) -> 2 * s + if(x > 0, 1, 0))")
    near = asked.withColumn("near", signs).repartitionByRange(max(1, -(-asked.count() // (8 * per))), "label", "near", "vec_id").sortWithinPartitions("label", "near", "vec_id")
    trees = tables.keep(packed(near, dimension, per, by_label=False), "trees")

    best = tables.keep(ranked(met(blocks, trees, dimension, True, positives), positives), "positives")
    bounds = F.struct("anchor", F.col("rank").alias("window"), (F.col("score") * low).alias("low"), (F.col("score") * high).alias("high"))
    windows = best.groupBy(F.col("tree").alias("number")).agg(F.collect_list(bounds).alias("windows"))
    opened = tables.keep(trees.join(windows, "number"), "windows")
    hard = ranked(met(blocks, opened, dimension, False, negatives), negatives)
    own = best.select("tree", "anchor", F.col("rank").alias("window"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    shown = lambda c, name: F.when(F.col(c) != int(NO_ID), F.col(c)).alias(name)
    return hard.join(own, ["tree", "anchor", "window"]).select(
        shown("anchor_id", "anchor_id"), shown("positive", "positive_id"), F.col("rank").cast("int").alias("rank"), shown("id", "negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
