"""Vector code compression: each vector is cut into parts, and each part becomes the number of the nearest entry of its codebook.

Rows are gathered into chunks, and each part of a chunk gets a metric tree by the anchors hierarchy (``balls.py``); the trees
are written once as a table.  A round sends the codebooks, whose size depends on the parts, entries and dimension alone, to the tasks; each task
walks its trees, adds the cached counts and sums of balls that belong to one entry whole, and returns one row for each part, entry and position.
Spark adds these up and only the sums, as many numbers as the codebooks have, reach the driver.  The last walk gives every vector its code.

Components become floor(256 x).  Rows take no part if the vector is null or empty, or holds a null or a number that is not finite, or has another length than
the first kept vector (that with the smallest id, nulls last; ties by the components).  The length must be a multiple of the number of parts, and components
below 65536 in size, so that all sums are exact; else ValueError.  Ties of distance go to the lower entry.  Repeated rows are rows each, also among the first
entries; with fewer rows than entries the codebooks are shorter; no rows give no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.llm.balls import Balls, build, shares
from quire.llm.store import Tables

CHUNK = 8192
SCALE = 256
LARGEST = 1 << 24
KINDS = {"order": np.int64, "pivot": np.float64, "radius": np.float64, "total": np.int64, "begin": np.int32, "end": np.int32, "left": np.int32, "right": np.int32}


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, v, label) of the rows whose vector is not empty, whole and finite."""
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return named.where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def steps(column: pa.Array, dimension: int) -> np.ndarray:
    """Rows of whole components floor(256 x)."""
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"components must be below {LARGEST // SCALE} in size")
    return flat.astype(np.int64).reshape(-1, dimension)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of ``rows`` rows, and a last one."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - count)
            batch = batch.slice(part.num_rows)
            held.append(part)
            count += part.num_rows
            if count == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, count = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def planted(rows: DataFrame, dimension: int, parts: int, tables: Tables) -> DataFrame:
    """The chunks with a tree for each part: one row a chunk."""
    id_kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    width = dimension // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, CHUNK):
            whole = steps(table["v"].combine_chunks(), dimension)
            out = []
            for part in range(parts):
                points = np.ascontiguousarray(whole[:, part * width : (part + 1) * width])
                tree = build(points)
                out.append({"points": points.astype(np.int32).tobytes()} | {f: np.ascontiguousarray(getattr(tree, f), k).tobytes() for f, k in KINDS.items()})
            yield pa.RecordBatch.from_pydict({"vec_id": [table["vec_id"].to_pylist()], "label": [table["label"].to_pylist()], "trees": [out]}, schema=schema)

    made = StructType.fromDDL(f"vec_id array<{id_kind}>, label array<{label_kind}>, trees array<struct<points: binary, {', '.join(f'`{f}`: binary' for f in KINDS)}>>")
    schema = to_arrow_schema(made)
    return tables.keep(rows.mapInArrow(run, made), "trees")


def read(tree: dict, width: int) -> tuple[Balls, np.ndarray]:
    values = {f: np.frombuffer(tree[f], k) for f, k in KINDS.items()}
    values |= {f: values[f].reshape(-1, width) for f in ("pivot", "total")}
    return Balls(**values), np.frombuffer(tree["points"], np.int32).reshape(-1, width).astype(np.int64)


def sums(trees: DataFrame, books: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(counts, sums) of the points that belong to each entry, for each part."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [np.zeros(len(b), np.int64) for b in books]
        total = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            for row in batch.column(0):
                for part, tree in enumerate(row.as_py()):
                    balls, points = read(tree, width)
                    which, entry, _ = shares(balls, points, books[part])
                    ball = which >= 0
                    k = which[ball]
                    np.add.at(count[part], entry[ball], balls.end[k] - balls.begin[k])
                    np.add.at(total[part], entry[ball], balls.total[k])
                    np.add.at(count[part], entry[~ball], 1)
                    np.add.at(total[part], entry[~ball], points[~which[~ball]])
        for part in range(len(books)):
            used = np.flatnonzero(count[part])
            yield pa.RecordBatch.from_pydict({
                "place": np.concatenate([(part * len(books[0]) + used) * (width + 1), ((part * len(books[0]) + used)[:, None] * (width + 1) + np.arange(1, width + 1)).reshape(-1)]),
                "amount": np.concatenate([count[part][used], total[part][used].reshape(-1)]),
            })

    got = trees.select("trees").mapInArrow(run, "place long, amount long").groupBy("place").agg(F.sum("amount").alias("amount")).toArrow()
    flat = np.zeros(len(books) * len(books[0]) * (width + 1), np.int64)
    flat[got["place"].to_numpy()] = got["amount"].to_numpy()
    table = flat.reshape(len(books), len(books[0]), width + 1)
    return [(t[:, 0], t[:, 1:]) for t in table]


def coded(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    width = books[0].shape[1]
    kinds = {f.name: f.dataType.elementType.simpleString() for f in trees.select("vec_id", "label").schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, labels = batch.column(0)[k].values, batch.column(1)[k].values
                error, number = np.zeros(len(ids), np.int64), np.empty((len(ids), len(books)), np.int64)
                for part, tree in enumerate(batch.column(2)[k].as_py()):
                    balls, points = read(tree, width)
                    which, entry, _ = shares(balls, points, books[part])
                    ball = which >= 0
                    number[~which[~ball], part] = entry[~ball]
                    sizes = balls.end[which[ball]] - balls.begin[which[ball]]
                    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(balls.begin[which[ball]], sizes)
                    number[balls.order[at], part] = np.repeat(entry[ball], sizes)
                    error += ((points - books[part][number[:, part]]) ** 2).sum(1)
                digits = max(2, len(f"{len(books[0]) - 1:x}"))
                hexes = np.array([f"{n:0{digits}x}" for n in range(len(books[0]))])
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(["".join(r) for r in hexes[number].tolist()], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return trees.select("vec_id", "label", "trees").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def written(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept vector, and the codebooks: an array (entries, positions) for each part."""
    rows = kept(vectors, id_col, vector_col, label_col)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), F.transform("v", lambda x: F.floor(x * SCALE))).limit(entries).select("v").collect()
    if not first:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false"), []
    dimension = len(first[0].v)
    if dimension % parts:
        raise ValueError(f"vectors of {dimension} components cannot be cut into {parts} equal parts")
    rows = rows.where(F.size("v") == dimension)
    if any(len(r.v) != dimension for r in first):
        first = rows.orderBy(F.col("vec_id").asc_nulls_last(), F.transform("v", lambda x: F.floor(x * SCALE))).limit(entries).select("v").collect()
    start = steps(pa.array([r.v for r in first], pa.list_(pa.float64())), dimension)
    books = [np.ascontiguousarray(b) for b in np.split(start, parts, axis=1)]
    tables = Tables(vectors.sparkSession, "codes")
    trees = planted(rows, dimension, parts, tables)
    for _ in range(rounds):
        books = [np.where(n[:, None] > 0, s // np.maximum(n, 1)[:, None], b) for (n, s), b in zip(sums(trees, books), books, strict=True)]
    made = tables.keep(coded(trees, books), "codes")
    tables.drop("trees")
    return made, books


def digest(vectors: DataFrame, **names: str) -> DataFrame:
    """Each vector's code and error with the error of its label and a hash of the codebooks."""
    made, books = compress(vectors, **names)
    by_label = made.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = made.join(by_label.withColumnRenamed("label", "same"), F.col("label").eqNullSafe(F.col("same")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(written(books)).alias("codebooks_sha256"))


def restored(codes: DataFrame, books: list[np.ndarray], code_col: str = "code") -> DataFrame:
    """The rows with one more column ``vector``: the components that the code stands for, as numbers of the first scale."""
    digits = max(2, len(f"{len(books[0]) - 1:x}"))
    shown = F.array(*[F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in e]) for e in b.tolist()]) for b in books])
    picked = [F.element_at(F.element_at(shown, p + 1), F.conv(F.substring(code_col, p * digits + 1, digits), 16, 10).cast("int") + 1) for p in range(len(books))]
    return codes.withColumn("vector", F.concat(*picked))
