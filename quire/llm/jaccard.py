"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of word shingles reaches a threshold.
Under one global order of shingles, two linked sets share at least l shingles among the first
``|x| - ceil(t|x|) + l`` of each.  The longer prefix (l > 1) costs more postings but asks for more shared
shingles before a pair is verified.  Each document takes the l whose estimated cost (postings touched plus
candidates verified, from the true counts of its prefix's shingles) is least; a pair needs the smaller l of its two.

The global order puts shingles that many documents hold last, by fine classes of their estimated frequency in a
count sketch of fixed size over all documents, then by hash.  Any order is lossless, so the estimate only
moves cost.  Its error grows with the root of the input, and so does the number of documents above which a shingle is hot;
else usual shingles became hot on large inputs and led most documents to one cluster, which is compared in blocks.  Equal sets are one representative from the start; see ``graph.connect`` for how groups of
near copies are joined without making all their pairs.

Scans: one for the sketch, one for sets and prefixes, one per verification for the sets of candidates
(behind a fixed-size bitmap).  Shuffled: packed sketches, prefixes (about a tenth of the shingles for
t = 0.9) once to find equal sets and four bytes a shingle to find those that two sets have, postings of these alone, candidate sets.
A table goes as soon as nothing reads it.  Shingles are compared by 64-bit hashes.

Rows are addressed by a hash of their set, never by their id, so an id with several texts is several documents.

Defined results: a text with fewer words than a shingle is one shingle of all its words; null or
wordless texts have an empty set and link with nothing; a null id keeps its row, with a null component and
no links; every row of the input is one row of the result, also where rows repeat an id, with the same text or
with others (each has the component of its own text); of equal ids as the smallest one, either stands for the group;
ids are integers, others raise a TypeError; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from quire.llm import graph
from quire.llm.counters import counters
from quire.llm.graph import connect, shared_postings
from quire.llm.repeats import bucket_bits, short, twice
from quire.llm.store import Tables, bitmap, present, unused
from quire.llm.text import LOWER, SPACE, mix, ngrams, parts, span_hashes, spans

MORE = 3  # an l of up to MORE + 1, or a quarter of the shortest prefix, may be chosen
SKETCH_BITS = 22
SHARED_BITS = 26
QUIET = 16  # a deviation of counters up to which HOT documents may share a shingle that is not hot
SLACK, FINE = 3, 7  # deviations below and above the usual count between which classes are fine
VERIFY_COST = 40.0  # of one candidate, in postings


def shingle_sets(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, shingle hashes, offsets): each row's distinct shingles in order of hash."""
    for first, last, data, offsets in parts(column):
        rows = last - first
        data = LOWER[data]
        starts, ends, owner = spans(~SPACE[data], offsets)
        words = span_hashes(data, starts, ends)
        at, hashes = ngrams(words, owner, size)
        owners = owner[at]
        counts = np.bincount(owner, minlength=rows)
        short = (counts > 0) & (counts < size)
        if short.any():
            begin = np.cumsum(counts) - counts
            some = np.flatnonzero(short)
            whole = np.full(len(some), 0xABCD, np.uint64)
            for k in range(size - 1):
                has = counts[some] > k
                whole[has] = mix(whole[has] + words[begin[some[has]] + k])
            hashes, owners = np.concatenate([hashes, whole]), np.concatenate([owners, some])
        order = np.lexsort((hashes, owners))
        hashes, owners = hashes[order], owners[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
        hashes, owners = hashes[fresh], owners[fresh]
        yield first, last, hashes, np.searchsorted(owners, np.arange(rows + 1))


def order_classes(counts: np.ndarray) -> tuple[np.ndarray, int]:
    """(by counter a class, the smaller the rarer; how many documents may share a shingle that still gets a small class by chance).

    A counter holds the usual number of chance shingles, give or take its root.  Classes are quarters of that deviation, as even a
    shingle that stands out little is worth a later place, and doublings far above it.  A shingle that prefixes hold stands
    seldom in more documents than a few deviations, while a fixed number would be passed by usual ones on large inputs.
    """
    over = counts.astype(np.float32)
    usual = float(np.median(over))
    noise = (usual + 1) ** 0.5
    # in place, as the table is the largest thing that the driver holds
    over -= usual
    over /= noise
    far = over > FINE
    steep = np.log2(over[far] / FINE)
    np.clip(over, -SLACK, FINE, out=over)
    over += SLACK
    over *= 4
    over[far] += steep
    return np.ceil(over, out=over).astype(np.uint8), max(graph.HOT, int(graph.HOT * noise / QUIET))


def frequency_classes(docs: DataFrame, text_col: str, size: int, bits: int = SKETCH_BITS) -> tuple[np.ndarray, int]:
    """What ``order_classes`` makes of the counts of all documents' shingles, by hash."""

    def at(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, hashes, _ in shingle_sets(batch.column(0), size):
            yield (hashes >> np.uint64(64 - bits)).astype(np.int64)

    return order_classes(counters(docs.select(text_col), at, 1 << bits))


def set_ids(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set of shingles, by two sums of their hashes and their number."""
    out = np.diff(offsets).astype(np.uint64)
    for salted in (hashes ^ np.uint64(0x5BD1), hashes + np.uint64(0x9E37)):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(salted), out=sums[1:])
        out = mix(out ^ (sums[offsets[1:]] - sums[offsets[:-1]]))
    return out


def prefixes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, classes: np.ndarray) -> DataFrame:
    """(doc, row, n_shingles, set, shortest, prefix): the longest prefix that may be used, and the least needed.

    ``row`` is a hash of id and text, ``set`` one of the shingles.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    bits = int(np.log2(len(classes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, hashes, offsets in shingle_sets(batch.column(2), size):
                rows = last - first
                counts = np.diff(offsets)
                owners = np.repeat(np.arange(rows), counts)
                rank = shared.value[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
                ordered = hashes[np.lexsort((hashes, rank, owners))]
                shortest = np.where(counts > 0, counts - -(-percent * counts // 100) + 1, 0)
                longest = np.minimum(counts, shortest + np.maximum(MORE, shortest // 4))
                place = np.arange(len(hashes)) - np.repeat(offsets[:-1], counts)
                values = pa.array(ordered[place < np.repeat(longest, counts)].view(np.int64))
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(longest)).astype(np.int32), values)
                made = [pa.array(counts.astype(np.int64)), pa.array(set_ids(hashes, offsets).view(np.int64)), pa.array(shortest.astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(first, rows) for c in (0, 1)] + made, ["doc", "row", "n_shingles", "set", "shortest", "prefix"])

    narrow = docs.select(F.col(id_col).cast("long"), F.xxhash64(id_col, text_col), text_col)
    return narrow.mapInArrow(run, "doc long, row long, n_shingles long, set long, shortest int, prefix array<long>")


def repeated_tokens(sets: DataFrame, tables: Tables, bits: int) -> np.ndarray:
    """A bitmap of the shingles that stand in the prefixes of two sets or more."""

    def tokens(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        # a prefix has the smallest hashes of its set, so they are mixed again to fill the buckets alike
        yield short(mix(batch.column(0).flatten().to_numpy().view(np.uint64)), bits)

    return bitmap(tables.keep(twice(sets.select("prefix"), tokens, bits), "twice"), SHARED_BITS)


def possible(sets: DataFrame, known: np.ndarray, bits: int) -> DataFrame:
    """(id, rank, size, shortest, pos, token): the postings of prefixes but those whose shingle no other prefix has; a few of these stay by chance."""
    shared = sets.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            hashes = lists.flatten().to_numpy()
            of, ends = pc.list_parent_indices(lists).to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())
            some = np.flatnonzero(present(shared.value, short(mix(hashes.view(np.uint64)), bits)))
            place = some - np.append(0, ends)[of[some]]
            ids = [batch.column(c).take(pa.array(of[some])) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(place.astype(np.int32)), pa.array(hashes[some])], ["id", "rank", "size", "shortest", "pos", "token"])

    narrow = sets.select("id", F.coalesce("least", F.lit((1 << 63) - 1)).alias("rank"), F.col("n").cast("int").alias("size"), "shortest", "prefix")
    return narrow.mapInArrow(run, "id long, rank long, size int, shortest int, pos int, token long")


def adapt(postings: DataFrame, percent: int, tables: Tables) -> DataFrame:
    """Choose each document's l and keep its postings of that prefix: (token, id, need, size, n, center).

    ``postings`` (token, id, size, shortest, pos, n, center) are those of shared tokens, n the documents with the
    token.  A prefix for l touches the sum of n - 1 postings; at most that over l documents can share l of
    them.  The estimated cost is postings + VERIFY_COST * candidates.  A document whose shortest prefix
    touches nobody links with nobody and is left out.
    """
    last = F.least(F.greatest(F.lit(MORE), F.floor(F.col("shortest") / 4)).cast("int"), F.col("size") - F.col("shortest")) + 1
    least = F.ceil(F.col("size") * percent / 100).cast("int")
    options = [F.least(x, last, least).cast("int") for x in (F.lit(1), F.lit(2), F.lit(3), F.greatest(F.lit(1), F.floor(last / 2)), last)]
    touched = [F.sum(F.when(F.col("pos") < F.col("shortest") + l - 1, F.col("n") - 1).otherwise(0)) for l in options]
    sums = postings.groupBy("id").agg(*[t.alias(f"t{k}") for k, t in enumerate(touched)], *[F.min(l).alias(f"l{k}") for k, l in enumerate(options)])
    costs = F.array(*[F.struct((F.col(f"t{k}") * (1 + VERIFY_COST / F.col(f"l{k}"))).alias("cost"), F.col(f"l{k}").alias("need")) for k in range(len(options))])
    chosen = tables.keep(sums.where("t0 > 0").select("id", F.array_min(costs)["need"].alias("need")), "needs")
    kept = postings.join(chosen, "id").where("pos < shortest + need - 1")
    return tables.keep(kept.select("token", "id", "need", "size", "n", "center"), "adapted")


def fetcher(docs: DataFrame, id_col: str, text_col: str, size: int, sets: DataFrame):
    """A function that gives (id, record), the sorted shingle hashes, of the sets with given ids.

    ``sets`` (id, row) names one row of each set; a row that is not named is not even split into words.
    """
    narrow = docs.select(F.xxhash64(id_col, text_col).alias("row"), text_col)

    def fetch(ids: DataFrame) -> DataFrame:
        named = sets.join(ids, "id")
        words = docs.sparkSession.sparkContext.broadcast(bitmap(named.select("row")))

        def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(present(words.value, batch.column(0).to_numpy().view(np.uint64))))
                for _, _, hashes, offsets in shingle_sets(batch.column(1), size):
                    blobs = [hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(set_ids(hashes, offsets).view(np.int64)), pa.array(blobs, pa.binary())], ["id", "record"])

        return narrow.mapInArrow(records, "id long, record binary").join(ids, "id").dropDuplicates(["id"])

    return fetch


def jaccard_at_least(percent: int):
    """Which sorted sets have a Jaccard similarity of ``percent`` or more with a given one."""

    def similar(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        counts = np.array([len(x) for x in others])
        out = (100 * np.minimum(counts, len(one)) >= percent * np.maximum(counts, len(one))) & (counts > 0)
        some = np.flatnonzero(out)
        if len(some) and len(one):
            values = np.concatenate([others[k] for k in some])
            at = np.searchsorted(one, values)
            at[at == len(one)] = 0
            same = np.add.reduceat(one[at] == values, np.cumsum(np.append(0, counts[some][:-1])), dtype=np.int64)
            out[some] = 100 * same >= percent * (counts[some] + len(one) - same)
        return out

    return similar


def linked(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, *, nameless: bool) -> tuple[DataFrame, DataFrame]:
    """The rows (doc, row, n_shingles, set), and (set, root, least) of every set: its group, and its smallest id.

    Rows without an id have a set only if ``nameless``.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer")
    tables = Tables(docs.sparkSession, "jaccard")
    classes, most = frequency_classes(docs, text_col, size)
    made = tables.keep(prefixes(docs, id_col, text_col, size, percent, classes), "prefixes")
    some = made.where("n_shingles > 0" if nameless else "n_shingles > 0 and doc is not null")
    # equal sets: one representative
    same = some.groupBy(F.col("set").alias("id")).agg(F.min("doc").alias("least"), F.min("row").alias("row"), F.any_value("n_shingles").alias("n"), F.any_value("shortest").alias("shortest"), F.any_value("prefix").alias("prefix"))
    same = tables.keep(same, "sets")
    # without prefixes, which are most of both tables
    rows = tables.keep(made.select("doc", "row", "n_shingles", "set"), "rows")
    tables.drop("prefixes")
    named = tables.keep(same.select("id", "least", "row"), "ids")
    bits = bucket_bits(docs.select(F.col(text_col).alias("text")))
    spread = tables.keep(possible(same, repeated_tokens(same, tables, bits), bits), "possible")
    tables.drop("sets", "twice")
    postings = adapt(shared_postings(spread, tables, "join", "rank"), percent, tables)
    tables.drop("possible", "join-shared", "join-postings", "needs")
    roots = connect(postings, percent, fetcher(docs, id_col, text_col, size, named.select("id", "row")), jaccard_at_least(percent), tables, "join", most=most)
    tables.drop("adapted")
    sets = named.select("id", "least").join(tables.keep(roots, "roots"), "id", "left")
    return rows, tables.keep(sets.select(F.col("id").alias("set"), F.coalesce("root", "id").alias("root"), "least"), "named")


def groups(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: the smallest id that links reach, itself included."""
    rows, sets = linked(docs, size, percent, id_col, text_col, nameless=False)
    least = sets.groupBy("root").agg(F.min("least").alias("component_id"))
    out = rows.where("doc is not null").join(sets.join(least, "root").select("set", "component_id"), "set", "left")
    # without shingles a document stands alone; without an id it has no component
    out = out.select("doc", "n_shingles", F.coalesce("component_id", "doc").alias("component_id"))
    out = out.union(rows.where("doc is null").select("doc", "n_shingles", F.lit(None).cast("long")))
    return out.select(F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), "n_shingles", "component_id")


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    A row without an id comes after all ids; of rows with an equal id the smaller hash of the text comes first; rows with equal id and
    text are one document and one of them stays.  Texts without words stand alone.
    """
    rows, sets = linked(docs, size, percent, id_col, text_col, nameless=True)
    member = rows.where("n_shingles > 0").join(sets.select("set", "root"), "set").select("root", "row", F.struct(F.col("doc").isNull().alias("last"), "doc", "row").alias("place"))
    # written, so that Spark knows their true sizes when it chooses the joins (few rows go and fewer repeat) and can split a hot group
    tables = Tables(docs.sparkSession, "first")
    stays = tables.keep(member.groupBy("root").agg(F.min("place")["row"].alias("stays")), "stays")
    row = unused("row", docs)
    gone = tables.keep(member.join(stays, "root").where("row <> stays").select(F.col("row").alias(row)).distinct(), "gone")
    repeated = tables.keep(rows.groupBy(F.col("row").alias(row)).agg(F.count("*").alias("n")).where("n > 1").select(row), "repeated")
    left = docs.withColumn(row, F.xxhash64(id_col, text_col)).join(gone, row, "left_anti")
    once = left.join(repeated, row, "left_anti").unionByName(left.join(repeated, row, "left_semi").dropDuplicates([row]))
    return once.select(*[F.col(f"`{c}`") for c in docs.columns])
