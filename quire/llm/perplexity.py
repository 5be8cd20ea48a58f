"""LM scoring: cross-entropy difference.

A target and a background model of the same form give every token a loss; a document's score is the mean
difference target minus background (Moore and Lewis, 2010): the lower, the more like the target.

Both models are n-gram models with n of 1 and 2 over one vocabulary: the lower-cased words of both corpora, and one place for
an unknown word.  With V places, N tokens and counts c,

    P(w) = (c(w) + ALPHA) / (N + ALPHA V),    P(w | v) = (c(v w) + MU / V) / (c(v) + MU),

the first word of a text follows a start sign, and what P(w | v) lacks to 1 is the chance that a text ends.  The loss of a token
is the mean of both models' losses in nats.  A document's own counts are left out of a model that counted them, so a text
does not make itself likely, while copies of it do.

The counts are all words and word pairs of all documents: tables in Spark that grow with the corpus, of packed sorted hashes in
buckets, whose number follows the bytes of text.  Log-losses are sums over words and pairs, so each document sends its words
and pairs to their buckets and gets back one row of sums a bucket.  Words and pairs above a fixed share of all tokens (at most
2 * HOT_SHARE of them, a table of proven size) are looked up in place.  On a large corpus a word below that share can still be more than a task
should take; a bucket whose other words and pairs occur more than TASK_TOKENS times is split: documents send to one of its parts, by their keys,
and each part has the bucket's counts.  Sums are whole numbers, so they do not depend on their order.

Scans: one to pick the target's texts, one of both corpora for counts, one for scores.

Defined results: null, empty or wordless texts have 0 tokens and null losses; texts are scored whole; repeated rows score
alike, each with its row, and count as often as they occur; rows that repeat an id with other texts are scored each by its text;
rows without an id are scored and never belong to the target; ids of the target that repeat count once; equal scores are not ordered;
without target documents the target model knows no word; empty tables give no rows; extra columns are ignored.
Hashes of 32 bits and the bucket's stand for words and pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import Tables, bitmap, present
from quire.llm.text import STEP, mix, parts, tokens

ALPHA, MU = 0.1, 64.0
START = np.uint64(0x5BF03635F0935AD1)
BUCKET_BYTES = 16 << 20  # text for which there is one bucket
FEWEST_BITS = 6
HOT_SHARE = 1 << 14  # a word or pair is looked up in place if it makes more than this part of all tokens
TASK_TOKENS = 1 << 24  # words or pairs, hot ones apart, for which a bucket has one part
HELD = 1 << 21  # keys that a task adds up at once
UNIT = float(1 << 20)  # losses are whole numbers of this part of a nat
WORDS, PAIRS, LOCAL = 1, 2, 3


@dataclass(frozen=True)
class Models:
    """Counts (bucket, kind, keys, target, background) as packed arrays; of each corpus tokens and texts; the vocabulary; the hot counts; split buckets."""

    counts: DataFrame
    bits: int
    tokens: tuple[int, int]
    texts: tuple[int, int]
    vocabulary: int
    hot: dict[int, np.ndarray]  # by kind: (keys, target, background) of uint64
    split: dict[tuple[int, int], int]  # (bucket, kind): parts, where there are several; fewer than tokens / TASK_TOKENS and than buckets


def units(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, word hashes, pair hashes, rows) of each slice of texts; a pair is a word and the one before it or START."""
    for first, last, data, offsets in parts(pc.utf8_lower(column.cast(pa.large_string()))):
        words, rows = tokens(data, offsets)
        before = np.append(START, words[:-1])[: len(words)]
        before[np.append(True, rows[1:] != rows[:-1])[: len(rows)]] = START
        yield first, last, words, mix(before * STEP + words), rows


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold the largest, their bytes by place, so that empty places compress away."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(values) or values.max() <= np.iinfo(t).max)
    width = np.dtype(kind).itemsize
    return np.uint8(width).tobytes() + values.astype(kind).view(np.uint8).reshape(-1, width).T.tobytes()


def unpacked(blob: pa.Scalar) -> np.ndarray:
    data = np.frombuffer(blob.as_buffer(), np.uint8)
    return np.ascontiguousarray(data[1:].reshape(int(data[0]), -1).T).view(f"u{data[0]}").ravel().astype(np.uint64)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, as the steps between them."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(blob: pa.Scalar) -> np.ndarray:
    return np.cumsum(unpacked(blob), dtype=np.uint64)


def added(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[heads], *(np.add.reduceat(c[order], heads) if len(heads) else c[:0] for c in counts)


def cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins and ends in sorted keys."""
    return np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys))


def low(keys: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits after the bucket's."""
    return (keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)


def count_rows(df: DataFrame, text_col: str, bits: int, side: int) -> DataFrame:
    """(bucket, kind, side, keys, counts) of the words and pairs of a corpus, a row a task's share and bucket."""

    def held_rows(held: dict[int, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for kind, some in held.items():
            keys, counts = added(np.concatenate(some), np.ones(sum(map(len, some)), np.uint64))
            at = cuts(keys, bits)
            full = np.flatnonzero(np.diff(at))
            short = low(keys, bits)
            columns = [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), kind, np.int32)), pa.array(np.full(len(full), side, np.int32))]
            columns += [pa.array([pack(x[at[b] : at[b + 1]]) for b in full], pa.binary()) for x, pack in ((short, packed_keys), (counts, packed))]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "side", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = {WORDS: [], PAIRS: []}, 0
        for batch in batches:
            for _, _, words, pairs, rows in units(batch.column(0)):
                held[WORDS] += [words, np.full(len(np.unique(rows)), START)]
                held[PAIRS].append(pairs)
                n += len(words)
                if n >= HELD:
                    yield from held_rows(held)
                    held, n = {WORDS: [], PAIRS: []}, 0
        if n:
            yield from held_rows(held)

    return df.select(text_col).mapInArrow(run, "bucket int, kind int, side int, keys binary, counts binary")


def train(target: DataFrame, background: DataFrame, tables: Tables, text_col: str = "text") -> Models:
    """Count both corpora whole."""
    size = background.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = max(FEWEST_BITS, int(np.ceil(np.log2(max(1.0, size / BUCKET_BYTES)))))
    mine = low(np.array([START]), bits)[0], int(START >> np.uint64(64 - bits))

    def merge(table: pa.Table) -> pa.Table:
        sides = table["side"].to_numpy()
        keys, counts = [unpacked_keys(x) for x in table["keys"]], [unpacked(x) for x in table["counts"]]
        of = [np.concatenate([c if s == side else np.zeros(len(c), np.uint64) for c, s in zip(counts, sides, strict=True)]) for side in (0, 1)]
        keys, *both = added(np.concatenate(keys), *of)
        bucket, kind = table["bucket"][0].as_py(), table["kind"][0].as_py()
        words = (keys != mine[0]) | (bucket != mine[1]) if kind == WORDS else np.zeros(len(keys), bool)
        sums = [[int(b[words].sum()), int(b[~words].sum()) if kind == WORDS else 0] for b in both]
        made = {"bucket": [bucket], "kind": [kind], "keys": [packed_keys(keys)], "target": [packed(both[0])], "background": [packed(both[1])]}
        return pa.table(made | {"words": [int(words.sum())], "n0": [sums[0][0]], "d0": [sums[0][1]], "n1": [sums[1][0]], "d1": [sums[1][1]]}, schema=schema)

    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("target", pa.binary()), ("background", pa.binary()), *[(c, pa.int64()) for c in ("words", "n0", "d0", "n1", "d1")]])
    rows = count_rows(target, text_col, bits, 0).union(count_rows(background, text_col, bits, 1))
    ddl = "bucket int, kind int, keys binary, target binary, background binary, words long, n0 long, d0 long, n1 long, d1 long"
    counts = tables.keep(rows.groupBy("bucket", "kind").applyInArrow(merge, ddl), "counts")
    total = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "n0", "d0", "n1", "d1")]).first()
    least = (total.n0 + total.n1) // HOT_SHARE

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, kind, keys, a, b in zip(*(batch.column(c) for c in range(5)), strict=True):
                keys, a, b = unpacked_keys(keys), unpacked(a), unpacked(b)
                whole = (np.uint64(bucket.as_py()) << np.uint64(64 - bits)) | (keys << np.uint64(32 - bits))
                some = (a + b > least) | ((keys == mine[0]) & (bucket.as_py() == mine[1]) & (kind.as_py() == WORDS))
                columns = [pa.array(np.full(some.sum(), kind.as_py(), np.int32)), *[pa.array(x[some].view(np.int64)) for x in (whole, a, b)]]
                yield pa.RecordBatch.from_arrays(columns, ["kind", "key", "a", "b"])
                parts_ = -(-int(b[~some].sum()) // TASK_TOKENS)  # scored are the background's texts
                if parts_ > 1:
                    yield pa.RecordBatch.from_pydict({"kind": pa.array([-kind.as_py()], pa.int32()), "key": [bucket.as_py()], "a": [parts_], "b": [0]})

    # keys above a share of all tokens: their number is bounded by the share
    found = counts.select("bucket", "kind", "keys", "target", "background").mapInArrow(frequent, "kind int, key long, a long, b long").toArrow()
    several = found.filter(pc.less(found["kind"], 0))
    split = {(b, -k): n for b, k, n in zip(*(several[c].to_pylist() for c in ("key", "kind", "a")), strict=True)}
    found = found.filter(pc.greater(found["kind"], 0))
    kinds = found["kind"].to_numpy()
    table = np.stack([found[c].to_numpy().view(np.uint64) for c in ("key", "a", "b")]) if len(kinds) else np.zeros((3, 0), np.uint64)
    hot = {k: table[:, kinds == k][:, np.argsort(table[0, kinds == k])] for k in (WORDS, PAIRS)}
    return Models(counts.select("bucket", "kind", "keys", "target", "background"), bits, (total.n0, total.n1), (total.d0, total.d1), total.words + 1, hot, split)


def found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand in the sorted first row of ``table``, and whether they do."""
    at = np.searchsorted(table[0], keys)
    at[at == table.shape[1]] = 0
    return at, table[0][at] == keys if table.shape[1] else np.zeros(len(keys), bool)


def parts_of_loss(kind: int, count: np.ndarray, own: np.ndarray, said: np.ndarray, after: np.ndarray, vocabulary: int) -> np.ndarray:
    """What words or pairs add to a document's loss: predicted ``said`` times, the word before ``after`` times."""
    count, own, said, after = (x.astype(float) for x in (count, own, said, after))
    left = np.maximum(count - own, 0)
    if kind == PAIRS:
        loss = -said * np.log(left + MU / vocabulary)
    else:
        loss = after * np.log(left + MU) - said * np.log(left + ALPHA)
    return np.rint(loss * UNIT).astype(np.int64)


def sums_by(owner: np.ndarray, n: int, kind: int, own: np.ndarray, said: np.ndarray, after: np.ndarray, counts: tuple[np.ndarray, np.ndarray], vocabulary: int) -> list[np.ndarray]:
    """Losses by owner: the target's with and without the own counts, the background's with and without."""
    out = []
    for count in counts:
        for removed in (np.zeros_like(own), own):
            sums = np.zeros(n, np.int64)
            np.add.at(sums, owner, parts_of_loss(kind, count, removed, said, after, vocabulary))
            out.append(sums)
    return out


SUMS = ["t", "t_left", "b", "b_left"]
SENT = ["bucket", "kind", "part", "texts", "keys", "places", "owns"]
FOUND = ["key", "n", "rows", *SUMS]


def losses(docs: DataFrame, models: Models, text_col: str) -> DataFrame:
    """(key, n, rows, t, t_left, b, b_left) of each different row key: tokens, rows and sums, those times the number of rows."""
    bits, vocabulary = models.bits, models.vocabulary
    hot, split = (docs.sparkSession.sparkContext.broadcast(x) for x in (models.hot, models.split))

    def of_rows(words: np.ndarray, pairs: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, ...]]:
        """(kind, key, row, own, said, after): the words (with START) and pairs of each row, once."""
        ends = np.append(rows[1:] != rows[:-1], True)[: len(rows)]
        texts = rows[ends]
        keys = np.concatenate([words, np.full(len(texts), START)])
        owners = np.concatenate([rows, texts])
        said = np.concatenate([np.ones(len(words), np.uint64), np.zeros(len(texts), np.uint64)])
        after = np.concatenate([(~ends).astype(np.uint64), np.ones(len(texts), np.uint64)])
        for kind, k, o, s, a in ((WORDS, keys, owners, said, after), (PAIRS, pairs, rows, np.ones(len(pairs), np.uint64), np.zeros(len(pairs), np.uint64))):
            order = np.lexsort((k, o))
            k, o = k[order], o[order]
            heads = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (o[1:] != o[:-1]))[: len(k)])
            own = np.diff(np.append(heads, len(k))).astype(np.uint64)
            yield kind, k[heads], o[heads], own, *(np.add.reduceat(x[order], heads) if len(heads) else x[:0] for x in (s, a))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for first, last, words, pairs, rows in units(batch.column(1)):
                n = last - first
                local = [np.zeros(n, np.int64) for _ in SUMS]
                names = ids[first:last].view(np.uint64)
                for kind, key, row, own, said, after in of_rows(words, pairs, rows):
                    # keys are told apart by their bucket and 32 bits, here as there
                    key = key & ~np.uint64((1 << (32 - bits)) - 1)
                    at, known = found(hot.value[kind], key)
                    if known.any():
                        counts = tuple(hot.value[kind][c][at[known]] for c in (1, 2))
                        for total, x in zip(local, sums_by(row[known], n, kind, own[known], said[known], after[known], counts, vocabulary), strict=True):
                            total += x
                    key, row, own, after = (x[~known] for x in (key, row, own, after))
                    order = np.argsort(key, kind="stable")
                    key, row, own, last_word = key[order], row[order], own[order], (own != after)[order]
                    at = cuts(key, bits)
                    made = []
                    for b in np.flatnonzero(np.diff(at)):
                        some = slice(at[b], at[b + 1])
                        texts, place = np.unique(row[some], return_inverse=True)
                        blobs = [packed_keys(low(key[some], bits)), packed(place.astype(np.uint64)), packed(own[some] * np.uint64(2) + (last_word[some] if kind == WORDS else np.uint64(0)))]
                        part = int(mix(names[texts[:1]])[0] % np.uint64(split.value.get((int(b), kind), 1)))
                        made.append([int(b), kind, part, names[texts].tobytes(), *blobs])
                    yield sent_rows(made)
                # what was looked up here goes to a bucket by the row's key
                counts = np.bincount(rows, minlength=n)
                home = (names >> np.uint64(64 - bits)).astype(np.int64)
                made = []
                for b in np.unique(home):
                    some = np.flatnonzero(home == b)
                    made.append([int(b), LOCAL, 0, names[some].tobytes(), packed(counts[some].astype(np.uint64)), np.stack([x[some] for x in local]).tobytes(), b""])
                yield sent_rows(made)

    def sent_rows(made: list[list]) -> pa.RecordBatch:
        columns = list(zip(*made, strict=True)) or [()] * len(SENT)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in columns[:3]), *(pa.array(x, pa.binary()) for x in columns[3:])], SENT)

    sent = docs.select("key", text_col).mapInArrow(run, "bucket int, kind int, part int, texts binary, keys binary, places binary, owns binary")

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], pa.int64()) for _ in FOUND], names=FOUND)
        kind = left["kind"][0].as_py()
        if kind == LOCAL:
            who = [np.frombuffer(x.as_buffer(), np.int64) for x in left["texts"]]
            counts = np.concatenate([unpacked(x) for x in left["keys"]]).astype(np.int64)
            sums = np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(len(SUMS), -1) for x in left["places"]], axis=1)
            keys, *values = added(np.concatenate(who), counts, np.ones(len(counts), np.int64), *sums)
            return pa.table([pa.array(keys), *map(pa.array, values)], names=FOUND)
        if right.num_rows:
            keys, a, b = unpacked_keys(right["keys"][0]), unpacked(right["target"][0]), unpacked(right["background"][0])
        else:
            keys = a = b = np.zeros(0, np.uint64)
        table = np.stack([keys, a, b])
        texts, totals = [], [[] for _ in SUMS]
        for names, keys, places, owns in zip(*(left[c] for c in ("texts", "keys", "places", "owns")), strict=True):
            who = np.frombuffer(names.as_buffer(), np.int64)
            keys, places, owns = unpacked_keys(keys), unpacked(places).astype(np.int64), unpacked(owns)
            own = owns >> np.uint64(1)
            at, known = found(table, keys)
            counts = tuple(np.where(known, table[c][at], 0) if table.shape[1] else np.zeros(len(keys), np.uint64) for c in (1, 2))
            for out, x in zip(totals, sums_by(places, len(who), kind, own, own, own - (owns & np.uint64(1)), counts, vocabulary), strict=True):
                out.append(x)
            texts.append(who)
        keys, *sums = added(np.concatenate(texts), *map(np.concatenate, totals))
        zeros = pa.array(np.zeros(len(keys), np.int64))
        return pa.table([pa.array(keys), zeros, zeros, *map(pa.array, sums)], names=FOUND)

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts of each bucket, once for each of its parts."""
        for batch in batches:
            for k, (bucket, kind) in enumerate(zip(batch["bucket"].to_pylist(), batch["kind"].to_pylist(), strict=True)):
                for part in range(split.value.get((bucket, kind), 1)):
                    yield batch.slice(k, 1).append_column("part", pa.array([part], pa.int32()))

    ddl = "bucket int, kind int, keys binary, target binary, background binary, part int"
    counts = models.counts.mapInArrow(copied, ddl) if models.split else models.counts.withColumn("part", F.lit(0))
    keys = ["bucket", "kind", "part"]
    every = sent.groupBy(*keys).cogroup(counts.groupBy(*keys)).applyInArrow(look_up, ", ".join(f"{c} long" for c in FOUND))
    return every.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("n", "rows", *SUMS)])


def score_like(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) of every row; losses in nats a token.

    The target are the documents whose id is in ``target_ids``, the background all.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "lm")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("key"))
    wanted = tables.keep(target_ids.select(F.col(id_col).alias("id")).where("id is not null").distinct(), "wanted")
    chosen = spark.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("id").alias("h"))))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = present(chosen.value, batch.column(2).to_numpy().view(np.uint64))
            yield batch.select(["id", "text"]).filter(pa.array(some))

    kind = docs.schema[id_col].dataType.simpleString()
    some = rows.select("id", "text", F.xxhash64("id").alias("h")).mapInArrow(likely, f"id {kind}, text string")
    # a merge join at every size: the ids are not broadcast just because a corpus is small
    target = tables.keep(some.join(wanted.hint("merge"), "id", "left_semi").select("text"), "target")
    models = train(target, rows.select("text"), tables)
    known = tables.keep(losses(rows, models, "text"), "losses")

    own = F.col("mine").isNotNull()
    n = (F.col("n") / F.col("rows")).cast("double")
    total = lambda c: F.col(c) / F.col("rows") / F.lit(UNIT)

    def loss(plain: str, left: str, removed: F.Column, side: int) -> F.Column:
        # the sums lack what depends on a text's length: the denominator of P(w)
        sums = F.when(removed, total(left)).otherwise(total(plain))
        tokens_left = F.lit(float(models.tokens[side])) - F.when(removed, n).otherwise(0.0)
        return (sums + n * F.log(tokens_left + F.lit(ALPHA * models.vocabulary))) / (2 * n)

    scored = rows.select("id", "key").join(known, "key").join(wanted.withColumn("mine", F.lit(True)).hint("merge"), "id", "left")
    some = F.col("n") > 0
    a, b = F.when(some, loss("t", "t_left", own, 0)), F.when(some, loss("b", "b_left", F.lit(True), 1))
    return scored.select(F.col("id").alias(id_col), n.cast("long").alias("n_tokens"), a.alias("target_loss"), b.alias("background_loss"), (a - b).alias("score"))
