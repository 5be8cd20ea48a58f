"""Language ID by hierarchical discrimination.

Linear support vector machines over hashed letter pairs and triples: one machine a family (one against
the rest) names the language family, then one-versus-one machines separate the languages inside it by
votes.  Texts are read whole: a document's features are the shares of all its letter pairs and triples.

The machines are fitted on a bounded sample (about PER_LANGUAGE different labelled texts a language, chosen by a
hash of the text; copies count once) by dual coordinate descent on the driver, in an order that does not depend on
how the table is split; its features are counted on the executors.  All texts are
then scored in one scan without a shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0; texts of fewer than two
bytes are judged by the machines' biases; without labelled rows everything is ``und``; rows with a null
id are predicted, never learned from; equal texts get equal answers; empty tables give no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.text import parts

PER_LANGUAGE = 1_000
DIMENSIONS = 1 << 12
SCALE, COST, EPOCHS, SLOPE = 20.0, 10.0, 12, 4.0
UNKNOWN = "und"

# Language families by ISO 639-1 code; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Machines:
    families: list[str]
    languages: dict[str, list[str]]  # of each family
    pairs: list[tuple[str, str]]
    weights: np.ndarray  # (features, families and pairs)
    bias: np.ndarray


def codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature number of the pair and of the triple of bytes that starts at each position; other bytes are a blank."""
    x = np.where(LETTER[data], data, 0x20).astype(np.uint32)
    pair = x[:-1] * np.uint32(257) + x[1:] if len(x) > 1 else x[:0]
    triple = pair[:-1] * np.uint32(257) + x[2:] if len(x) > 2 else x[:0]
    bits = np.uint32(32 - 12)
    return tuple(((c * np.uint32(2654435761) + np.uint32(s)) >> bits).astype(np.int32) for c, s in ((pair, 0x3C6EF372), (triple, 0x1B873593)))


def windows(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's first and last window of n bytes (half-open)."""
    return offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - n + 1)


def features(docs: DataFrame, label: str, text_col: str) -> DataFrame:
    """(label, feature numbers, shares) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, numbers, shares = [], [], []
            for first, last, data, offsets in parts(pc.utf8_lower(batch.column(1).cast(pa.large_string()))):
                found = codes(data)
                for r in range(last - first):
                    total = np.zeros(DIMENSIONS)
                    for n, x in zip((2, 3), found, strict=True):
                        a, b = (w[r] for w in windows(offsets, n))
                        if b > a:
                            total += np.bincount(x[a:b], minlength=DIMENSIONS) / (b - a)
                    at = np.flatnonzero(total)
                    numbers.append(at.astype(np.int32))
                    shares.append(total[at].astype(np.float32))
                names.append(batch.column(0).slice(first, last - first))
            if names:
                ends = np.cumsum([0, *map(len, numbers)], dtype=np.int32)
                columns = [pa.concat_arrays(names), *(pa.ListArray.from_arrays(ends, np.concatenate(x)) for x in (numbers, shares))]
                yield pa.RecordBatch.from_arrays(columns, ["label", "at", "share"])

    return docs.select(label, text_col).mapInArrow(run, "label string, at array<int>, share array<float>")


def machine(x: np.ndarray, y: np.ndarray, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss, by dual coordinate descent; classes weigh alike."""
    rng = np.random.default_rng(seed)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    cost = np.where(y > 0, COST * len(y) / (2 * max(1, (y > 0).sum())), COST * len(y) / (2 * max(1, (y < 0).sum())))
    diagonal = (x * x).sum(1) + 0.5 / cost
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            slope = y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost[i]
            if alpha[i] > 0 or slope < 0:
                new = max(alpha[i] - slope / diagonal[i], 0.0)
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w[:-1], float(w[-1])


def train(docs: DataFrame, label: str = "lang", text_col: str = "text", per_language: int = PER_LANGUAGE) -> Machines | None:
    """Fit the machines on about ``per_language`` different texts of each language."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label).cast("string").alias("__label"), text_col)
    texts = F.approx_count_distinct(F.xxhash64(text_col)).alias("count")
    counts = {r["__label"]: r["count"] for r in rows.groupBy("__label").agg(texts).collect()}  # one row a language
    if not counts:
        return None
    share = F.create_map(*[v for k, n in counts.items() for v in (F.lit(k), F.lit(min(1.0, per_language / n)))])[F.col("__label")]
    drawn = F.pmod(F.xxhash64(text_col), F.lit(1 << 48)) / float(1 << 48)
    # copies count once, or a text that makes up much of the table would come to the driver as often
    sample = features(rows.where(drawn < share).distinct(), "__label", text_col).toArrow()
    if not len(sample):
        return None
    keys = [(x.as_py(), *(y.values.to_numpy().tobytes() for y in z)) for x, *z in zip(*(sample[c] for c in ("label", "at", "share")), strict=True)]
    sample = sample.take(pa.array(sorted(range(len(keys)), key=keys.__getitem__), pa.int64()))
    names = np.array(sample["label"].to_pylist())
    x = np.zeros((len(names), DIMENSIONS), np.float32)
    for r, (at, shares) in enumerate(zip(sample["at"], sample["share"], strict=True)):
        x[r, at.values.to_numpy()] = SCALE * shares.values.to_numpy()
    family = np.array([FAMILY_OF.get(n, n) for n in names])
    families = sorted(set(family))
    languages = {f: sorted(set(names[family == f])) for f in families}
    fitted, pairs = [], []
    for f in families:
        fitted.append(machine(x, np.where(family == f, 1.0, -1.0)))
    for f in families:
        for a, b in combinations(languages[f], 2):
            some = (names == a) | (names == b)
            fitted.append(machine(x[some], np.where(names[some] == a, 1.0, -1.0)))
            pairs.append((a, b))
    weights = SCALE * np.stack([w for w, _ in fitted], 1)
    return Machines(families, languages, pairs, weights.astype(np.float32), np.array([b for _, b in fitted]))


def margins(m: Machines, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The margin of every machine for every row."""
    out = np.tile(m.bias, (len(offsets) - 1, 1))
    for n, x in zip((2, 3), codes(data), strict=True):
        a, b = windows(offsets, n)
        some = np.flatnonzero(b > a)
        if len(some):
            cuts = np.empty(2 * len(some), np.int64)
            cuts[::2], cuts[1::2] = a[some], b[some]
            for k in range(m.weights.shape[1]):
                held = np.append(m.weights[:, k][x].astype(np.float64), 0.0)
                out[some, k] += np.add.reduceat(held, np.minimum(cuts, len(held) - 1))[::2] / (b - a)[some]
    return out


def decide(m: Machines, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language of each row of margins and its score: the family's share times the mean won duel."""
    width = len(m.families)
    power = np.exp(np.clip(SLOPE * margin[:, :width], -50, 50))
    share = power / power.sum(1, keepdims=True)
    best = margin[:, :width].argmax(1)
    names, scores = np.empty(len(margin), object), share[np.arange(len(margin)), best]
    for k, f in enumerate(m.families):
        rows = np.flatnonzero(best == k)
        own = m.languages[f]
        if len(own) == 1:
            names[rows] = own[0]
            continue
        votes, belief = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
        for j, (a, b) in enumerate(m.pairs):
            if a in own:
                won = 1 / (1 + np.exp(np.clip(-SLOPE * margin[rows, width + j], -50, 50)))
                for name, p in ((a, won), (b, 1 - won)):
                    votes[:, own.index(name)] += p >= 0.5
                    belief[:, own.index(name)] += p
        belief /= len(own) - 1
        chosen = (votes + belief / 2).argmax(1)
        names[rows] = np.array(own, object)[chosen]
        scores[rows] *= belief[np.arange(len(rows)), chosen]
    return names, np.clip(scores, 0, 1)


def predict(docs: DataFrame, machines: Machines | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(machines)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for first, last, data, offsets in parts(pc.utf8_lower(batch.column(1).cast(pa.large_string()))):
                rows = last - first
                ascii_letters = np.append(0, np.cumsum(LETTER[data] & (data < 128)))
                known = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
                for r in np.flatnonzero(~known & (offsets[1:] > offsets[:-1])):
                    known[r] = any(c.isalpha() for c in data[offsets[r] : offsets[r + 1]].tobytes().decode())
                if m is None:
                    names, scores = np.full(rows, UNKNOWN, object), np.zeros(rows)
                else:
                    names, scores = decide(m, margins(m, data, offsets))
                    names[~known], scores[~known] = UNKNOWN, 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, rows), pa.array(names, pa.string()), pa.array(scores)], [id_col, "lang_pred", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def fold(key: Column) -> Column:
    """crc32 of the key as text, modulo 3; fold 1 is held out."""
    return F.crc32(key.cast("string").cast("binary")) % 3


def held_out_predictions(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Learn from the folds other than 1 and predict every document."""
    machines = train(docs.where(fold(F.col(id_col)) != 1))
    held_out = F.coalesce(fold(F.col(id_col)) == 1, F.lit(False))
    return predict(docs, machines, id_col).select(id_col, held_out.alias("held_out"), "lang_pred", "score")
