"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text is a sequence of words: runs of letters and digits (any byte above 127
counts as a letter), and runs of other marks.  A word equal to the one before
it is a ditto, one and the same word whatever is repeated.  Words and pairs of
neighbouring words, lower case, are hashed to ``2 ** BITS`` places; the value
of a place is log(1 + count), and a text's values have length one.

Training (McMahan's FTRL-proximal): per-place sums ``z`` and ``n`` give each
weight in closed form, with an L1 part that leaves most of them zero.  It reads
a bounded sample: of each label at most ``SAMPLE_ROWS`` different texts, whole
texts, by order of a hash; a label's examples weigh as much as all its rows do.
The sample's sparse vectors stream through one task, ``EPOCHS`` times, sorted by
a hash, so that task holds the model and one batch.

Scoring is a sparse dot product a row, where Spark reads it.  The weights have
``2 ** BITS + 1`` numbers whatever the input; that is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_chunks, split_join, text_buffer, with_rows

BITS = 18
SIZE = 1 << BITS
#: Different texts of each label that training reads.
SAMPLE_ROWS = 4000
EPOCHS = 3
# Rates of the updates.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.05, 0.1
#: Rows whose id has this remainder are held out.
FOLDS, HELD_OUT = 3, 1

_STEP, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_DITTO = np.uint64(0x51ED270B)
_CHUNK = 1 << 20

_KIND = np.full(256, 2, np.uint8)  # 1: letter or digit, 2: mark, 0: between words
_KIND[:33] = 0
_KIND[127] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)


def _word_hashes(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A polynomial hash of each word's lower-case bytes."""
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    inside = np.arange(int(size.sum())) - np.repeat(first, size)
    powers = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(int(size.max()), _STEP))))
    return np.add.reduceat(_LOWER[raw[np.repeat(start, size) + inside]] * powers[inside], first)


def vectors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors of texts: the n + 1 places where each begins, hash places, values."""
    n = len(offsets) - 1
    none = np.zeros(n + 1, np.int64), np.empty(0, np.int64), np.empty(0)
    if not len(raw):
        return none
    kind = _KIND[raw]
    edge = np.ones(len(raw), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < len(raw)]] = True
    start = np.flatnonzero(edge)
    size = np.diff(np.append(start, len(raw)))
    word = kind[start] > 0
    start, size = start[word], size[word]
    if not len(start):
        return none
    doc = np.searchsorted(offsets, start, side="right") - 1
    h = _word_hashes(raw, start, size)
    near = doc[1:] == doc[:-1]
    same = np.concatenate(([False], (h[1:] == h[:-1]) & near))
    h[same] = _DITTO
    pairs = np.flatnonzero(near)
    grams = np.concatenate((h * _MIX, (h[pairs] * _STEP + h[pairs + 1]) * _MIX)) >> np.uint64(64 - BITS)
    at, count = np.unique(np.concatenate((doc, doc[pairs])) << BITS | grams.astype(np.int64), return_counts=True)
    doc, place = at >> BITS, at & SIZE - 1
    begin = np.searchsorted(doc, np.arange(n + 1))
    value = np.log1p(count)
    length = np.sqrt(np.bincount(doc, value * value, n))
    return begin, place, value / length[doc]


class Learner:
    """State of the updates; the last place is the intercept, whose value is always one."""

    def __init__(self):
        self.z, self.n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def update(self, place: np.ndarray, value: np.ndarray, label: int, weight: float) -> None:
        at, x = np.append(place, SIZE), np.append(value, 1.0)
        w = self.weights(at)
        g = weight * (probability(float(w @ x)) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def probability(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of its id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(label, key, text, weight): at most ``rows`` different texts of each label, whatever the copies.

    Ids first, then texts: the two picks are bounded and broadcast, so no text
    but the picked ones moves.  ``weight`` is a label's share of all labelled
    rows over its share of the sample.
    """
    known = labels.select("doc_id", F.col("quality").cast("int").alias("label")) \
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).distinct()
    known = split_join(known, docs.select("doc_id").distinct(), ["doc_id"], "left_semi")
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}

    def first(frame: DataFrame, key: str) -> DataFrame:
        zero, one = [frame.filter(F.col("label") == c).orderBy(key).limit(rows) for c in (0, 1)]
        return zero.unionByName(one)

    # more ids than texts, as copies fall together
    ids = first(known.withColumn("order", F.xxhash64("doc_id")), "order").drop("order")
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(
        "label", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    keys = first(found.select("label", "key").distinct(), "key").persist()
    try:
        kept = {r["label"]: r["n"] for r in keys.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        total, used = sum(counts.get(c, 0) for c in kept), sum(kept.values())
        picked = keys.sparkSession.createDataFrame([(int(r["label"]), int(r["key"])) for r in keys.collect()], "label int, key long")
    finally:
        keys.unpersist()
    weight = F.lit(None).cast("double")
    for c, n in kept.items():
        weight = F.when(F.col("label") == c, F.lit(counts[c] / total / (n / used))).otherwise(weight)
    return found.join(F.broadcast(picked), ["label", "key"]).groupBy("label", "key").agg(F.first("text").alias("text")) \
        .withColumn("weight", weight)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """The ``SIZE + 1`` weights; all zero if no row is labelled."""

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for i, j in row_chunks(offsets, _CHUNK):
                begin, place, value = vectors(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                cut = pa.array(begin.astype(np.int32))
                yield batch, i, j, [pa.ListArray.from_arrays(cut, pa.array(place.astype(np.int32))),
                                    pa.ListArray.from_arrays(cut, pa.array(value))]

    got = with_rows(sample(docs, labels, rows), "text", sparse, "place array<int>, value array<double>")
    rounds = got.select("payload.label", "payload.key", "payload.weight", "place", "value") \
        .withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))) \
        .withColumn("turn", F.xxhash64("key", "epoch"))
    # the sample is bounded: one task may read it in order; the sort spills
    ordered = rounds.repartition(1).sortWithinPartitions("epoch", "turn", "label").select("label", "weight", "place", "value")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner()
        for batch in batches:
            place, value = batch.column(2), batch.column(3)
            p, v = place.values.to_numpy(), value.values.to_numpy()
            cut_p, cut_v = place.offsets.to_pylist(), value.offsets.to_pylist()
            for k, (y, w) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                learner.update(p[cut_p[k]:cut_p[k + 1]], v[cut_v[k]:cut_v[k + 1]], y, w)
        yield pa.RecordBatch.from_arrays([pa.array([learner.weights().astype("<f4").tobytes()], pa.binary())], names=["weights"])

    made = ordered.mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(made[0]["weights"], "<f4").astype(np.float64) if made else np.zeros(SIZE + 1)


def scores(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Probability of label 1 of each text: the sparse dot product with the weights."""
    begin, place, value = vectors(raw, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(begin))
    return probability(np.bincount(doc, weights[place] * value, len(offsets) - 1) + weights[SIZE])


def score(docs: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """Every row of ``docs`` (struct ``payload``: all columns but the text) with ``score``, 0 to 1.

    Only the text is an input.  A null, empty or blank text has the score of the intercept; repeated rows score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for i, j in row_chunks(offsets, _CHUNK):
                got = scores(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], shared.value)
                yield batch, i, j, [pa.array(got, pa.float64())]

    return with_rows(docs, text, run, "score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 if the score is 0.5 or more).

    Trains on ``labels.quality`` of rows that are not held out; null labels
    and others than 0 and 1 teach nothing, and an id with both labels teaches both.
    """
    got = score(docs.select("doc_id", "text"), train(docs, labels))
    rows = got.select(F.col("payload.doc_id").alias("doc_id"), "score")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
