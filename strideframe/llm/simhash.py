"""SimHash near-duplicates found by fuzzy hashing with a Golay code.

Fingerprints are cut into three segments of at most 23 bits.  The binary Golay
code (23 bits, 12 of them information, perfect for three errors) gives a
segment the indices of all codewords within four bits of it: one or six.  Two
segments at most two bits apart always share an index (tests check all cases).
When at most four bits differ in all, the two best segments together hold at
most two of them, so for one of the three pairs of segments both segments
share an index.  Every fingerprint therefore gets a key for each pair of
segments and each pair of their indices; fingerprints that share a key meet in
one bucket, where their distance is verified.

A bucket holds distinct fingerprints only.  Buckets that a sample shows to be
large are cut into blocks, and each pair of blocks is a bucket of its own.  A
partition returns a spanning forest of the links it verified, never all
pairs, and the forests are joined by ``components``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint
from .common import drain, partitions, row_key, split_join, text_buffer
from .components import components

# Words of a shingle, seed of its hash, greatest distance of a link.
SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: Generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
#: First bit and length of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: A bucket with more than this share of all fingerprints' keys is cut into blocks.
HOT_SHARE = 1 / 1000
#: One of so many fingerprints is sampled to find such buckets.
SAMPLE = 16
#: Fingerprints in a block of a hot bucket.
BLOCK = 4096


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64 bits; each is 1 if it is set in more than half of the shingles' hashes."""
    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = [0, *ends[:-1].tolist()]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    if len(parts) <= words:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(view[s:e], SEED) for s, e in zip(starts, (ends[words - 1:] - 1).tolist())]
    h = np.array(hashes, "<u8")
    n_set = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        n_set += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * n_set > len(h)).tolist())


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, rk (hash of id and text) and fp (signed 64 bits) of every row; a null text has no words, so 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(2))
            data, cut = raw.tobytes(), off.tolist()
            fps = [fingerprint(data[s:e], words) for s, e in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "rk", "fp"])

    rows = docs.select("doc_id", row_key("doc_id", "text").alias("rk"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, rk long, fp long")


def syndrome(word: int) -> int:
    """Remainder of the 23 bits by the generator; 0 for a codeword."""
    for i in range(22, 10, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - 11)
    return word


def _near() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 2 ** 23 words' halves, and for each syndrome the up to six error patterns of at most four bits."""
    errors: dict[int, list[int]] = {}
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << i for i in bits)
            errors.setdefault(syndrome(e), []).append(e)
    table = np.full((2048, 6), -1, np.int32)
    for s, patterns in errors.items():
        table[s, :len(patterns)] = patterns
    upper = np.array([syndrome(i << 11) for i in range(4096)], np.int32)
    return upper, table


_TABLES: list = []


def indices(segment: np.ndarray) -> np.ndarray:
    """The 12-bit indices of the codewords within four bits of each segment; -1 fills up to six."""
    if not _TABLES:
        _TABLES.extend(_near())
    upper, table = _TABLES
    errors = table[upper[segment >> 11] ^ (segment & 2047)]
    return np.where(errors >= 0, (segment[:, None] ^ errors) >> 11, -1)


def bucket_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint; at most 108 each."""
    of = [indices(((fp >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int32)) for at, n in SEGMENTS]
    rows, keys = [], []
    for k, (i, j) in enumerate(combinations(range(3), 2)):
        both = (of[i][:, :, None] << 12 | of[j][:, None, :]) | k << 24
        good = (of[i] >= 0)[:, :, None] & (of[j] >= 0)[:, None, :]
        rows.append(np.nonzero(good)[0])
        keys.append(both[good])
    return np.concatenate(rows), np.concatenate(keys).astype(np.int32)


def forest(bucket: np.ndarray, fp: np.ndarray, bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (node, root) between fingerprints of equal buckets at most ``bits`` apart."""
    order = np.lexsort((fp, bucket))
    bucket, fp = bucket[order], fp[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[first, len(bucket)])
    a, b = [], []
    for s in range(1, min(33, int(size.max(initial=1)))):
        # rows s apart in one bucket, for all buckets of up to 32 rows at once
        start = first[(size > s) & (size <= 32)]
        room = size[(size > s) & (size <= 32)] - s
        at = np.repeat(start, room) + np.arange(room.sum()) - np.repeat(np.cumsum(room) - room, room)
        near = np.bitwise_count(fp[at] ^ fp[at + s]) <= bits
        a.append(fp[at[near]])
        b.append(fp[at[near] + s])
    for start, n in zip(first[size > 32].tolist(), size[size > 32].tolist()):
        # breadth first, each row found once: a dense bucket takes few passes over what is left
        left = np.unique(fp[start:start + n])
        while len(left):
            queue, left = [left[0]], left[1:]
            while queue and len(left):
                x = queue.pop()
                near = np.bitwise_count(left ^ x) <= bits
                if near.any():
                    found = left[near]
                    a.append(found)
                    b.append(np.full(len(found), x))
                    queue.extend(found.tolist())
                    left = left[~near]
    if not a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.concatenate(a).astype(np.uint64), np.concatenate(b).astype(np.uint64)
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        was = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (was == root).all():
            break
    linked = root != np.arange(len(nodes))
    return nodes[linked], nodes[root[linked]]


def links(fps: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """``fps`` (fp, distinct) -> links (a, b) that connect all fingerprints at most ``bits`` (up to 4) apart."""
    if not 0 <= bits <= MAX_BITS:
        raise ValueError("the segments are made for up to four bits")
    spark, n = fps.sparkSession, partitions(fps)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(fp), 10_000):
                part = fp[i:i + 10_000]
                rows, keys = bucket_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows].view(np.int64))], names=["bucket", "fp"])

    # hot buckets: at most keys a fingerprint / HOT_SHARE of them, as their sampled sizes add up to the sample's keys
    sample = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0)
    n_sample = sample.count()
    floor = max(BLOCK / SAMPLE, HOT_SHARE * n_sample)
    hot = dict(sample.mapInArrow(keyed, "bucket int, fp long").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
               .filter(F.col("n") > floor).toArrow().to_pandas().itertuples(index=False, name=None)) if n_sample > floor else {}
    blocks = spark.sparkContext.broadcast({int(k): int(-(-v * SAMPLE // BLOCK)) for k, v in hot.items()})

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = blocks.value
        hot_keys = np.array(sorted(cut), np.int32)
        for batch in keyed(batches):
            key, fp = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()
            if not len(hot_keys):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], names=["bucket", "fp"])
                continue
            is_hot = np.isin(key, hot_keys)
            yield pa.RecordBatch.from_arrays([pa.array(key[~is_hot]), pa.array(fp[~is_hot])], names=["bucket", "fp"])
            out_k, out_f = [], []
            for k in np.unique(key[is_hot]).tolist():
                mine, m = fp[key == k], cut[k]
                own = (mine.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % m
                for other in range(m):
                    pair = np.minimum(own, other) * m + np.maximum(own, other)
                    out_k.append((pair + 1) << 32 | k)
                    out_f.append(mine)
            if out_k:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_k)), pa.array(np.concatenate(out_f))], names=["bucket", "fp"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = drain(batches)
        if table is not None:
            a, b = forest(table.column("bucket").to_numpy(), table.column("fp").to_numpy().view(np.uint64), bits)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return fps.mapInArrow(placed, "bucket long, fp long").repartition(n, "bucket").mapInArrow(verified, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``docs``: doc_id, rk, fp, fingerprint (hex) and component_id.

    Rows whose fingerprints are linked by steps of at most ``bits`` differing
    bits form a component, named by its smallest doc_id (null if all are
    null).  Texts without words, null ones included, have fingerprint zero and
    are linked like any other.  Repeated rows are rows of their own.
    """
    prints = checkpoint(fingerprints(docs, words))
    # a fingerprint has up to 108 keys: as many partitions as for them, not as few as its eight bytes need
    fps = prints.select("fp").distinct().repartition(partitions(docs), "fp")
    roots = components(links(fps, bits)).select(F.col("node").alias("fp"), F.col("root"))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = split_join(rooted.select("fp", "root"), rooted.groupBy("root").agg(F.min("least").alias("component_id")), ["root"])
    out = split_join(prints, named.select("fp", "root", "component_id"), ["fp"])
    return out.select("doc_id", "rk", "fp", "root", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, words: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest doc_id (nulls last), ties by a hash of id and text."""
    groups = near_duplicates(docs, words, bits)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rk"))).alias("best"),
                                      F.count(F.lit(1)).alias("n"))
    keep = best.select(F.col("best.rk").alias("__rk"), "n")
    held = docs.select(F.struct("*").alias("row"), row_key("doc_id", "text").alias("__rk")).join(keep, "__rk")
    # a row repeated with id and text stays once
    alone = held.filter(F.col("n") == 1).select("row.*")
    again = held.filter(F.col("n") > 1).dropDuplicates(["__rk"]).select("row.*")
    return alone.unionByName(again)
