"""Repeated 200-byte strings by a distributed merge sort of suffixes.

A window is a string of ``length`` bytes inside one document.  A window that
starts anywhere else too, in the same document or another, is repeated, and
the bytes it covers are removed.

1. *Anchors.*  Every window holds many grams of ``gram`` bytes; the one with the
   smallest hash (leftmost on ties) is its anchor, so equal windows have their
   anchors at the same place.  Windows that follow each other mostly share an
   anchor; together they are its context.  A window can only be repeated if its
   anchor's gram is, so Spark counts the anchors' grams and keeps those that
   occur twice or more (about one in seventy bytes is an anchor).
2. *Sorted runs.*  Each task sorts the suffixes that start at its kept anchors
   (up to the end of the context) and writes them front-coded: the length of
   the prefix shared with the suffix before, and the rest.  Equal contexts of a
   task are one entry.  Runs are cut by the anchor's gram, so suffixes that can
   match meet in one part.
3. *Merge.*  The runs of a part are merged by a loser tree whose nodes keep the
   length of the prefix shared with the last suffix put out; a known prefix is
   never compared again, two suffixes whose known lengths differ are not
   compared at all.  Suffixes that share a gram come out together, and the
   windows of their contexts are compared as strings.
4. *Cut.*  The repeated spans join the documents again.

A gram that occurs more than ``SPREAD`` times (long runs of copies, passages
that a share of all documents hold) would make one part large.  Its contexts go
through the merge sort twice: first as whole strings, dealt out by the whole
string, so that equal contexts meet and each different one is left once; then
the windows of the different ones, dealt out by the window.  A task hands on a
string once however often it met it: if twice or more, it puts out the spans at
once and marks the string.  So no part grows with the number of copies, rows
grow with different contexts and not with tasks times windows, and all strings
are compared in full.  ``SPREAD`` decides the way, never the result.

The text crosses the network once: all steps read the same exchange.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, row_chunks, split_join, text_buffer

LENGTH = 200
GRAM = 64
#: Occurrences of an anchor's gram beyond which its contexts are spread over the parts.
SPREAD = 512
#: Bytes of contexts or windows, with what Python adds to each, that a task holds before it hands on its runs.
HELD_BYTES = 64 << 20
#: Entries of a run whose lengths are Python numbers at one time.
ENTRIES_AT_ONCE = 1024
#: Spans in one packed row.
SPANS_PER_ROW = 1 << 16
#: Parts of the merge for each partition; a part is merged on its own.
PARTS_PER_PARTITION = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MULT = tuple(np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MULT[salt % 4]
        return x ^ (x >> np.uint64(29))


def gram_hashes(raw: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """64-bit hashes of all strings of ``size`` bytes, by doubling: a string is its two halves."""
    h, n = _mix(raw.astype(np.uint64) * _ODD + np.uint64(salt + 1), salt), 1
    while n < size:
        step = min(n, size - n)
        h = _mix(h[:-step] * _MULT[(salt + 1) % 4] + h[step:], salt + n % 3)
        n += step
    return h


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, anchor, first window, last window, gram hash) of every context; places count from the row's start."""
    none = tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    if len(raw) < length:
        return none
    h = gram_hashes(raw, gram)
    place = np.uint64((1 << 24) - 1)
    low = (h & ~place) | (np.arange(len(h), dtype=np.uint64) & place)
    width, n = length - gram + 1, 1
    while n < width:
        step = min(n, width - n)
        low = np.minimum(low[:-step], low[step:])
        n += step
    # low[p]: the smallest of the grams of window p
    starts = np.arange(len(low))
    row = np.searchsorted(offsets, starts, side="right") - 1
    at = starts + ((low & place).astype(np.int64) - (starts & int(place))) % (1 << 24)
    inside = starts + length <= offsets[row + 1]
    starts, row, at = starts[inside], row[inside], at[inside]
    if not len(starts):
        return none
    new = np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])]
    first = np.flatnonzero(new)
    final = np.r_[first[1:], len(starts)] - 1
    base = offsets[row[first]]
    return row[first], at[first] - base, starts[first] - base, starts[final] - base, h[at[first]]


def _chunked(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    raw, offsets = text_buffer(batch.column(column))
    for i, j in row_chunks(offsets, 1 << 20):
        part = offsets[i:j + 1]
        yield i, raw[part[0]:part[-1]], part - part[0]


def pack(at: np.ndarray, first: np.ndarray, final: np.ndarray) -> np.ndarray:
    """An anchor's place with the distances to its first and last window, in one long."""
    return at << 24 | (at - first) << 12 | (at - final)


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix; the first ``known`` bytes are known to be equal and not read."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    low, step = known, 16
    while a[low:low + step] == b[low:low + step]:
        low += step
        step *= 2
    high = min(most, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class LoserTree:
    """Merges sorted runs of (shared prefix with the entry before, string, value).

    Every run's head carries the length of the prefix it shares with the last
    string put out.  Of two heads the one that shares more is smaller; only if
    both share the same is a byte compared, from there on.
    """

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.heads: list = [next(r, None) for r in self.runs]
        size = 1
        while size < len(runs):
            size *= 2
        self.size = size
        self.heads += [None] * (size - len(runs))
        self.shared = [0] * size
        self.loser = [0] * size
        self.winner = self._play(1) if runs else -1

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        a, b = self._play(2 * node), self._play(2 * node + 1)
        return self._match(node, a, b)

    def _match(self, node: int, a: int, b: int) -> int:
        heads, shared = self.heads, self.shared
        if heads[a] is None or heads[b] is None:
            win, lose = (b, a) if heads[a] is None else (a, b)
        elif shared[a] != shared[b]:
            # the loser differs from the winner where it differs from the last string
            win, lose = (a, b) if shared[a] > shared[b] else (b, a)
        else:
            x, y = heads[a][1], heads[b][1]
            n = shared_prefix(x, y, shared[a])
            if n == len(x) or n < len(y) and x[n] < y[n]:
                win, lose = a, b
            else:
                win, lose = b, a
            shared[lose] = n
        self.loser[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        """(prefix shared with the string before, string, value) in order."""
        while self.winner >= 0 and self.heads[self.winner] is not None:
            at = self.winner
            _, string, value = self.heads[at]
            yield self.shared[at], string, value
            self.heads[at] = head = next(self.runs[at], None)
            if head is not None:
                self.shared[at] = head[0]
            node, win = (at + self.size) // 2, at
            while node:
                win = self._match(node, win, self.loser[node])
                node //= 2
            self.winner = win


def front_code(entries: list[tuple[bytes, bytes, list[tuple[int, int]]]]) -> bytes:
    """A sorted run of (suffix, bytes left of it, occurrences) as bytes."""
    shared, rest, left, many, where = [], [], [], [], []
    before = b""
    for suffix, prefix, found in entries:
        n = shared_prefix(suffix, before, 0)
        shared.append(n)
        rest.append(suffix[n:])
        left.append(prefix)
        many.append(len(found))
        where.extend(found)
        before = suffix
    head = np.array([shared, list(map(len, rest)), list(map(len, left)), many], "<u4")
    places = np.array(where, "<i8").reshape(-1, 2)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([
        np.array([len(entries), len(where)], "<u4").tobytes(), head.tobytes(), places.tobytes(), *rest, *left]))


def read_run(block: bytes) -> Iterator[tuple[int, bytes, tuple[bytes, list]]]:
    """The entries of a front-coded run: (shared prefix, suffix, (bytes left of it, occurrences))."""
    data = zstandard.ZstdDecompressor().decompress(block)
    n, m = np.frombuffer(data, "<u4", 2).tolist()
    head = np.frombuffer(data, "<u4", 4 * n, 8).reshape(4, n)
    at = 8 + 16 * n
    places = np.frombuffer(data, "<i8", 2 * m, at).reshape(m, 2)
    at += 16 * m
    at_left = at + int(head[1].sum())
    suffix, k = b"", 0
    for i in range(0, n, ENTRIES_AT_ONCE):
        for s, r, lf, c in zip(*head[:, i:i + ENTRIES_AT_ONCE].tolist()):
            suffix = suffix[:s] + data[at:at + r]
            at += r
            yield s, suffix, (data[at_left:at_left + lf], places[k:k + c].tolist())
            at_left += lf
            k += c


def repeated_spans(group: dict[bytes, list], length: int) -> Iterator[tuple[int, int, int]]:
    """(row key, start, end) of the repeated windows of contexts that share a gram.

    ``group``: context -> [(row key, place of its first byte)].  Contexts that
    are alone are compared window by window with the others, as strings.
    """
    if len(group) == 1:
        (context, found), = group.items()
        if len(found) > 1:
            for key, at in found:
                yield key, at, at + len(context)
        return
    seen: dict[bytes, int] = defaultdict(int)
    for context, found in group.items():
        for p in range(len(context) - length + 1):
            seen[context[p:p + length]] += len(found)
    for context, found in group.items():
        if len(found) > 1:
            for key, at in found:
                yield key, at, at + len(context)
            continue
        (key, at), = found
        start = end = -1
        for p in range(len(context) - length + 1):
            if seen[context[p:p + length]] > 1:
                if p > end:
                    if end >= 0:
                        yield key, at + start, at + end
                    start = p
                end = p + length
        if end >= 0:
            yield key, at + start, at + end


def united(found: np.ndarray) -> np.ndarray:
    """(row key, start, stop) rows, those of a row key that overlap or touch made one."""
    if not len(found):
        return found
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    rank = np.cumsum(np.r_[False, found[1:, 0] != found[:-1, 0]]) << 40  # keeps the keys' spans apart
    start, stop = found[:, 1] + rank, np.maximum.accumulate(found[:, 2] + rank)
    first = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]])
    last = np.r_[first[1:], len(found)] - 1
    return np.column_stack([found[first, 0], found[first, 1], stop[last] - rank[last]])


def different(blocks: list[bytes], sure: array) -> Iterator[tuple[bytes, int, int]]:
    """(string, row key, place) once for every different string of sorted runs, in order.

    The place is -1 where the string was met twice or more; the spans of those
    occurrences are added to ``sure``.
    """
    held, key, place = None, 0, 0
    for shared, string, (_, ((k, p),)) in LoserTree([read_run(b) for b in blocks]):
        if held is not None and shared == len(string) == len(held):
            _meet(sure, len(string), key, place, k, p)
            place = -1
            continue
        if held is not None:
            yield held, key, place
        held, key, place = string, k, p
    if held is not None:
        yield held, key, place


def _meet(sure: array, size: int, *occurrences: int) -> None:
    """The spans of occurrences (row key, place, ...) of one string, but for those put out before (place -1)."""
    for key, place in zip(occurrences[::2], occurrences[1::2]):
        if place >= 0:
            sure.extend((key, place, place + size))


def _part_of(string: bytes, parts: int) -> int:
    return int.from_bytes(hashlib.blake2b(string, digest_size=4).digest(), "little") % parts


def _dealt(docs: DataFrame) -> DataFrame:
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("payload"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("rk", F.xxhash64(F.coalesce(F.col("payload.doc_id").cast("string"), F.lit("\u0000")), F.coalesce("text", F.lit(""))))
    return rows.repartition(partitions(docs), "rk")


def spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, spread: int = SPREAD) -> DataFrame:
    """``rows`` (payload, text, rk; dealt out by rk) -> (rk, start, stop) byte spans that repeated windows cover.

    Rows with equal ``rk`` are equal.  Spans may overlap.
    """
    n_tasks = partitions(rows)
    n_parts = n_tasks * PARTS_PER_PARTITION

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(raw, off, length, gram)[4] for _, raw, off in _chunked(batch, 1)]
            h, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(2).to_numpy()
            for i, raw, off in _chunked(batch, 1):
                row, at, first, final, h = anchors(raw, off, length, gram)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(keys[i + row]),
                                                  pa.array(pack(at, first, final))], names=["h", "rk", "at"])

    repeated = rows.mapInArrow(counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")) \
        .filter(F.col("n") > 1).select("h", (F.col("n") > spread).alias("spread"))
    kept = split_join(rows.mapInArrow(placed, "h long, rk long, at long"), repeated, ["h"])
    per_row = kept.select("rk", F.when(F.col("spread"), -F.col("at") - 1).otherwise(F.col("at")).alias("at")) \
        .groupBy("rk").agg(F.collect_set("at").alias("at"))
    texts = rows.join(per_row, "rk").select("payload", "text", "rk", "at")

    # Rows between the steps are (part, run).  Parts below n_parts: runs cut by the gram (first merge) or, into
    # n_tasks parts, by the window (second); from n_parts: runs of whole contexts; from 2 * n_parts: packed spans.
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_gram: dict[tuple[bytes, int], list] = {}
        whole: dict[bytes, tuple[int, int]] = {}
        sure = array("q")
        size = 0
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            keys, lists = batch.column(2).to_numpy(), batch.column(3)
            # equal rows are told apart by their number, so that copies with one id count as two
            for r in range(batch.num_rows):
                data, key = raw[off[r]:off[r + 1]].tobytes(), int(keys[r])
                for code in lists[r].values.to_pylist():
                    apart = code < 0
                    code = -code - 1 if apart else code
                    at = code >> 24
                    first, stop = at - (code >> 12 & 4095), at - (code & 4095) + length
                    context = data[first:stop]
                    if not apart:
                        found = by_gram.setdefault((context, at - first), [])
                        size += 130 if found else 800
                        found.append((key, first))
                    elif context not in whole:
                        whole[context] = key, first
                        size += 700
                    else:
                        _meet(sure, stop - first, *whole[context], key, first)
                        whole[context] = key, -1
                        size += 48
                if size > HELD_BYTES:
                    yield from emit(by_gram, whole, sure)
                    by_gram, whole, sure, size = {}, {}, array("q"), 0
        yield from emit(by_gram, whole, sure)

    def emit(by_gram: dict, whole: dict, sure: array) -> Iterator[pa.RecordBatch]:
        of: dict[int, list] = defaultdict(list)
        while by_gram:
            (context, left), found = by_gram.popitem()
            of[_part_of(context[left:left + gram], n_parts)].append((context[left:], context[:left], found))
        while whole:
            context, place = whole.popitem()
            of[n_parts + _part_of(context, n_parts)].append((context, b"", [place]))
        yield from coded(of)
        yield from packed(sure)

    def coded(of: dict[int, list]) -> Iterator[pa.RecordBatch]:
        while of:
            part, entries = of.popitem()
            entries.sort()
            yield _run(part, front_code(entries))

    def packed(sure: array) -> Iterator[pa.RecordBatch]:
        found = united(np.frombuffer(sure, np.int64).reshape(-1, 3)) if sure else ()
        for i in range(0, len(found), SPANS_PER_ROW):
            yield _run(2 * n_parts + int(found[i, 0]) % n_parts, found[i:i + SPANS_PER_ROW].tobytes())

    def _run(part: int, run: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([run], pa.binary())], names=["part", "run"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
        """The runs of each part together; rows of packed spans one by one."""
        part, blocks = None, []
        for batch in batches:
            for i, p in enumerate(batch.column(0).to_pylist()):
                block = batch.column(1)[i].as_py()
                if p != part or p >= 2 * n_parts:
                    if blocks:
                        yield part, blocks
                    part, blocks = p, []
                blocks.append(block)
        if blocks:
            yield part, blocks

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: dict[bytes, tuple[int, int]] = {}
        sure = array("q")
        for part, blocks in parts(batches):
            if part >= 2 * n_parts:
                yield _run(part, blocks[0])
                continue
            if part < n_parts:
                group: dict[bytes, list] = {}
                for shared, suffix, (left, found) in LoserTree([read_run(b) for b in blocks]):
                    if shared < gram and group:
                        for span in repeated_spans(group, length):
                            sure.extend(span)
                        group = {}
                    group.setdefault(left + suffix, []).extend(found)
                for span in repeated_spans(group, length):
                    sure.extend(span)
            else:
                for context, key, place in different(blocks, sure):
                    for p in range(len(context) - length + 1):
                        window, at = context[p:p + length], place + p if place >= 0 else -1
                        if window in windows:
                            _meet(sure, length, *windows[window], key, at)
                            at = -1
                        windows[window] = key, at
                    if 500 * len(windows) + 48 * len(sure) // 3 > HELD_BYTES:
                        yield from handed(windows, sure)
                        windows, sure = {}, array("q")
            if 48 * len(sure) // 3 > HELD_BYTES:
                yield from handed(windows, sure)
                windows, sure = {}, array("q")
        yield from handed(windows, sure)

    def handed(windows: dict, sure: array) -> Iterator[pa.RecordBatch]:
        of: dict[int, list] = defaultdict(list)
        while windows:
            window, place = windows.popitem()
            of[_part_of(window, n_tasks)].append((window, b"", [place]))
        yield from coded(of)
        yield from packed(sure)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blocks in parts(batches):
            if part >= 2 * n_parts:
                found = np.frombuffer(blocks[0], np.int64).reshape(-1, 3)
            else:
                sure = array("q")
                for _ in different(blocks, sure):
                    pass
                found = united(np.frombuffer(sure, np.int64).reshape(-1, 3)) if sure else np.empty((0, 3), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, c]) for c in range(3)], names=["rk", "start", "stop"])

    def dealt(step: DataFrame) -> DataFrame:
        return step.repartition(n_tasks, "part").sortWithinPartitions("part")

    first = dealt(texts.mapInArrow(runs, "part int, run binary"))
    second = dealt(first.mapInArrow(merged, "part int, run binary"))
    return second.mapInArrow(told, "rk long, start long, stop long")


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, spread: int = SPREAD, bytes_only: bool = False) -> DataFrame:
    """Every row of ``docs`` (doc_id, text, ...; struct ``payload``: all columns but the text), with ``n_bytes``, ``n_removed``,
    ``n_spans``, ``kept_sha256`` and ``kept``: the text without the bytes that repeated windows cover.

    A null text is empty; texts shorter than ``length`` keep all bytes.  Equal
    rows are each other's copies.  Where a cut leaves part of a character,
    ``kept`` leaves that part out; the hash is over the bytes.
    """
    if not 0 < gram <= length < 4096:
        raise ValueError("gram <= length < 4096 is needed")
    rows = _dealt(docs)
    found = spans(rows, length, gram, spread)
    per_row = found.groupBy("rk").agg(F.collect_set(F.struct("start", "stop")).alias("cut"))
    joined = rows.join(per_row, "rk", "left").select("payload", "text", "rk", F.col("cut.start").alias("start"), F.col("cut.stop").alias("stop"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffer(batch.column(1))
            data = raw.tobytes()
            starts, stops = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            size, gone, many, sha, kept = [], [], [], [], []
            for r, (s, e) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
                text, pieces, at, n = data[s:e], [], 0, 0
                if starts[r]:
                    stop = -1
                    for a, b in sorted(zip(starts[r], stops[r])):
                        if a > stop:
                            n += 1
                            if stop >= 0:
                                at = stop
                            pieces.append(text[at:a])
                        stop = max(stop, b)
                    pieces.append(text[stop:])
                    rest = b"".join(pieces)
                else:
                    rest = text
                size.append(len(text))
                gone.append(len(text) - len(rest))
                many.append(n)
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(None if bytes_only or not batch.column(1)[r].is_valid else rest.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(many, pa.int64()),
                 pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                names=["payload", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = T.StructType([joined.schema["payload"], *T.StructType.fromDDL(
        "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")])
    return joined.mapInArrow(cut, schema)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    got = cut_repeats(docs.select("doc_id", "text"), bytes_only=True)
    return got.select(F.col("payload.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut out of their texts; a null text stays null, n_chars follows the text."""
    got = cut_repeats(docs)
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("kept").alias("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType))
                        .otherwise(F.col("payload.n_chars")).alias("n_chars"))
        else:
            cols.append(F.col(f"payload.`{c}`").alias(c))
    return got.select(*cols)
