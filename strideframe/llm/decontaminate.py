"""Benchmark decontamination by CGK embedding and bit-sampling LSH, verified by exact edit distance.

Texts and items are normalised the same way (lower case, runs of white space
and ASCII punctuation as one space).  An item of n bytes leaks into a document
if some substring of it is at most ``allowed(n)`` edits (a sixteenth of n)
away from the item.

*Windows.*  A substring with at most k edits shares at least n - q + 1 - q k of
the item's grams of q bytes, at places shifted by at most k against each other.
Counting the grams that the document shares with an item by their shift names
the item-sized windows that can leak; it never loses one.  Everything else of
the corpus is passed over at a few nanoseconds a byte.

*LSH.*  The CGK random walk reads a window with one pointer; at each of 3 n
steps it puts out the byte under the pointer, and a random bit for (step, byte)
tells whether the pointer moves.  Two walks that share the random bits fall
into step again after an edit, so few edits change few places of the output:
edit distance becomes Hamming distance.  ``SAMPLES`` places of the output make
a key; ``ROUNDS`` independent walks and samples give as many keys, and a window
is a candidate for every item of its size with which it shares any key.  Walks
drift apart with the length, so an item longer than ``PIECE`` bytes is embedded
in pieces of equal size: one of them has no more than its share of the edits,
and the item is a candidate where any piece is found at the shift of its grams.
Tests measure the recall (target: 0.99 at the allowed distance).

*Verification.*  Myers' bit-vector algorithm gives each candidate's exact edit
distance from the item to the best substring.

Items are read in blocks of bounded size, each block broadcast on that bound
and taken against all documents; documents never move.  Items shorter than q
bytes leak where they stand as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import original, row_chunks, text_buffer, with_rows

#: Bytes of the grams that name windows.
Q = 12
#: Edits allowed: one in so many bytes of the item.
ONE_IN = 16
#: Independent walks, and sampled places of each.
ROUNDS = 24
SAMPLES = 6
#: Bytes of an item embedded by one walk, at most.
PIECE = 512
#: Bytes of normalised items broadcast at once.
BLOCK_BYTES = 8 << 20
#: Windows embedded and looked up together.
WINDOWS = 4096
SEED = 17

_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_TO_SPACE = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))


def allowed(n: int) -> int:
    """Edits at which an item of ``n`` bytes still counts as leaked; grams of Q bytes are always left then."""
    return max(0, min(n // ONE_IN, (n - Q) // (Q + 1)))


def normalise(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_TO_SPACE).split())


def _gram_codes(raw: np.ndarray) -> np.ndarray:
    """64-bit codes of all grams of Q bytes."""
    n = len(raw) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        low = np.ndarray((n,), "<u8", raw, 0, (1,)) * np.uint64(0x9E3779B97F4A7C15)
        high = np.ndarray((n,), "<u4", raw, 8, (1,)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        code = low ^ (high << np.uint64(7)) ^ high
        return (code ^ (code >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)


class Items:
    """A block of benchmark items with the tables a worker needs."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.ids = [i for i, _ in rows]
        self.texts = [t for _, t in rows]
        self.short = [k for k, t in enumerate(self.texts) if 0 < len(t) < Q]
        long = [k for k, t in enumerate(self.texts) if len(t) >= Q]
        codes = [_gram_codes(np.frombuffer(self.texts[k], np.uint8)) for k in long]
        code = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        item = np.repeat(np.array(long, np.int64), [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.empty(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.code, self.item, self.place = code[order], item[order], place[order]
        self.bits = max(16, min(26, int(len(code)).bit_length() + 5))
        self.there = np.zeros(1 << self.bits, bool)
        self.there[code >> np.uint64(64 - self.bits)] = True
        self.size = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([allowed(len(t)) for t in self.texts], np.int64)
        #: Grams that any window within the allowed edits must share with the item.
        self.least = np.maximum(1, self.size - Q + 1 - Q * self.edits)
        #: Pieces of an item, and the bytes of each but the last.
        self.pieces = np.maximum(1, -(-self.size // PIECE))
        self.width = -(-self.size // self.pieces)
        #: Items and pieces by key; a key holds size and round.
        self.keys: dict[int, list[tuple[int, int]]] = {}
        cut = [(k, j) for k in long for j in range(int(self.pieces[k]))]
        for at, row in zip(cut, lsh_keys([self.piece(k, j) for k, j in cut])):
            for key in row:
                self.keys.setdefault(key, []).append(at)

    def piece(self, k: int, j: int) -> bytes:
        return self.texts[k][j * int(self.width[k]):(j + 1) * int(self.width[k])]

    def windows(self, raw: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item number, piece, start of the item) of the item-sized windows of one text that can leak, for the pieces with grams there."""
        codes = _gram_codes(raw)
        hit = np.flatnonzero(self.there[codes >> np.uint64(64 - self.bits)])
        if not len(hit):
            return
        low = np.searchsorted(self.code, codes[hit], "left")
        many = np.searchsorted(self.code, codes[hit], "right") - low
        hit, low, many = hit[many > 0], low[many > 0], many[many > 0]
        if not len(hit):
            return
        of = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
        item, place = self.item[of], self.place[of]
        shift = np.repeat(hit, many) - place
        order = np.lexsort((shift, item))
        item, place, shift = item[order], place[order], shift[order]
        # the hits of one item within ``edits`` shifts of each other
        lane = item << 40 | (shift + (1 << 39))
        until = np.searchsorted(lane, lane + self.edits[item], "right")
        enough = until - np.arange(len(lane)) >= self.least[item]
        first = np.flatnonzero(enough)
        if len(first):
            marks = np.zeros(len(lane) + 1, np.int64)
            np.add.at(marks, first, 1)
            np.add.at(marks, until[first], -1)
            inside = np.cumsum(marks[:-1]) > 0
            lane, piece = lane[inside], place[inside] // self.width[item[inside]]
            for j in np.flatnonzero(np.bincount(piece)).tolist():
                for lane_value in np.unique(lane[piece == j]).tolist():
                    yield lane_value >> 40, j, (lane_value & (1 << 40) - 1) - (1 << 39)


def lsh_keys(strings: list[bytes]) -> list[list[int]]:
    """For each string ROUNDS keys: sampled places of its CGK walks of 3 n steps, n its size."""
    out: list[list[int]] = []
    for i in range(0, len(strings), 256):
        out.extend(_walk(strings[i:i + 256]))
    return out


def _walk(strings: list[bytes]) -> list[list[int]]:
    size = np.array([len(s) for s in strings])
    steps, count = 3 * int(size.max()), len(strings)
    padded = np.full((count, steps + 1), 256, np.int16)  # 256: past the end
    for k, s in enumerate(strings):
        padded[k, :len(s)] = np.frombuffer(s, np.uint8)
    flat = padded.ravel()
    at = np.tile(np.arange(count) * padded.shape[1], (ROUNDS, 1))
    moves, round_row = _moves(steps), np.arange(ROUNDS)[:, None] * 257
    trace = np.empty((steps, ROUNDS, count), np.int16)
    for j in range(steps):
        c = flat[at]
        trace[j] = c
        at += moves[j].take(round_row + c)
    share = np.random.RandomState(SEED).random_sample((SAMPLES, ROUNDS, 1))
    key = np.tile(size.astype(np.uint64), (ROUNDS, 1)) << np.uint64(8) | np.arange(ROUNDS, dtype=np.uint64)[:, None]
    rows, cols = np.arange(ROUNDS)[:, None], np.arange(count)
    for part in share:
        c = trace[(part * (3 * size)).astype(np.int64), rows, cols]
        key = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64)
    return key.T.tolist()


_MOVES: list[np.ndarray] = []


def _moves(steps: int) -> np.ndarray:
    """Random bits by (step, walk, byte or end); the first rows do not depend on how many are asked for."""
    while len(_MOVES) * 1024 < steps:
        rng = np.random.RandomState((SEED, 99, len(_MOVES)))
        _MOVES.append(rng.randint(0, 2, (1024, ROUNDS * 257), dtype=np.int8))
    return _MOVES[0] if steps <= 1024 else np.concatenate(_MOVES)


def best_distance(pattern: bytes, text: bytes) -> tuple[int, int]:
    """(edits, end): the smallest edit distance of ``pattern`` to a substring of ``text``, and where the first such ends."""
    m = len(pattern)
    mask: dict[int, int] = {}
    for i, c in enumerate(pattern):
        mask[c] = mask.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = mask.get(c, 0)
        x = eq | minus
        d = ((((x & plus) + plus) ^ plus) | x) & full
        up, down = (minus | ~(d | plus)) & full, plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & full  # a match may start anywhere: row zero stays zero
        down = down << 1 & full
        plus, minus = (down | ~(d | up)) & full, up & d
        if score < best:
            best, end = score, j + 1
    return best, end


def leaks_in(texts: list[str], items: Items) -> list[list[tuple[int, int, int]]]:
    """For each text its leaks (item id, edits, start in the normalised text), the best place of each item."""
    found: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
    normal = [normalise(t) if t else b"" for t in texts]
    # by window: piece and start of the items of several pieces that ask for it; judged and let go WINDOWS at a time
    asked: dict[tuple[int, int, int], set[tuple[int, int, int]] | tuple] = {}
    near: dict[tuple[int, int], set[int]] = {}  # by text and item of several pieces: starts to verify
    for t, raw in enumerate(normal):
        for k in items.short:
            at = (b" " + raw + b" ").find(b" " + items.texts[k] + b" ")
            if at >= 0:
                found[t][k] = (0, at)
        if len(raw) >= Q:
            for k, j, start in items.windows(np.frombuffer(raw, np.uint8)):
                place = (t, max(0, start + j * int(items.width[k])), len(items.piece(k, j)))
                if items.pieces[k] > 1:
                    asked[place] = asked.get(place) or set()
                    asked[place].add((k, j, start))
                else:
                    asked.setdefault(place, ())
                if len(asked) >= WINDOWS:
                    _judge(asked, normal, items, found, near)
                    asked.clear()
    _judge(asked, normal, items, found, near)
    for (t, k), starts in near.items():
        best = _verified(items.texts[k], normal[t], int(items.edits[k]), sorted(starts))
        if best[0] <= items.edits[k]:
            found[t][k] = best
    return [sorted((items.ids[k], e, s) for k, (e, s) in f.items()) for f in found]


def _judge(asked: dict, normal: list[bytes], items: Items, found: list[dict], near: dict) -> None:
    """Looks the windows up; notes leaks of items of one piece in ``found``, starts of the others in ``near``."""
    # a window past the text's end is as long as an item all the same
    strings = [normal[t][s:s + n].ljust(n, b" ") for t, s, n in asked]
    distinct = sorted(set(strings))
    keys = dict(zip(distinct, lsh_keys(distinct)))
    for (t, s, n), window in zip(asked, strings):
        alike = {at for key in keys[window] for at in items.keys.get(key, ())}
        for k, j, start in asked[t, s, n]:
            if (k, j) in alike:
                near.setdefault((t, k), set()).add(start)
        for k in {k for k, _ in alike if items.pieces[k] == 1}:
            if window == items.texts[k]:
                edits, start = 0, s
            else:
                spare = int(items.edits[k])
                low = max(0, s - spare)
                edits, end = best_distance(items.texts[k], normal[t][low:s + n + spare])
                start = max(0, low + end - n)
            if edits <= items.edits[k] and (edits, start) < found[t].get(k, (1 << 30, 0)):
                found[t][k] = (edits, start)


def _verified(item: bytes, text: bytes, spare: int, starts: list[int]) -> tuple[int, int]:
    """(edits, start) of the best place of an item around the starts; each part of the text is read once."""
    n = len(item)
    for s in starts:
        if s >= 0 and text.startswith(item, s):
            return 0, s
    best, i = (1 << 30, 0), 0
    while i < len(starts):
        low, until = max(0, starts[i] - spare), starts[i] + n + spare
        while i < len(starts) and starts[i] - spare <= until:
            until = starts[i] + n + spare
            i += 1
        edits, end = best_distance(item, text[low:until])
        best = min(best, (edits, max(0, low + end - n)))
    return best


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """Normalised items in blocks of about ``limit`` bytes; null and empty ones are left out."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).toLocalIterator():
        text = normalise(r["text"])
        if not text:
            continue
        block.append((int(r["item_id"]), text))
        size += len(text)
        if size > limit:
            yield block
            block, size = [], 0
    if block:
        yield block


LEAKS = "leaks array<struct<item_id:bigint,edits:int,start:int>>"


def annotate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """Every row of ``docs`` (see ``with_rows``) with ``leaks``: (item_id, edits, start) of the items in its text.

    ``edits`` is the exact edit distance of the item to the best place found,
    ``start`` that place in the normalised text.  Null and empty texts and
    items match nothing; a repeated item or row is judged each time.
    """
    sc = docs.sparkSession.sparkContext
    blocks = [(uuid.uuid4().hex, sc.broadcast(b)) for b in item_blocks(benchmark, block_bytes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        tables = [_items(name, b) for name, b in blocks]
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int32())]))
        for batch in batches:
            col = batch.column(1)
            _, offsets = text_buffer(col)
            for i, j in row_chunks(offsets):
                texts = col.slice(i, j - i).to_pylist()
                found = [[] for _ in texts]
                for items in tables:
                    found = [f + g for f, g in zip(found, leaks_in(texts, items))]
                yield batch, i, j, [pa.array([[{"item_id": a, "edits": b, "start": c} for a, b, c in f] for f in found], kind)]

    return with_rows(docs, "text", run, LEAKS, keep_text)


_BUILT: dict[str, Items] = {}


def _items(name: str, block) -> Items:
    """A worker builds the tables of a broadcast block once."""
    if name not in _BUILT:
        if len(_BUILT) > 16:
            _BUILT.clear()
        _BUILT[name] = Items(block.value)
    return _BUILT[name]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and leaked item: doc_id, item_id, edits, start."""
    got = annotate(docs.select("doc_id", "text"), benchmark).filter(F.size("leaks") > 0)
    return got.select(F.col("payload.doc_id").alias("doc_id"), F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` into which no item leaked."""
    return annotate(docs, benchmark, keep_text=True).filter(F.size("leaks") == 0).select(*original(docs))
