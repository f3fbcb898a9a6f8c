"""Alignment of two tokenizers' tokens through whitespace anchors and memoised windows.

Both tokenizers encode the whole text.  Where tokens of both end at the same
byte and the next token of both is marked with a space, the text is cut: these
places are anchors.  Between two anchors stands a window, a tuple of ids of
either side, and whatever holds inside it (groups, links) follows from these
ids alone, so each distinct window of a block is aligned once.

A pair of ids that is linked counts the documents which hold it.  The counts
need the whole corpus, so the work has two passes:

1. A task cuts its rows into blocks.  A block's rows keep the numbers of their
   windows; the block has one row more with its distinct windows, its distinct
   pairs and how many of its documents hold each pair.  This is written once.
2. Counts are summed by pair.  Each block asks for the counts of its own pairs
   (an equi-join), and the answers meet the block's rows again (a cogroup by
   block), where the numbers of windows turn into sums.

Nothing is broadcast.  What moves is one number a window occurrence and one row
per (block, distinct pair); a block is bounded by ``BLOCK_CHARACTERS`` and
``BLOCK_WINDOWS``, except that one row is never cut.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_dir
from .common import row_chunks, split_join, text_buffer

#: Characters of a block, distinct windows of a block, and ids in its distinct windows: beyond any of them the next block begins.
BLOCK_CHARACTERS = 64 << 20
BLOCK_WINDOWS = 200_000
BLOCK_IDS = 4_000_000
#: Words whose ids a worker remembers; beyond it only those of the last chunk stay.
MEMORY = 250_000
_CHUNK = 2 << 20
#: Longer words go to the first library; the other splits them at a cost that grows fast.
_LONG = 500

_CUT = re.compile(r"(?<=\S) (?=\S)")
_ODD = re.compile(r"\s | \s|\A | \Z")
#: Words of characters that Unicode tables of any age class alike, none of them white space.
_PLAIN = re.compile("[!-~¡-ɏ]+").fullmatch
_TOGETHER = 20_000
_SIDE = np.uint32(1 << 31)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, others in order from 256."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """The two tokenizers, with a memory of words.

    Words are cut at single spaces between other characters: neither
    tokenizer has a token that crosses such a place, which is verified for
    both vocabularies, so the ids of a text are those of its words in a row.
    """

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(byte_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        with open(byte_path, encoding="utf-8") as f:
            spec = json.load(f)
        model, back = spec["model"], byte_letters()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids do not follow the order of the merges")
        self.ranks = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 2)
        for t, i in ranks.items():
            self.a_bytes[i] = t

        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for p in pieces) or any(_CUT.search(t.decode("utf-8", "replace")) for t in ranks):
            raise ValueError("a token crosses the start of a word")

        self.a_size, self.b_size = [np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes)]
        self.a_space, self.b_space = [np.array([t.startswith(b" ") for t in side]) for side in (self.a_bytes, self.b_bytes)]
        #: Ids as text, followed by what stands after an id inside a side, at its end, at a group's end, at a window's end.
        self.written = [f"{i}{mark}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for mark in (",", "|", ";", "")]
        self.written_size = np.array(list(map(len, self.written)), np.int64)
        self.a_of: dict[str, bytes] = {}
        self.b_of: dict[str, bytes] = {}
        self.odd: set[str] = set()  # words whose tokens are not their bytes

    def _a_ids(self, plain: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word after a space, in a row, and how many each word has.

        Plain words hold no white space, so they can stand in one text: a word
        begins where its bytes begin.
        """
        ids, counts = [], []
        for i in range(0, len(plain), _TOGETHER):
            words = plain[i:i + _TOGETHER]
            got = np.array(self.ranks.encode_ordinary(" " + " ".join(words)), np.int64)
            ends = np.searchsorted(np.cumsum(self.a_size[got]), np.cumsum([len(w.encode()) + 1 for w in words])) + 1
            ids.append(got)
            counts.append(np.diff(ends, prepend=0))
        for e in self.a.encode_batch_fast([" " + w for w in others], add_special_tokens=False):
            ids.append(np.array(e.ids, np.int64))
            counts.append(np.array([len(e.ids)]))
        return np.concatenate(ids), np.concatenate(counts)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of both sides as unsigned 32-bit integers; nothing where either side's tokens are not the text's bytes."""
        cut = [t.split(" ") if not _ODD.search(t) else _CUT.split(t) for t in texts]
        need = set().union(*cut)
        a_of, b_of = self.a_of, self.b_of
        if len(a_of) > MEMORY:
            kept = [w for w in need if w in a_of]
            self.a_of = a_of = {w: a_of[w] for w in kept}
            self.b_of = b_of = {w: b_of[w] for w in kept}
            self.odd &= need
        plain, others = [], []
        for w in need:
            if w not in a_of:
                (plain if len(w) <= _LONG and _PLAIN(w) else others).append(w)
        if plain or others:
            self._remember(plain + others, *self._a_ids(plain, others))
        out = []
        for text, words in zip(texts, cut):
            a, b = b"".join(map(a_of.__getitem__, words)), b"".join(map(b_of.__getitem__, words))
            bad = not text or (self.odd and not self.odd.isdisjoint(words)
                               and not self._spells(np.frombuffer(a, "<u4").tolist(), np.frombuffer(b, "<u4").tolist(), text))
            out.append((b"", b"") if bad else (a, b))
        return out

    def _remember(self, words: list[str], a: np.ndarray, a_counts: np.ndarray) -> None:
        pieces = self.b.encode(words, num_threads=1)
        b_counts = np.array(list(map(len, pieces)), np.int64)
        b = np.fromiter(chain.from_iterable(pieces), np.int64, int(b_counts.sum()))
        want = [(" " + w).encode() for w in words]
        size, spelt = np.array(list(map(len, want)), np.int64), True
        for known, ids, counts, table, lengths in ((self.a_of, a, a_counts, self.a_bytes, self.a_size),
                                                   (self.b_of, b, b_counts, self.b_bytes, self.b_size)):
            n = np.concatenate(([0], np.cumsum(counts)))
            raw, at = ids.astype("<u4").tobytes(), (4 * n).tolist()
            known.update(zip(words, [raw[s:e] for s, e in zip(at, at[1:])]))
            upto = np.concatenate(([0], np.cumsum(lengths[ids])))
            # words of equal lengths in a row that spell the same bytes together are each spelt right
            spelt = spelt and np.array_equal(np.diff(upto[n]), size) and b"".join(map(table.__getitem__, ids.tolist())) == b"".join(want)
        if not spelt:
            ids = [np.frombuffer(side[w], "<u4").tolist() for w in words for side in (self.a_of, self.b_of)]
            self.odd.update(w for w, x, y in zip(words, ids[::2], ids[1::2]) if not self._spells(x, y, w))

    def _spells(self, a: list[int], b: list[int], text: str) -> bool:
        want = (" " + text).encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b))

    def forget(self) -> None:
        """Empties the memory; a worker keeps none of it from one task to the next."""
        self.a_of, self.b_of, self.odd = {}, {}, set()


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The different numbers in order; sorting beats hashing by far here."""
    numbers = np.sort(numbers)
    first = np.ones(len(numbers), bool)
    first[1:] = numbers[1:] != numbers[:-1]
    return numbers[first]


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``start[k] .. start[k] + size[k] - 1`` for each k in a row."""
    first = np.cumsum(size) - size
    return np.repeat(start - first, size) + np.arange(int(size.sum()))


def align(pair: Pair, a: np.ndarray, b: np.ndarray, a_upto: np.ndarray, b_upto: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Aligns windows that lie in a row; ``a_upto`` and ``b_upto`` are the numbers of ids up to the end of each.

    Returns each window's groups as text, how many groups and links it has,
    and all links in order (first id in the upper half of the number).
    """
    a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    # between two neighbouring ends, of either side, lies one stretch of one token on each side: a link
    ends = distinct(np.concatenate((a_end, b_end)))
    i, j = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    shared = (a_end[i] == ends) & (b_end[j] == ends)
    close = ends[shared]
    border = a_end[a_upto - 1]
    links = np.diff(np.searchsorted(ends, border, side="right"), prepend=0)
    groups = np.diff(np.searchsorted(close, border, side="right"), prepend=0)
    # text: a group's ids of one side, then of the other; what follows an id says whether side, group or window ends there
    group = np.concatenate((np.searchsorted(close, a_end), np.searchsorted(close, b_end)))
    side = np.repeat([0, 1], [len(a), len(b)])
    order = np.argsort(group * 2 + side, kind="stable")
    group, side = group[order], side[order]
    after = np.zeros(len(order), np.int64)
    after[:-1] = np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1])
    after[np.searchsorted(group, np.cumsum(groups) - 1, side="right") - 1] = 3
    code = np.concatenate((a, b)).astype(np.int64)[order] * 4 + after
    text = "".join(map(pair.written.__getitem__, code.tolist()))
    cut = np.cumsum(pair.written_size[code])[np.searchsorted(group, np.cumsum(groups) - 1, side="right") - 1].tolist()
    return ([text[s:e] for s, e in zip([0, *cut], cut)], groups, links, a[i].astype(np.int64) << 32 | b[j])


def packed(numbers: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes each as the largest needs, byte plane by byte plane (high planes compress)."""
    width = max(1, (int(numbers.max()).bit_length() + 7) // 8) if len(numbers) else 1
    return bytes([width]) + np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros(planes.shape[1], np.int64)
    for k, plane in enumerate(planes):
        out |= plane.astype(np.int64) << 8 * k
    return out


class Block:
    """The distinct windows of some rows, and how many of the rows hold each pair."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.at: dict[bytes, int] = {}
        self.text: list[str] = []
        self.groups = np.empty(0, np.int64)  # by window
        self.start = np.zeros(1, np.int64)  # of each window's links
        self.links = np.empty(0, np.int64)  # places of pairs
        self.pair_at: dict[int, int] = {}
        self.docs = np.empty(0, np.int64)  # by place of pair
        self.size = self.ids = 0

    def full(self) -> bool:
        return self.size >= BLOCK_CHARACTERS or len(self.at) >= BLOCK_WINDOWS or self.ids >= BLOCK_IDS

    def _learn(self, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, a_size: np.ndarray, b_size: np.ndarray,
               fresh: np.ndarray) -> None:
        """Aligns new windows, given as numbers of windows that end at ``a_cut`` and ``b_cut``."""
        a_size, b_size, a_cut, b_cut = a_size[fresh], b_size[fresh], a_cut[fresh], b_cut[fresh]
        text, groups, links, codes = align(self.pair, a[spans(a_cut - a_size, a_size)], b[spans(b_cut - b_size, b_size)],
                                           np.cumsum(a_size), np.cumsum(b_size))
        self.text += text
        self.groups = np.concatenate((self.groups, groups))
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(links)))
        place = self.pair_at
        found, at = np.unique(codes, return_inverse=True)
        self.links = np.concatenate((self.links, np.array([place.setdefault(x, len(place)) for x in found.tolist()])[at]))
        self.ids += int(a_size.sum() + b_size.sum())

    def add(self, texts: list[str]) -> list[tuple]:
        """(tokens of either side, groups, links, groups as text, packed numbers of the windows) of each text."""
        pair = self.pair
        ids = pair.encode(texts)
        self.size += sum(map(len, texts))
        n_a, n_b = [np.array([len(x[s]) // 4 for x in ids], np.int64) for s in (0, 1)]
        a, b = [np.frombuffer(b"".join([x[s] for x in ids]), "<u4") for s in (0, 1)]
        if not len(a):
            return [(0, 0, 0, 0, "", packed(np.empty(0, np.int64)))] * len(texts)
        # ends of tokens, over all texts; a text has equally many bytes on both sides
        a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
        meet = np.searchsorted(b_end, a_end)
        a_cut = np.flatnonzero(b_end[meet] == a_end)
        b_cut = meet[a_cut]
        # the last meeting is the end of the last text; every other must stand before a space on both sides
        anchor = np.append(pair.a_space[a[a_cut[:-1] + 1]] & pair.b_space[b[b_cut[:-1] + 1]], True)
        a_cut, b_cut = a_cut[anchor] + 1, b_cut[anchor] + 1
        # a window's ids of both sides next to each other: its key
        a_size, b_size = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
        both = np.empty(len(a) + len(b), "<u4")
        both[np.arange(len(a)) + np.repeat(b_cut - b_size, a_size)] = a
        both[np.arange(len(b)) + np.repeat(a_cut, b_size)] = b | _SIDE
        raw, cut, at = both.tobytes(), (4 * (a_cut + b_cut)).tolist(), self.at
        keys = [raw[s:e] for s, e in zip([0, *cut], cut)]
        numbers = list(map(at.get, keys))
        if None in numbers:
            fresh = []
            for k, number in enumerate(numbers):
                if number is None:
                    number = at.setdefault(keys[k], len(at))
                    numbers[k] = number
                    if number == len(self.text) + len(fresh):
                        fresh.append(k)
            self._learn(a, b, a_cut, b_cut, a_size, b_size, np.array(fresh))
        window = np.array(numbers, np.int64)
        upto = np.concatenate(([0], np.searchsorted(a_cut, np.cumsum(n_a), side="right")))  # windows up to the end of each text
        self._count(window, np.repeat(np.arange(len(texts)), np.diff(upto)))
        groups = np.concatenate(([0], np.cumsum(self.groups[window])))[upto]
        links = np.concatenate(([0], np.cumsum(np.diff(self.start)[window])))[upto]
        cut, text = upto.tolist(), self.text.__getitem__
        return [(x, y, g, k, ";".join(map(text, numbers[s:e])), packed(window[s:e]))
                for x, y, g, k, s, e in zip(n_a.tolist(), n_b.tolist(), np.diff(groups).tolist(), np.diff(links).tolist(), cut, cut[1:])]

    def _count(self, window: np.ndarray, doc: np.ndarray) -> None:
        """Adds one to each pair for each text that holds it."""
        held = distinct(doc * len(self.text) + window)
        doc, window = held // len(self.text), held % len(self.text)
        size = self.start[window + 1] - self.start[window]
        pairs = len(self.pair_at)
        pair = distinct(np.repeat(doc, size) * pairs + self.links[spans(self.start[window], size)]) % pairs
        self.docs = np.concatenate((self.docs, np.zeros(pairs - len(self.docs), np.int64))) + np.bincount(pair, minlength=pairs)

    def row(self) -> dict[str, bytes]:
        pairs = np.fromiter(self.pair_at, np.int64, len(self.pair_at))
        return {"pairs": pairs.tobytes(), "held": packed(self.docs), "sizes": packed(np.diff(self.start)), "links": packed(self.links)}


_LOADED: dict[tuple[str, str], Pair] = {}


def _loaded(*paths: str) -> Pair:
    if paths not in _LOADED:
        _LOADED[paths] = Pair(*paths)
    return _LOADED[paths]


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCK = ("pairs", "held", "sizes", "links")


def _blocks(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """The first pass: the rows (``pairs`` null) and the blocks' own rows (``payload`` null)."""
    schema = _schema(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _loaded(byte_path, piece_path)
        kind = None
        number = TaskContext.get().partitionId() << 32
        block = Block(pair)
        gc.disable()  # nothing here is cyclic, and its passes over the dictionaries cost a tenth of the time

        def close() -> pa.RecordBatch:
            cols = [pa.nulls(1, kind), pa.array([number], pa.int64()), *[pa.nulls(1, pa.int64()) for _ in _COUNTS],
                    pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), *[pa.array([x], pa.binary()) for x in block.row().values()]]
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        try:
            for batch in batches:
                kind = batch.column(0).type
                _, offsets = text_buffer(batch.column(1))
                for i, j in row_chunks(offsets, _CHUNK):
                    if block.full():
                        yield close()
                        number, block = number + 1, Block(pair)
                    got = list(zip(*block.add([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])))
                    cols = [batch.column(0).slice(i, j - i), pa.array([number] * (j - i), pa.int64()),
                            *[pa.array(x, pa.int64()) for x in got[:4]], pa.array(got[4], pa.string()), pa.array(got[5], pa.binary())]
                    yield pa.RecordBatch.from_arrays([*cols, *[pa.nulls(j - i, pa.binary()) for _ in _BLOCK]], names=schema.names)
            if block.at:
                yield close()
        finally:
            pair.forget()
            gc.enable()

    return docs.mapInArrow(run, schema)


def _schema(docs: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("payload", docs.schema["payload"].dataType), T.StructField("block", T.LongType()),
                         *[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("groups", T.StringType()),
                         T.StructField("windows", T.BinaryType()), *[T.StructField(c, T.BinaryType()) for c in _BLOCK]])


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, pair, documents) of each distinct pair of a block."""
    for batch in batches:
        for block, pairs, held in zip(*[c.to_pylist() for c in batch.columns]):
            pairs, held = np.frombuffer(pairs, np.int64), unpacked(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), block)), pa.array(pairs), pa.array(held)],
                                             names=["block", "pair", "held"])


def link_counts(rows: DataFrame) -> DataFrame:
    """pair, count (documents that hold it) and best (whether no other pair of its first id has more) from (block, pair, held)."""
    counts = rows.groupBy("pair").agg(F.sum("held").alias("count"))
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))
    joined = split_join(counts.withColumn("a", F.shiftright("pair", 32)), most, ["a"])
    return joined.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def aligned(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text",
            groups: Callable[[Column], Column] | None = None) -> DataFrame:
    """Every row of ``docs`` (struct ``payload``: all columns but the text) with n_a, n_b, n_groups, n_links, groups,
    n_best (links whose pair's count is the highest of its first id) and count_sum (counts summed over the links).

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` in order, or what the function
    ``groups`` makes of it before it is stored.  Null and empty texts, and
    texts whose tokens do not spell the text after a space, have no tokens:
    zeros and an empty string.  Each repeated row counts as a document.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("none")]
    packed = docs.select(F.struct(*others).alias("payload"), F.col(f"`{text}`").cast("string").alias("text"))
    first = _blocks(packed, byte_path, piece_path)
    if groups is not None:
        first = first.withColumn("groups", F.when(F.col("groups") == "", F.lit("")).otherwise(groups(F.col("groups"))))
    folder = scratch_dir(docs.sparkSession, "alignment")
    first.write.option("compression", "zstd").parquet(folder)
    stored = docs.sparkSession.read.schema(first.schema).parquet(folder)

    pairs = stored.filter(F.col("pairs").isNotNull()).select("block", "pairs", "held") \
        .mapInArrow(_pairs_of, "block long, pair long, held long")
    answers = split_join(pairs.select("block", "pair"), link_counts(pairs), ["pair"])
    out = T.StructType([f for f in stored.schema if f.name in ("payload", *_COUNTS, "groups")]).add("n_best", "long").add("count_sum", "long")

    def sums(rows: pa.Table, answer: pa.Table) -> pa.Table:
        own = np.flatnonzero(rows.column("pairs").is_valid().to_numpy(zero_copy_only=False))
        kept = rows.filter(rows.column("pairs").is_null())
        totals = [np.zeros(len(kept), np.int64), np.zeros(len(kept), np.int64)]
        if len(own):
            at = int(own[0])
            pairs = np.frombuffer(rows.column("pairs")[at].as_py(), np.int64)
            start = np.concatenate(([0], np.cumsum(unpacked(rows.column("sizes")[at].as_py()))))
            links = unpacked(rows.column("links")[at].as_py())
            asked = answer.column("pair").to_numpy()
            order = np.argsort(asked)
            place = order[np.searchsorted(asked, pairs, sorter=order)]
            windows = [unpacked(w) for w in kept.column("windows").to_pylist()]
            upto = np.concatenate(([0], np.cumsum(list(map(len, windows)))))
            window = np.concatenate([np.empty(0, np.int64), *windows])
            for k, name in enumerate(("best", "count")):
                value = answer.column(name).to_numpy().astype(np.int64)[place]
                by_link = np.concatenate(([0], np.cumsum(value[links])))[start]
                totals[k] = np.diff(np.concatenate(([0], np.cumsum(np.diff(by_link)[window])))[upto])
        cols = [kept.column(f.name) if f.name in kept.column_names else pa.chunked_array([totals[f.name == "count_sum"]]) for f in out]
        return pa.Table.from_arrays(cols, names=out.names)

    return stored.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(sums, out)


def digests(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    got = aligned(docs.select("doc_id", "text"), byte_path, piece_path, groups=lambda g: F.sha2(g, 256))
    return got.select("payload.doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
