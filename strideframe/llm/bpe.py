"""Byte-pair encoding by prefix-sharing trie traversal, and decoding.

The last token of the encoding of a word's prefix is unique: it is the one
vocabulary token ``t`` that ends the prefix and can stand after the last token
of the prefix without ``t``.  So the encodings of all prefixes of a word follow
from one token per prefix.  The distinct words of a block of text are inserted
into a trie, which is then walked depth first; each node gets its last token
from the nodes above it, and a prefix that many words share is worked out once.

Whether two tokens can stand side by side is decided from the ranks at which
the merges inside them happen: no merge across their border may come first.

Everything is narrow: a block of rows is encoded where Spark reads it.  The
vocabulary is read from the path the caller gives, in each worker.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_chunks, text_buffer, with_rows

# White space as the tokenizer's pattern understands it, and that pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
# Characters that the tokenizer's table, which is older, knows neither as letters nor as numbers.
UNKNOWN = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF "
    "18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 "
    "3D000-3FC3F")
_UNKNOWN = "".join("-".join(f"\\U{int(end, 16):08x}" for end in part.split("-")) for part in UNKNOWN.split())
HAS_UNKNOWN = regex.compile(f"[{_UNKNOWN}]")
#: The same pattern with the tokenizer's own table; slower, for words that hold such a character.
WORDS_OF_TABLE = regex.compile(
    rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{_UNKNOWN}]]+| ?[\p{{N}}--[{_UNKNOWN}]]+"
    rf"| ?(?:[{_UNKNOWN}]|[^{SPACE}\p{{L}}\p{{N}}])+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A space that does not simply stand before a word; texts without one are cut at their spaces.
ODD = regex.compile(rf" (?:[{SPACE}]|\Z)")
PIECES = regex.compile(rf" ?[^{SPACE}]+|[{SPACE}]+?(?= [^{SPACE}])|[{SPACE}]+[^{SPACE}]*")
#: Token lengths to try at any place.
SHORT = (2, 1)
#: Distinct words and pieces whose encodings a task keeps; beyond it the memory is emptied, results stay the same.
MEMORY = 800_000


class Vocabulary:
    """Tokens, merges and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        back = {c: b for b, c in enumerate(_byte_letters())}
        raw = lambda token: bytes(back[c] for c in token)
        self.bytes_of: dict[int, bytes] = {i: raw(t) for t, i in model["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.four = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        ends: dict[bytes, set[int]] = {}
        for token in self.id_of:
            if len(token) > 2:
                ends.setdefault(token[-3:], set()).add(len(token))
        #: Lengths of the tokens that end with three bytes, longest first.
        self.lengths = {e: (*sorted(n, reverse=True), *SHORT) for e, n in ends.items()}
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = model["vocab"][left], model["vocab"][right]
            self.merge[a, b] = rank
            self.parts.setdefault(model["vocab"][left + right], (rank, a, b))
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.edges: dict[int, tuple[list, dict]] = {}
        self.fits: dict[int, bool] = {}
        self.memory: tuple[dict, dict] = ({}, {})
        self.words: dict[str, bytes] = {}

    def _edge(self, token: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """The symbols that stand at the token's right and left end while it is put together,
        each with the rank of the merge that takes it in."""
        if token not in self.edges:
            sides = []
            for side in (2, 1):
                at, gone, found = token, 1 << 60, []
                while True:
                    found.append((at, gone))
                    if at not in self.parts:
                        break
                    gone, at = self.parts[at][0], self.parts[at][side]
                sides.append(found)
            self.edges[token] = tuple(sides)
        return self.edges[token]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' bytes is just these two tokens."""
        key = left << 24 | right
        known = self.fits.get(key)
        if known is None:
            known, merge = True, self.merge
            for u, u_gone in self._edge(left)[0]:
                for v, v_gone in self._edge(right)[1]:
                    rank = merge.get((u, v))
                    # equal ranks: the leftmost pair goes first
                    if rank is not None and rank < u_gone and rank <= v_gone:
                        known = False
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            self.fits[key] = known
        return known

    def encode_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Encodings of distinct words, four bytes an id.

        Sorted words are the trie in depth-first order: the bytes a word
        shares with the one before are the path they have in common, and the
        two stacks hold the last token of every prefix on the present path and
        where it starts.  A word's encoding is read off them from its end.
        """
        out: dict[bytes, bytes] = {}
        last, begin = [-1], [0]
        before = b""
        get, known_fit, four, lengths = self.id_of.get, self.fits.get, self.four, self.lengths.get
        for word in sorted(words):
            size = len(word)
            common, most = 0, min(size, len(before))
            if word[:most] == before[:most]:
                common = most
            else:
                while word[common] == before[common]:
                    common += 1
            del last[common + 1:]
            del begin[common + 1:]
            for end in range(common + 1, size + 1):
                for n in lengths(word[end - 3:end], SHORT) if end > 2 else SHORT:
                    start = end - n
                    if start < 0:
                        continue
                    token = get(word[start:end])
                    if token is None:
                        continue
                    if start:
                        fit = known_fit(last[start] << 24 | token)
                        if fit is None:
                            fit = self.adjacent(last[start], token)
                        if not fit:
                            continue
                    last.append(token)
                    begin.append(start)
                    break
                else:
                    raise ValueError(f"no token ends at byte {end} of {word!r}")
            ids, end = [], size
            while end:
                ids.append(four[last[end]])
                end = begin[end]
            ids.reverse()
            out[word] = b"".join(ids)
            before = word
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        plain, spaced = self.memory
        if len(plain) + len(spaced) + len(self.words) > MEMORY:
            plain.clear()
            spaced.clear()
            self.words.clear()
        cut: list[list] = []
        new_plain: set[str] = set()
        new_spaced: set[str] = set()
        for text in texts:
            parts: list = []
            for k, part in enumerate(self.cut.split(text) if self.cut and self.cut.search(text) else [text]):
                if k % 2:
                    parts.append(self.added[part])
                elif ODD.search(part):
                    pieces = PIECES.findall(part)
                    new_plain.update(pieces)
                    parts.append(pieces)
                elif part:
                    first, *pieces = part.split(" ")
                    new_plain.add(first)
                    new_spaced.update(pieces)
                    parts.append((first, pieces))
            cut.append(parts)
        self._learn(plain, [p for p in new_plain if p not in plain], "")
        self._learn(spaced, [p for p in new_spaced if p not in spaced], " ")
        out = []
        for parts in cut:
            ids: list[bytes] = []
            for part in parts:
                if isinstance(part, tuple):
                    ids.append(plain[part[0]])
                    ids.extend(map(spaced.__getitem__, part[1]))
                elif isinstance(part, list):
                    ids.extend(map(plain.__getitem__, part))
                else:
                    ids.append(part.to_bytes(4, "little"))
            out.append(b"".join(ids))
        return out

    def forget(self) -> None:
        """Empties the memory; a worker keeps none of it from one task to the next."""
        for kept in (*self.memory, self.words, self.fits):
            kept.clear()

    def _learn(self, memory: dict[str, bytes], pieces: list[str], before: str) -> None:
        split = [(WORDS if p.isascii() or not HAS_UNKNOWN.search(p) else WORDS_OF_TABLE).findall(before + p) for p in pieces]
        known = self.words
        new = {w.encode(): w for words in split for w in words if w not in known}
        for raw, ids in self.encode_words(list(new)).items():
            known[new[raw]] = ids
        for piece, words in zip(pieces, split):
            memory[piece] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become the replacement character."""
        raw = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode("utf-8", "replace").encode()
        return raw


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the file: itself if printable, else the next free one."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """Every row of ``docs`` (struct ``payload``: all columns but the text) with ``ids`` (binary, little-endian unsigned
    32-bit integers) and ``decoded`` (the text decoded from them).

    A null or empty text has no ids and decodes to the empty text.  Repeated
    rows are encoded each.  No row moves; no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        voc = vocabulary(vocabulary_path)
        try:
            for batch in batches:
                col = batch.column(1)
                _, offsets = text_buffer(col)
                for i, j in row_chunks(offsets):
                    ids = voc.encode([t or "" for t in col.slice(i, j - i).to_pylist()])
                    decoded = [voc.decode(x).decode() for x in ids]
                    yield batch, i, j, [pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
        finally:
            voc.forget()

    return with_rows(docs, text, run, "ids binary, decoded string")


def digest(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """Count and hashes of the ids and of the decoded text; the row stays in ``payload``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        voc = vocabulary(vocabulary_path)
        try:
            for batch in batches:
                col = batch.column(1)
                _, offsets = text_buffer(col)
                for i, j in row_chunks(offsets):
                    ids = voc.encode([t or "" for t in col.slice(i, j - i).to_pylist()])
                    yield batch, i, j, [pa.array([len(x) // 4 for x in ids], pa.int64()),
                                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                                        pa.array([hashlib.sha256(voc.decode(x)).hexdigest() for x in ids], pa.string())]
        finally:
            voc.forget()

    return with_rows(docs, text, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    got = digest(docs.select("doc_id", "text"), vocabulary_path)
    return got.select(F.col("payload.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
