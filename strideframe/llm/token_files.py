"""Token ids in ORC files, sorted by document id, with stripes, row indexes and Bloom filters.

The documents are dealt out by ranges of their ids and sorted, so that the
files' stripes hold disjoint id ranges: a lookup by id prunes files and
stripes by their statistics, then by the Bloom filter on the id column.  Ids
are an integer list, which ORC stores run-length encoded.  Every row also has
the number of ids before it in its file, so that a global position follows
from one small row per file.  Stripes can be read in parallel.

Encoding is the ``tokenizers`` library's.  White space separates words for it
in any case, so each distinct word of a worker is encoded once and kept.
"""

from __future__ import annotations

import json
import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, row_chunks, row_key, text_buffer

#: Id that ends every document.
END = 2
STRIPE_BYTES = 16 << 20
ROWS_PER_INDEX = 1000
FALSE_HITS = 0.01
#: Distinct words whose ids a worker keeps, half of them words met lately; the half that was not met since goes first.
MEMORY = 800_000


#: Marks that only ever join with other marks to a token, never with letters or digits.
MARKS = string.punctuation.replace("'", "").encode()


class Encoder:
    """Ids of texts, with a memory of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # what was known when the memory was last half full
        model = json.loads(self.tokenizer.to_str())["model"]
        suffix = model.get("end_of_word_suffix")
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        if suffix:
            self.ends_word[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian 32-bit integers, without special tokens added."""
        if len(self.known) > MEMORY // 2:
            self.before, self.known = self.known, {}
        known, before = self.known, self.before
        out, missing, get = [], {}, known.get
        for k, t in enumerate(texts):
            words = fold(t).split()  # at ASCII white space; other white space stays inside a word, for the library
            ids = list(map(get, words))
            if None in ids:
                missing[k] = words
            out.append(ids)
        new = {w for k, words in missing.items() for w, x in zip(words, out[k]) if x is None}
        if before:
            again = {w: before[w] for w in new if w in before}
            known.update(again)
            new -= again.keys()
        self._learn(new)
        for k, words in missing.items():
            out[k] = [known[w] if x is None else x for w, x in zip(words, out[k])]
        return [b"".join(ids) for ids in out]

    def _learn(self, new: set[bytes]) -> None:
        known = self.known
        # marks that end a word are tokens of their own after a letter or digit
        cut = {w: s for w in new if (s := w.rstrip(MARKS)) != w and s[-1:].isalnum() and b"<|" not in w}
        ask = {x for w in new for x in ((cut[w], w[len(cut[w]):]) if w in cut else (w,)) if x not in known}
        letters, rest = [], []
        for w in ask:
            (letters if w.decode().isalpha() else rest).append(w)
        for i in range(0, len(letters), 2000):
            rest.extend(self._together(letters[i:i + 2000]))
        for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)):
            known[w] = np.array(e.ids, "<u4").tobytes()
        for w, s in cut.items():
            known[w] = known[s] + known[w[len(s):]]

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Learns words of letters alone from one call: each ends with its one token that ends a word.

        Returns the words if they cannot be told apart so.
        """
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(words):
            return words
        data, at = ids.tobytes(), 0
        for w, end in zip(words, (4 * ends).tolist()):
            self.known[w] = data[at:end]
            at = end
        return []


def fold(text: bytes) -> bytes:
    """A-Z in lower case, where that changes no id: the tokenizer lower-cases itself, but composes
    letters with combining marks (lead bytes CC and CD) and finds special tokens before."""
    return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write(docs: DataFrame, folder: str, tokenizer_path: str, end: int = END) -> None:
    """Writes (doc_id, n_tokens, before, tokens) of every row of ``docs`` (doc_id, text) to a new folder.

    Rows are in ascending doc_id order across files (nulls first), equal ids in
    an order by their text.  A null or empty text has the end id alone;
    ``before`` is the number of ids before the row in its file.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), row_key("text").alias("k"))
    rows = rows.repartitionByRange(partitions(docs), "doc_id", "k").sortWithinPartitions("doc_id", "k").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before, stop = _encoder(tokenizer_path), 0, end.to_bytes(4, "little")
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for i, j in row_chunks(offsets):
                data, cut = raw[offsets[i]:offsets[j]].tobytes(), (offsets[i:j + 1] - offsets[i]).tolist()
                ids = [x + stop for x in encoder.encode([data[s:e] for s, e in zip(cut, cut[1:])])]
                size = np.array([len(x) // 4 for x in ids], np.int64)
                first = before + np.r_[0, np.cumsum(size)]
                before = int(first[-1])
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                tokens = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size), pa.array(first[:-1]), tokens],
                                                 names=["doc_id", "n_tokens", "before", "tokens"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    (rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, before long, tokens array<int>").write
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(FALSE_HITS))
     .option("orc.create.index", "true").option("orc.row.index.stride", str(ROWS_PER_INDEX))
     .option("orc.stripe.size", str(STRIPE_BYTES)).option("compression", "zstd").orc(folder))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the files; a filter on doc_id prunes files, stripes and row groups by their metadata."""
    return spark.read.orc(folder)


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, read back from the files.

    ``start`` is the number of ids in all rows before, over all files in their
    order.  The files' totals come from the count columns alone; there is one
    row per file.
    """
    part = F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("long")
    totals = read(spark, folder).select(part.alias("part"), (F.col("before") + F.col("n_tokens")).alias("upto")) \
        .groupBy("part").agg(F.max("upto").alias("n"))
    base = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            values, cut = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B"), lists.offsets.to_pylist()
            crc = [zlib.crc32(values[4 * s:4 * e]) for s, e in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=["part", "doc_id", "before", "n_tokens", "ids_crc32"])

    rows = read(spark, folder).select(part.alias("part"), "doc_id", "before", "n_tokens", "tokens")
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"part long, doc_id {kind}, before long, n_tokens long, ids_crc32 long")
    return out.join(base, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
