"""Fill-in-middle rewriting by block rotation inside one buffer, and its inverse.

A text's lines are scanned for two cuts drawn from a hash of its id.  The text
is copied once into a bytearray, the sentinels go in at the cuts, and two
neighbouring blocks change places by the three-reversal rotation: each block is
reversed where it lies, then both together.  The inverse finds the sentinels,
rotates back and takes them out, which gives the text byte for byte.

Cuts lie at line starts, so working on UTF-8 bytes cuts no character.  Rows are
rewritten where Spark reads them: no shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_chunks, text_buffer, with_rows

# Sentinels, and how often which form is drawn.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 7
RATE_PERCENT = 100
SPM_PERCENT = 50
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Bytes that a reversal holds outside the buffer.
STEP = 1 << 16
_SENTINEL = re.compile(b"<[PSM]>")
#: Bytes that cost more to hold as a batch are yielded on their own.
_OUT_BYTES = 1 << 20


def reverse(view: np.ndarray, start: int, stop: int) -> None:
    """Reverses ``view[start:stop]`` in place, ``STEP`` bytes from either end at a time."""
    while stop - start > 1:
        n = min(STEP, (stop - start) // 2)
        front = view[start:start + n][::-1].copy()
        view[start:start + n] = view[stop - n:stop][::-1]
        view[stop - n:stop] = front
        start, stop = start + n, stop - n


def rotate(buffer: bytearray, start: int, cut: int, stop: int) -> None:
    """Exchanges the neighbouring blocks ``[start, cut)`` and ``[cut, stop)`` of ``buffer``."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, start, cut)
    reverse(view, cut, stop)
    reverse(view, start, stop)


def line_starts(text: bytes) -> np.ndarray:
    """Where each line starts, and the end of the text; a line feed belongs to the line it ends."""
    if not text:
        return np.zeros(1, np.int64)
    after = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    inner = after[:-1] if len(after) and after[-1] == len(text) else after
    return np.concatenate(([0], inner, [len(text)]))


def characters(text: bytes | memoryview) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)) if len(text) else 0


def draws(key: str, seed: int = SEED) -> list[int]:
    """Four numbers below 2**32 from a row's id."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def rewrite(text: bytes, key: str, seed: int = SEED, rate: int = RATE_PERCENT, spm: int = SPM_PERCENT
            ) -> tuple[int, str, int | None, int | None, bytes]:
    """(lines, form, code points before the middle, in the middle, the rewritten text)."""
    starts = line_starts(text)
    n = len(starts) - 1
    h1, h2, h3, h4 = draws(key, seed)
    if not text or _SENTINEL.search(text) or h3 % 100 >= rate:
        return n, PLAIN, None, None, text
    first, second = sorted((int(starts[h1 % (n + 1)]), int(starts[h2 % (n + 1)])))
    before, between = characters(memoryview(text)[:first]), characters(memoryview(text)[first:second])
    buffer = bytearray(text)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    if h4 % 100 < spm:
        rotate(buffer, 0, suffix, len(buffer))
        return n, SPM, before, between, bytes(buffer)
    rotate(buffer, middle, suffix, len(buffer))
    return n, PSM, before, between, bytes(buffer)


def restored(output: bytes, form: str) -> bytes:
    """The text that ``rewrite`` turned into ``output``."""
    if form == PLAIN:
        return output
    buffer, size = bytearray(output), len(output)
    middle = buffer.index(MIDDLE)
    if form == SPM:
        suffix = buffer.index(PREFIX)  # the suffix block ends where the prefix block starts
        rotate(buffer, 0, suffix, size)
        middle, suffix = middle - suffix, size - suffix
    else:
        start = buffer.index(SUFFIX)
        rotate(buffer, start, middle, size)
        middle, suffix = start, start + size - middle
    del buffer[suffix:suffix + len(SUFFIX)]
    del buffer[middle:middle + len(MIDDLE)]
    del buffer[:len(PREFIX)]
    return bytes(buffer)


def _bytes_of(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> list[bytes]:
    data, cut = raw[offsets[i]:offsets[j]].tobytes(), (offsets[i:j + 1] - offsets[i]).tolist()
    return [data[s:e] for s, e in zip(cut, cut[1:])]


def _strings(values: list[bytes]) -> pa.Array:
    """UTF-8 bytes as a string column."""
    return pa.array(values, pa.binary()).cast(pa.string(), safe=False)


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = SEED,
              rate: int = RATE_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """Every row of ``docs`` (struct ``payload``: all columns but the text) with n, form, prefix_chars, middle_chars, output.

    A null text is empty; empty texts, texts that hold a sentinel and those
    that ``rate`` leaves out are ``plain`` and unchanged.  Cuts depend on the
    id and the number of lines alone, so repeated rows come out alike; a null
    id draws as the empty string.
    """
    key = "__fim_key"
    columns = [c for c in docs.columns if c != text]
    named = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias(key),
                        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            keys = batch.column(0).field(0)
            raw, offsets = text_buffer(batch.column(1))
            for i, j in row_chunks(offsets, _OUT_BYTES):
                got = [rewrite(t, k, seed, rate, spm)
                       for t, k in zip(_bytes_of(raw, offsets, i, j), keys.slice(i, j - i).to_pylist())]
                n, form, before, between, out = zip(*got)
                yield batch, i, j, [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()),
                                    pa.array(between, pa.int64()), _strings(out)]

    got = with_rows(named, "text", run, "n long, form string, prefix_chars long, middle_chars long, output string")
    return got.select(F.col("payload.row").alias("payload"), "n", "form", "prefix_chars", "middle_chars", "output")


def restore(rows: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """``rows`` as ``transform`` returns them (``payload``: all columns but ``output``) with ``output`` and ``restored``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            at = batch.column(0).type.get_field_index(form)
            forms = batch.column(0).field(at)
            raw, offsets = text_buffer(batch.column(1))
            for i, j in row_chunks(offsets, _OUT_BYTES):
                got = [restored(o, f) for o, f in zip(_bytes_of(raw, offsets, i, j), forms.slice(i, j - i).to_pylist())]
                yield batch, i, j, [_strings(got)]

    return with_rows(rows, output, run, "restored string", keep_text=True).withColumnRenamed("text", "output")


def round_trips(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    got = restore(transform(docs.select("doc_id", "text")))
    return got.select("payload.payload.doc_id", "payload.n", "payload.form", "payload.prefix_chars", "payload.middle_chars",
                      F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
         sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
numbers AS (
  SELECT doc_id, text, lines, len(lines) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM drawn),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS c1, greatest(h1 % (n + 1), h2 % (n + 1)) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(list_slice(lines, 1, c1), ''), '') AS p,
         coalesce(array_to_string(list_slice(lines, c1 + 1, c2), ''), '') AS m,
         coalesce(array_to_string(list_slice(lines, c2 + 1, n), ''), '') AS s
  FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
