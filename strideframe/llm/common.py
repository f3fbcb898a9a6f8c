"""Helpers shared by the operators: Arrow batches as bytes, row keys, joins that Spark can split.

Every Python step runs in ``mapInArrow`` over partitions that Spark deals out;
nothing here collects rows to the driver.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step works on.
CHUNK_BYTES = 4 << 20


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n + 1 offsets of a string column; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if offsets is None or len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each; one long row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = j


def row_key(*cols: str) -> Column:
    """A hash of the whole row content that counts: rows with equal values have equal keys."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in cols])


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys on the left Spark can split (AQE skew join).

    A side that was just grouped by the key is already dealt out by it, and
    Spark then leaves its partitions whole.  A second key column derived from
    the first makes both sides exchanges of this join alone.  ``right`` must
    be unique per key.
    """
    salt = "__again"
    lk = left.withColumn(salt, F.xxhash64(*on))
    rk = right.withColumn(salt, F.xxhash64(*on))
    return lk.join(rk, [*on, salt], how).drop(salt)


def drain(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All batches of one partition; for fixed-width columns, whose size a partition bounds."""
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def with_rows(docs: DataFrame, text: str, fn: Callable, ddl: str, keep_text: bool = False) -> DataFrame:
    """``docs`` with the columns that ``fn`` computes from ``text``, all rows kept, no shuffle.

    ``fn`` gets record batches with the text as column 1 and yields
    (batch, i, j, arrays): the new columns of rows i to j.  The other columns
    travel as one struct, ``payload``, so names cannot clash; ``keep_text``
    keeps the text too, as column ``text``.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).cast("int").alias("none")]
    packed = docs.select(F.struct(*others).alias("payload"), F.col(f"`{text}`").cast("string").alias("text"))
    kept = [packed.schema["payload"], packed.schema["text"]][:1 + keep_text]
    schema = T.StructType([*kept, *T.StructType.fromDDL(ddl)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, j, arrays in fn(batches):
            yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, j - i) for k in range(len(kept))], *arrays], names=schema.names)

    return packed.mapInArrow(run, schema)


def original(docs: DataFrame, text: str = "text") -> list[Column]:
    """The columns of ``docs`` from what ``with_rows`` returns with the text kept."""
    return [F.col("text").alias(c) if c == text else F.col(f"payload.`{c}`").alias(c) for c in docs.columns]
