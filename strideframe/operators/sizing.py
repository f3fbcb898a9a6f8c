"""Size checks before a broadcast.

A side is broadcast only after its rows were counted on a materialised
(checkpointed) frame and ``rows * bytes_per_row`` fits the session's
``spark.sql.autoBroadcastJoinThreshold``.  Beyond it the caller's plan stays
a shuffle join (AQE then handles skew).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20,
          "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}

# Per-row overhead of a broadcast hash relation on top of the key bytes.
ROW_OVERHEAD = 24


def broadcast_budget(spark: SparkSession) -> int:
    """The session's broadcast threshold in bytes (-1: broadcasting is off)."""
    raw = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760b")).strip().lower()
    m = re.fullmatch(r"(-?\d+)\s*([a-z]*)", raw)
    if not m:
        return -1
    n = int(m.group(1))
    return -1 if n < 0 else n * _UNITS.get(m.group(2), 1)


def _width(dt) -> int:
    # Fixed widths as Spark sizes them; strings and nested values at the
    # longest key there is, an e-mail.
    if isinstance(dt, (T.LongType, T.DoubleType, T.TimestampType, T.TimestampNTZType)):
        return 8
    if isinstance(dt, (T.IntegerType, T.FloatType, T.DateType)):
        return 4
    if isinstance(dt, (T.ShortType,)):
        return 2
    if isinstance(dt, (T.BooleanType, T.ByteType)):
        return 1
    return S.EMAIL_MAX_LEN


def row_bytes(df: DataFrame) -> int:
    return sum(_width(f.dataType) for f in df.schema.fields) + ROW_OVERHEAD


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    budget = broadcast_budget(df.sparkSession)
    return budget >= 0 and rows * row_bytes(df) <= budget


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``broadcast(df)`` when ``rows`` of it fit the budget, else ``df``."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df


def semi_filter(big: DataFrame, keys_df: DataFrame, on: list[str], rows: int | None = None) -> DataFrame:
    """Narrow ``big`` to rows whose ``on`` keys occur in ``keys_df``.

    When ``rows`` (a count of ``keys_df``; counted here when not given)
    proves the keys fit the broadcast budget, this is a broadcast semi-join:
    the big side is filtered where it is read, never shuffled.  Otherwise, and
    for a streaming key side, ``big`` is returned as is; the join that follows
    matches the keys (as a shuffle join, or a stream-static join) anyway.
    """
    if keys_df.isStreaming:
        return big
    if rows is None:
        rows = keys_df.count()
    keys = keys_df.select(*on).distinct()
    if fits_broadcast(keys, rows):
        return big.join(F.broadcast(keys), on, "left_semi")
    return big


def keyed_join(big: DataFrame, keys_df: DataFrame, on: list[str], how: str,
               rows: int | None = None) -> DataFrame:
    """``big`` semi- or anti-joined with the distinct ``on`` keys of ``keys_df``.

    Broadcast when the counted keys fit the budget (the big side is filtered
    where it is read), a shuffle join otherwise.
    """
    assert how in ("left_semi", "left_anti")
    keys = keys_df.select(*on).distinct()
    if not keys_df.isStreaming:
        keys = maybe_broadcast(keys, keys_df.count() if rows is None else rows)
    return big.join(keys, on, how)


def split_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys on the left AQE can split; ``right`` is unique per key.

    A side that was just grouped by the key is already dealt out by it, and
    Spark then leaves its partitions whole.  A second key column derived from
    the first makes both sides exchanges of this join alone.
    """
    again = "__again"
    return left.withColumn(again, F.xxhash64(*on)).join(
        right.withColumn(again, F.xxhash64(*on)), [*on, again], how).drop(again)
