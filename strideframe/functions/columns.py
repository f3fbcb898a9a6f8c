"""Column expressions (JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ordinal(c, mapping: dict | None = None) -> Column:
    """P-2: map a category to its rank; unknown or null give null."""
    mapping = mapping or S.INTENSITY_ORDINAL
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    # try_element_at: a key miss is null even in ANSI mode.
    return F.try_element_at(m, col_(c))


def display_label(c) -> Column:
    """P-9: ``bench_press`` -> ``Bench Press``."""
    return F.initcap(F.replace(col_(c), F.lit("_"), F.lit(" ")))


def result_line(workout_type, equipment, goal) -> Column:
    """P-8: the scoring result line."""
    return F.format_string(S.RESULT_LINE_FORMAT, col_(workout_type), col_(equipment), col_(goal))


def normalize_email(c) -> Column:
    """Lower-case the domain part, keep the local part as written."""
    e = col_(c)
    return F.when(
        F.instr(e, "@") > 0,
        F.concat(F.substring_index(e, "@", 1), F.lit("@"), F.lower(F.substring_index(e, "@", -1))),
    ).otherwise(e)


def md5_bucket(c, buckets: int = 100) -> Column:
    """Stable bucket in [0, buckets) from the first 32 bits of md5(key).

    Independent of partitioning and of the engine (DuckDB gives the same).
    """
    h = F.conv(F.substring(F.md5(col_(c).cast("string")), 1, 8), 16, 10).cast("bigint")
    return h % F.lit(buckets)


def epoch_seconds(c) -> Column:
    """Whole seconds since the epoch of a timestamp (NTZ or LTZ)."""
    return F.unix_seconds(col_(c).cast("timestamp"))
