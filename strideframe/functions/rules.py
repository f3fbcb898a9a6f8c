"""Validation rules as column predicates (F-7, F-10).

A rule is ``(name, predicate)``; a row breaks the rule when the predicate is
false **or null**.  ``errors`` collects the names of every broken rule, so a
caller sees all problems of a row at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S

# E-mail syntax: one ``@``, no blanks, a dot in the domain.  An approximation
# of the full address grammar the reference's validator applies.
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def _len_ok(c: str, n: int) -> Column:
    return F.col(c).isNotNull() & (F.length(c) <= n)


def user_rules() -> list[tuple[str, Column]]:
    return [
        ("email_syntax", F.col("email").rlike(EMAIL_PATTERN)),
        ("email_len", F.col("email").isNull() | (F.length("email") <= S.EMAIL_MAX_LEN)),  # null: broken syntax
        ("age_range", F.col("age").between(S.AGE_MIN, S.AGE_MAX)),
        ("goal_len", _len_ok("goal", S.GOAL_MAX_LEN)),
        ("equipment_len", _len_ok("equipment", S.EQUIPMENT_MAX_LEN)),
    ]


def log_rules(date_col: str = "workout_date") -> list[tuple[str, Column]]:
    """Rules of a log create request (``workout_date`` arrives as text)."""
    return [
        ("date_parse", F.try_to_date(F.col(date_col).cast("string"), "yyyy-MM-dd").isNotNull()),
        ("duration_positive", F.col("duration_min") > 0),
        ("intensity_len", _len_ok("intensity", S.LOG_TEXT_MAX_LEN)),
        ("type_len", _len_ok("workout_type", S.LOG_TEXT_MAX_LEN)),
        ("calories_positive", F.col("calories_burned").isNull()
         | ((F.col("calories_burned") > 0) & ~F.isnan(F.col("calories_burned").cast("double")))),
    ]


def run_rules() -> list[tuple[str, Column]]:
    """Rules of a run create request (R-2; ``run_date`` arrives as text)."""
    return [
        ("date_parse", F.try_to_date(F.col("run_date").cast("string"), "yyyy-MM-dd").isNotNull()),
        ("distance_positive", (F.col("distance_km") > 0) & ~F.isnan("distance_km")),
        ("duration_positive", F.col("duration_min") > 0),
        ("heart_rate_positive", F.col("heart_rate").isNull() | (F.col("heart_rate") > 0)),
    ]


def errors_of(rules: list[tuple[str, Column]]) -> Column:
    """Array of the names of the broken rules (empty when the row is valid)."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(pred, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(name))
        for name, pred in rules
    ]))


def validate(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """F-7: add ``errors``; valid rows have an empty array."""
    return df.withColumn("errors", errors_of(rules))
