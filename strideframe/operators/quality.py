"""Data-quality operators: storage validation, scoring domain, outcome counts
(F-6, F-7, F-10, A-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import rules as R


def validate_users(df: DataFrame) -> DataFrame:
    """F-7 on user records: adds ``errors`` (array of broken rule names)."""
    return R.validate(df, R.user_rules())


def validate_logs(df: DataFrame, date_col: str = "workout_date") -> DataFrame:
    """F-7 / F-10 on log records: adds ``errors``."""
    return R.validate(df, R.log_rules(date_col))


def scoring_domain(df: DataFrame) -> DataFrame:
    """F-6: ``accepted`` and ``message`` per scoring request.

    Workout type, equipment and intensity must each be in the accepted list;
    null is outside.  One combined message, as the reference shows.
    """
    ok = (F.col("workout_type").isin(*S.VALID_WORKOUT_TYPES)
          & F.col("equipment").isin(*S.VALID_EQUIPMENT)
          & F.col("intensity").isin(*S.VALID_INTENSITY))
    accepted = F.coalesce(ok, F.lit(False))
    return df.withColumn("accepted", accepted).withColumn(
        "message", F.when(~accepted, F.lit(S.SCORING_DOMAIN_MESSAGE)))


def outcome_counts(df: DataFrame, by: str | list[str] = "outcome") -> DataFrame:
    """A-4: rows per outcome, or per (op, outcome) etc. (partially aggregated)."""
    cols = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*cols).agg(F.count(F.lit(1)).cast("long").alias("n"))
