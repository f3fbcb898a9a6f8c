"""User statistics over time (R-1, stated by the reference's plan)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .ranking import running_totals
from .sizing import split_join

#: Weeks are counted from this Monday.
FIRST_MONDAY = "1970-01-05"


def user_weekly_stats(logs: DataFrame) -> DataFrame:
    """Per user and ISO week (Monday): logs, minutes, mean calories, and the
    user's running minutes total.

    The running total is a window over the weekly aggregate, so one user's
    partition holds one row per week (bounded by the time span, not by how
    many logs the user has).
    """
    weekly = logs.groupBy(
        "user_id", F.date_trunc("week", F.col("workout_date")).cast("date").alias("week")
    ).agg(
        F.count(F.lit(1)).cast("long").alias("n_logs"),
        F.sum("duration_min").cast("long").alias("total_minutes"),
        F.avg("calories_burned").alias("avg_calories"),
    )
    w = Window.partitionBy("user_id").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    return weekly.select(
        "user_id", "week", "n_logs", "total_minutes",
        F.round("avg_calories", 6).alias("avg_calories"),
        F.sum("total_minutes").over(w).cast("long").alias("cum_minutes"),
    )


def _training_weeks(logs: DataFrame) -> DataFrame:
    """One row per user and week with a log, its rank and streak among the user's weeks.

    ``week_no`` counts Mondays; along a streak it rises with the rank, so their
    difference, ``streak``, names the streak.  Ranks are running counts by
    range: a user with many weeks is not one task.  Rows without a user or a
    date are left out.
    """
    known = logs.filter(F.col("user_id").isNotNull() & F.col("workout_date").isNotNull())
    weeks = known.groupBy("user_id", F.date_trunc("week", "workout_date").cast("date").alias("week")).agg(
        F.count(F.lit(1)).alias("n_logs"), F.coalesce(F.sum(F.col("duration_min").cast("long")), F.lit(0)).alias("total_minutes"))
    weeks = weeks.withColumn("_one", F.lit(1))
    ranked = running_totals(weeks, ["user_id"], ["week"], ["_one", "total_minutes"], ["rank", "cum_minutes"]).drop("_one")
    week_no = F.floor(F.date_diff("week", F.lit(FIRST_MONDAY).cast("date")) / 7).cast("long")
    return ranked.withColumn("week_no", week_no).withColumn("streak", F.col("week_no") - F.col("rank"))


def user_progress(logs: DataFrame) -> DataFrame:
    """R-1: each training week against the user's week before.

    ``streak_week`` is the place in a row of weeks without a gap, ``pause_weeks``
    the weeks without a log before this one, ``minutes_change`` the minutes more
    than in the user's training week before (null in the first).
    """
    weeks = checkpoint(_training_weeks(logs))
    before = weeks.select("user_id", (F.col("rank") + 1).alias("rank"), F.col("week_no").alias("_no"), F.col("total_minutes").alias("_minutes"))
    first = weeks.groupBy("user_id", "streak").agg(F.min("rank").alias("_first"))
    out = split_join(split_join(weeks, before, ["user_id", "rank"], "left"), first, ["user_id", "streak"])
    return out.select("user_id", "week", "n_logs", "total_minutes", "cum_minutes",
                      (F.col("rank") - F.col("_first") + 1).alias("streak_week"),
                      (F.col("week_no") - F.col("_no") - 1).alias("pause_weeks"),
                      (F.col("total_minutes") - F.col("_minutes")).alias("minutes_change"))


def user_streaks(logs: DataFrame) -> DataFrame:
    """R-1: per user the training weeks, streaks, the longest streak with its first week (ties: the earliest) and the longest pause.

    A pause lies between two streaks, so it follows from the streaks' ends: one
    row a streak, ranked by running counts again.
    """
    streaks = _training_weeks(logs).groupBy("user_id", "streak").agg(
        F.count(F.lit(1)).alias("weeks"), F.min("week").alias("first_week"), F.min("week_no").alias("_from"), F.max("week_no").alias("_to"))
    numbered = checkpoint(running_totals(streaks.withColumn("_one", F.lit(1)), ["user_id"], ["_from"], ["_one"], ["_rank"]))
    before = numbered.select("user_id", (F.col("_rank") + 1).alias("_rank"), F.col("_to").alias("_before"))
    rows = split_join(numbered, before, ["user_id", "_rank"], "left").withColumn("_pause", F.col("_from") - F.col("_before") - 1)
    longest = F.min(F.struct((-F.col("weeks")).alias("less"), "first_week"))
    return rows.groupBy("user_id").agg(F.sum("weeks").alias("n_weeks"), F.count(F.lit(1)).alias("n_streaks"), longest.alias("b"),
                                       F.coalesce(F.max("_pause"), F.lit(0)).cast("long").alias("longest_pause")).select(
        "user_id", "n_weeks", "n_streaks", (-F.col("b.less")).alias("longest_streak"), F.col("b.first_week").alias("longest_from"), "longest_pause")
