"""Streaks, pauses and changes by week against a plain version; one hot user."""

import datetime as dt
import random

from pyspark.sql import functions as F

from strideframe.operators import stats as ST

DDL = "user_id long, workout_date date, duration_min int"


def plain(rows):
    weeks = {}
    for user, day, minutes in rows:
        if user is not None and day is not None:
            at = weeks.setdefault((user, day - dt.timedelta(day.weekday())), [0, 0])
            at[0] += 1
            at[1] += minutes or 0
    progress, streaks = [], {}
    for user in {u for u, _ in weeks}:
        mine = sorted(w for u, w in weeks if u == user)
        total = run = 0
        runs, pauses = [], [0]
        for k, week in enumerate(mine):
            n, minutes = weeks[user, week]
            total += minutes
            gap = (week - mine[k - 1]).days // 7 - 1 if k else None
            if gap == 0:
                run += 1
                runs[-1][0] += 1
            else:
                run = 1
                runs.append([1, week])
                pauses.append(gap or 0)
            progress.append((user, week, n, minutes, total, run, gap, minutes - weeks[user, mine[k - 1]][1] if k else None))
        best = min(runs, key=lambda r: (-r[0], r[1]))
        streaks[user] = (len(mine), len(runs), best[0], best[1], max(pauses))
    return sorted(progress), sorted((u, *s) for u, s in streaks.items())


def test_progress_and_streaks_equal_the_plain_version(spark):
    r = random.Random(4)
    first = dt.date(2023, 12, 20)
    rows = [(r.choice([1, 2, 3, None]), None if r.random() < 0.05 else first + dt.timedelta(r.randrange(200)),
             r.choice([None, 10, 30])) for _ in range(120)]
    # one user with most logs, every second week for years
    rows += [(9, first + dt.timedelta(14 * (k % 300)), 5) for k in range(2000)] + [(8, dt.date(1960, 1, 4), 1), (8, dt.date(1960, 1, 11), 2)]
    df = spark.createDataFrame(rows, DDL)
    progress, streaks = plain(rows)
    assert sorted(map(tuple, ST.user_progress(df).collect())) == progress
    assert sorted(map(tuple, ST.user_streaks(df).collect())) == streaks
    assert ST.user_streaks(df.filter("false")).count() == 0 and ST.user_progress(df.filter("false")).count() == 0


def test_one_hot_user_is_spread_over_tasks(spark):
    """600 training weeks of one user: no partition of the ranked weeks holds them all."""
    df = spark.range(600).select(F.lit(1).cast("long").alias("user_id"),
                                 F.date_add(F.lit("2000-01-03").cast("date"), (F.col("id") * 7).cast("int")).alias("workout_date"),
                                 F.lit(5).alias("duration_min"))
    got = ST.user_progress(df)
    assert got.agg(F.max("streak_week")).first()[0] == 600
    ranked = ST._training_weeks(df)
    most = ranked.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 600
