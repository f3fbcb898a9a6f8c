"""Record tables and request batches derived from the driver's tables.

The reference ships no data, so every input here is a view over the given
Parquet tables (``customer``, ``nation``, ``region``, ``events``) and grows
with them.  Each view has a DuckDB twin in ``strideframe.plans.oracle``.

``nation`` (25 rows) and ``region`` (5 rows) have a fixed size by the TPC-H
definition, so they are the only sides broadcast without a runtime check.
"""

from __future__ import annotations

import functools
import os
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixture value maps (fixed values of this test-data design).  Event types
# and regions are mapped onto the reference's workout types and equipment so
# training and scoring see the vocabulary the scoring check accepts; market
# segments become goals.
EVENT_TYPE_TO_WORKOUT = {
    "click": "running",
    "view": "yoga",
    "purchase": "deadlift",
    "signup": "cycling",
    "error": "bench_press",
}
REGION_TO_EQUIPMENT = {
    "AFRICA": "full_gym",
    "AMERICA": "home_gym",
    "ASIA": "yoga_mat",
    "EUROPE": "none",
    "MIDDLE EAST": "kettlebell",
}
SEGMENT_TO_GOAL = {
    "AUTOMOBILE": "gain_muscle",
    "BUILDING": "lose_weight",
    "FURNITURE": "endurance",
    "HOUSEHOLD": "flexibility",
    "MACHINERY": "general_fitness",
}
FIXTURE_EPOCH = "2024-01-01 00:00:00"
# Timestamp used as "now" by the change operators in the registered queries.
FIXTURE_NOW = "2025-01-01 00:00:00"


# Views defined so far, per live session (entries go with their session).
_VIEWS: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def _views(spark: SparkSession) -> dict:
    return _VIEWS.setdefault(spark, {})


def per_session(builder):
    """Define a view once per (session, folder) and reuse the DataFrame.

    The driver's tables are read-only, so a resolved plan (file listing,
    schema) stays valid for the session; no data is cached.
    """
    @functools.wraps(builder)
    def wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
        views = _views(spark)
        key = (builder.__name__, os.path.abspath(sf_dir))
        if key not in views:
            views[key] = builder(spark, sf_dir)
        return views[key]
    return wrapper


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    views = _views(spark)
    key = ("table:" + name, os.path.abspath(sf_dir))
    if key not in views:
        views[key] = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return views[key]


def _case(col: str, mapping: dict, default=None):
    expr = None
    for k, v in mapping.items():
        cond = F.col(col) == F.lit(k)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    return expr.otherwise(F.lit(default))


@per_session
def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """users = customer ⋈ nation ⋈ region."""
    region = table(spark, sf_dir, "region")
    nation = table(spark, sf_dir, "nation")
    geo = F.broadcast(
        nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)
        .select(F.col("n_nationkey"), F.col("r_name"))
    )
    cust = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    epoch = F.lit(FIXTURE_EPOCH).cast("timestamp_ntz")
    return (
        cust.join(geo, cust.c_nationkey == geo.n_nationkey)
        .select(
            F.col("c_custkey").alias("id"),
            F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("."))),
                     F.lit("@example.com")).alias("email"),
            (F.col("c_acctbal") >= 0).alias("is_active"),
            (F.lit(18) + F.col("c_custkey") % 60).cast("int").alias("age"),
            _case("c_mktsegment", SEGMENT_TO_GOAL).alias("goal"),
            _case("r_name", REGION_TO_EQUIPMENT).alias("equipment"),
            epoch.alias("created_at"),
            epoch.alias("updated_at"),
        )
    )


@per_session
def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """logs = events, one log per event."""
    return logs_from_events(table(spark, sf_dir, "events"))


def logs_from_events(ev: DataFrame) -> DataFrame:
    """The log view of an events frame (batch or stream)."""
    v = F.col("value")
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("user_id"),
        F.col("ts").cast("date").alias("workout_date"),
        F.expr("try_cast(get_json_object(props, '$.k') as int)").alias("duration_min"),
        F.when(v < 10, "very_low").when(v < 30, "low").when(v < 80, "moderate")
        .otherwise("high").alias("intensity"),
        _case("event_type", EVENT_TYPE_TO_WORKOUT, "other").alias("workout_type"),
        v.alias("calories_burned"),
        F.col("ts").alias("created_at"),
        F.col("ts").alias("updated_at"),
    )


@per_session
def new_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create requests: every event re-submitted as a request body.

    ``workout_date`` is text (as sent); every 13th has a bad month, every 19th
    a non-positive duration, every 23rd a non-positive calorie count.
    """
    return new_logs_from(logs(spark, sf_dir))


def new_logs_from(lg: DataFrame) -> DataFrame:
    """Create requests from a log frame (batch or stream)."""
    i = F.col("id")
    return lg.select(
        i.alias("seq"),
        F.col("user_id"),
        F.when(i % 13 == 5, F.lit("2025-13-01"))
        .otherwise(F.date_format("workout_date", "yyyy-MM-dd")).alias("workout_date"),
        F.when(i % 19 == 4, F.lit(0)).otherwise(F.col("duration_min")).alias("duration_min"),
        F.col("intensity"),
        F.col("workout_type"),
        F.when(i % 23 == 6, F.lit(0.0)).otherwise(F.col("calories_burned")).alias("calories_burned"),
    )


@per_session
def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patch requests: one per log.

    Wrong owner when ``id % 30 = 0``; ``duration_min + 1`` always sent;
    intensity ``high`` when ``id % 20 = 0``; explicit null intensity when
    ``id % 50 = 10`` (wins over ``high``); an ignored ``equipment_used`` key
    when ``id % 70 = 0``.
    """
    lg = logs(spark, sf_dir)
    i = F.col("id")
    intensity_part = (F.when(i % 50 == 10, F.lit(', "intensity": null'))
                      .when(i % 20 == 0, F.lit(', "intensity": "high"'))
                      .otherwise(F.lit("")))
    extra = F.when(i % 70 == 0, F.lit(', "equipment_used": "mat"')).otherwise(F.lit(""))
    body = F.concat(F.lit('{"duration_min": '), (F.col("duration_min") + 1).cast("string"),
                    intensity_part, extra, F.lit("}"))
    return lg.select(
        i.alias("seq"),
        i.alias("id"),
        F.when(i % 30 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
        body.alias("body"),
    )


@per_session
def deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete requests: one per log; wrong owner when ``id % 3 = 0``."""
    lg = logs(spark, sf_dir)
    i = F.col("id")
    return lg.select(
        i.alias("seq"), i.alias("id"),
        F.when(i % 3 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
    )


@per_session
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixed, ordered change list over the log table.

    Every log gets requests; in order (``seq = 8 id + k``):

    * k=0 patch: duration + 5, type ``yoga``;
    * k=1 delete when ``id % 15 = 0`` (wrong owner when ``id % 45 = 0``);
    * k=2 patch: intensity ``low`` and type ``running``, or an explicit null
      intensity when ``id % 25 = 0``;
    * k=3 create of a new log ``-id`` when ``id % 20 = 0``; an unknown op when
      it is 1, a null op when 2, a create with a wrong type when 3 to 9;
    * k=4 create reusing the stored id when ``id % 60 = 0`` (conflict);
    * k=5 patch of the new log ``-id`` when ``id % 20 = 0`` (duration + 9);
    * k=6 delete of the new log ``-id`` when ``id % 40 = 0``;
    * k=7 patch of the new log ``-id`` when ``id % 40 = 0`` (after its delete).
    """
    return changes_from(logs(spark, sf_dir))


# Create bodies with a value of the wrong type, by ``id % 20``.
_GOOD = '"workout_date": "2024-05-01", "intensity": "low", "workout_type": "yoga"'
BAD_CREATES = {
    3: '{%s, "duration_min": 30.7}' % _GOOD,
    4: '{%s, "duration_min": true}' % _GOOD,
    5: '{%s, "duration_min": 30, "calories_burned": "abc"}' % _GOOD,
    6: '{"workout_date": "2024-05-01", "workout_type": "yoga", "duration_min": 30, "intensity": 5}',
    7: '{%s, "duration_min": 30, "calories_burned": [1]}' % _GOOD,
    8: '[1, 2]',
    9: '{"workout_date": 20240501, "workout_type": "yoga", "duration_min": 30, "intensity": "low"}',
}


def changes_from(logs_df: DataFrame) -> DataFrame:
    """The change list of a log frame (batch or stream), in one pass: every
    log emits its requests as an array of structs."""
    i = F.col("id")
    uid = F.col("user_id")
    none = F.lit(None).cast("string")

    def req(k, op, id_col, user_col, body, when=None):
        r = F.struct((i * 8 + k).alias("seq"), F.lit(op).cast("string").alias("op"), id_col.alias("id"),
                     user_col.alias("user_id"), body.cast("string").alias("body"))
        return r if when is None else F.when(when, r)

    create_body = F.to_json(F.struct(
        F.date_format("workout_date", "yyyy-MM-dd").alias("workout_date"),
        (F.col("duration_min") + 1).alias("duration_min"),
        F.col("intensity"), F.col("workout_type"), F.col("calories_burned")))
    reqs = F.array(
        req(0, "patch", i, uid,
            F.concat(F.lit('{"duration_min": '), (F.col("duration_min") + 5).cast("string"),
                     F.lit(', "workout_type": "yoga"}'))),
        req(1, "delete", i, F.when(i % 45 == 0, uid + 1).otherwise(uid), none, i % 15 == 0),
        req(2, "patch", i, uid,
            F.when(i % 25 == 0, F.lit('{"intensity": null}'))
            .otherwise(F.lit('{"intensity": "low", "workout_type": "running"}'))),
        req(3, "create", -i, uid, create_body, i % 20 == 0),
        req(3, "merge", i, uid, none, i % 20 == 1),
        req(3, None, i, uid, none, i % 20 == 2),
        *[req(3, "create", -i, uid, F.lit(body), i % 20 == k) for k, body in BAD_CREATES.items()],
        req(4, "create", i, uid, create_body, i % 60 == 0),
        req(5, "patch", -i, uid,
            F.concat(F.lit('{"duration_min": '), (F.col("duration_min") + 9).cast("string"), F.lit("}")),
            i % 20 == 0),
        req(6, "delete", -i, uid, none, i % 40 == 0),
        req(7, "patch", -i, uid, F.lit('{"intensity": "high"}'), i % 40 == 0),
    )
    # absent requests are null elements: inline gives all-null rows, dropped
    return logs_df.select(F.inline(reqs)).filter(F.col("seq").isNotNull())


@per_session
def new_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration requests: one per customer, ``seq`` = key.

    * ``id % 25 = 0``: the customer's own e-mail again (conflict);
    * ``id % 25 = 7``: an e-mail of more than 255 characters;
    * ``id % 5 = 1``: ``new.<id % 97>@EXAMPLE.com`` (several requests per
      e-mail, upper-case domain; the first valid one wins), age 17 when
      ``id % 7 = 3``;
    * otherwise ``member.<id>@Example.Org`` (new; the domain is lower-cased).
    """
    u = users(spark, sf_dir)
    i = F.col("id")
    email = (F.when(i % 25 == 0, F.col("email"))
             .when(i % 25 == 7, F.concat(F.repeat(F.lit("a"), 250), F.lit("@example.org")))
             .when(i % 5 == 1, F.concat(F.lit("new."), (i % 97).cast("string"), F.lit("@EXAMPLE.com")))
             .otherwise(F.concat(F.lit("member."), i.cast("string"), F.lit("@Example.Org"))))
    age = F.when((i % 25 != 0) & (i % 5 == 1) & (i % 7 == 3), F.lit(17)).otherwise(F.col("age"))
    return u.select(i.alias("seq"), email.alias("email"), age.alias("age"), "goal", "equipment")


@per_session
def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token issues: the sign-up events."""
    ev = table(spark, sf_dir, "events")
    return ev.filter(F.col("event_type") == "signup").select(
        "user_id", F.col("ts").alias("issued_at"))


@per_session
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authenticated requests: every other event; a bad token (null user) every 25th."""
    ev = table(spark, sf_dir, "events")
    return ev.filter(F.col("event_type") != "signup").select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_id") % 25 == 0, F.lit(None).cast("long"))
        .otherwise(F.col("user_id")).alias("user_id"),
        "ts",
    )


@per_session
def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Login attempts: one per customer; unknown e-mail every 11th, bad password every 3rd."""
    u = users(spark, sf_dir)
    return u.select(
        F.col("id").alias("attempt_id"),
        F.when(F.col("id") % 11 == 0, F.lit("nobody@example.com")).otherwise(F.col("email")).alias("email"),
        (F.col("id") % 3 != 0).alias("password_ok"),
    )


@per_session
def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """training = logs ⋈ users (the feature table of the goal model)."""
    from ..operators.features import training_frame

    return training_frame(logs(spark, sf_dir), users(spark, sf_dir))


@per_session
def score_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_requests_from(logs(spark, sf_dir), users(spark, sf_dir))


def score_requests_from(lg: DataFrame, users_df: DataFrame) -> DataFrame:
    """Scoring requests: the features of every log, without the goal.

    Outside the accepted values: workout type ``HIIT`` when ``id % 40 = 3``,
    null equipment when ``id % 40 = 5``, intensity ``extreme`` when
    ``id % 40 = 7``.  Equipment ``kettlebell`` (one region) is also outside.
    """
    u = users_df.select(F.col("id").alias("user_id"), "equipment")
    i = F.col("id")
    return lg.join(u, "user_id").select(
        i.alias("request_id"),
        F.when(i % 40 == 3, F.lit("HIIT")).otherwise(F.col("workout_type")).alias("workout_type"),
        F.when(i % 40 == 5, F.lit(None).cast("string")).otherwise(F.col("equipment")).alias("equipment"),
        F.when(i % 40 == 7, F.lit("extreme")).otherwise(F.col("intensity")).alias("intensity"),
        "duration_min", "calories_burned",
    )


@per_session
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R-2: the running logs as runs: a distance, and a heart rate for six in seven."""
    i = F.col("id")
    return logs(spark, sf_dir).filter(F.col("workout_type") == "running").select(
        "id", "user_id", F.col("workout_date").alias("run_date"), (F.col("calories_burned") / 64).alias("distance_km"), "duration_min",
        F.when(i % 7 != 0, (90 + i % 80).cast("int")).alias("heart_rate"), "created_at", "updated_at")


def new_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Create requests of runs, typed; some break a rule."""
    i = F.col("id")
    return runs(spark, sf_dir).select(
        i.alias("seq"), "user_id", F.when(i % 13 == 5, F.lit("2025-13-01")).otherwise(F.date_format("run_date", "yyyy-MM-dd")).alias("run_date"),
        F.when(i % 19 == 4, F.lit(0.0)).otherwise(F.col("distance_km")).alias("distance_km"), "duration_min",
        F.when(i % 23 == 6, F.lit(-1)).otherwise(F.col("heart_rate")).alias("heart_rate"))


def run_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change list of the runs: creates, patches and deletes of each kind, with nulls and wrong types."""
    i, uid, none = F.col("id"), F.col("user_id"), F.lit(None).cast("string")

    def req(k, op, id_col, user_col, body, when=None):
        r = F.struct((i * 8 + k).alias("seq"), F.lit(op).alias("op"), id_col.alias("id"), user_col.alias("user_id"), body.alias("body"))
        return r if when is None else F.when(when, r)

    made = F.to_json(F.struct(F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), F.col("distance_km"),
                              (F.col("duration_min") + 1).alias("duration_min"), F.col("heart_rate")))
    reqs = F.array(
        req(0, "patch", i, uid, F.concat(F.lit('{"distance_km": "7.5", "duration_min": '), (F.col("duration_min") + 5).cast("string"), F.lit("}"))),
        req(1, "delete", i, F.when(i % 45 == 0, uid + 1).otherwise(uid), none, i % 15 == 0),
        req(2, "patch", i, uid, F.when(i % 25 == 0, F.lit('{"distance_km": null}')).when(i % 10 == 1, F.lit('{"heart_rate": null}'))
            .when(i % 10 == 2, F.lit('{"heart_rate": "-4"}')).when(i % 10 == 3, F.lit('{"distance_km": "fast"}'))
            .otherwise(F.lit('{"heart_rate": 120}'))),
        req(3, "create", -i, uid, made, i % 20 == 0),
        req(3, "create", -i, uid, F.lit('{"run_date": 5, "distance_km": 1, "duration_min": 1}'), i % 20 == 5),
        req(4, "create", i, uid, made, i % 60 == 0),
        req(5, "patch", -i, uid, F.concat(F.lit('{"duration_min": '), (F.col("duration_min") + 9).cast("string"), F.lit("}")), i % 20 == 0),
        req(6, "delete", -i, uid, none, i % 40 == 0))
    return runs(spark, sf_dir).select(F.inline(reqs)).filter(F.col("seq").isNotNull())
