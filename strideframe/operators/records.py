"""Reads, lookups and views of the record tables (P-5..P-7, F-1..F-5, F-8,
F-9, O-1, D-2, D-5, D-6).

Every lookup takes a *table of keys*, so one call answers many requests with
one equi-join instead of one query per request.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import rules as R
from ..session import checkpoint
from .ranking import running_totals
from .sizing import keyed_join, semi_filter

PUBLIC_USER_COLUMNS = ["id", "email", "is_active", "age", "goal", "equipment", "created_at"]
LOG_VIEW_COLUMNS = ["id", "user_id", "workout_date", "duration_min", "intensity",
                    "workout_type", "calories_burned", "created_at", "updated_at"]


def public_users(users: DataFrame) -> DataFrame:
    """P-5: users without secrets."""
    return users.select(*PUBLIC_USER_COLUMNS)


def log_view(logs: DataFrame) -> DataFrame:
    """P-6: the log output record."""
    return logs.select(*LOG_VIEW_COLUMNS)


def users_by_id(users: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """F-1: one row per key row that names an existing user (absent -> no row).

    ``keys`` may carry request columns; they are kept.  ``users.id`` is unique,
    so rows never multiply.
    """
    u = public_users(users).withColumnRenamed("id", key) if key != "id" else public_users(users)
    return keys.join(semi_filter(u, keys, [key]), key, "inner")


def users_by_email(users: DataFrame, keys: DataFrame) -> DataFrame:
    """F-2: exact, case-sensitive e-mail match."""
    return keys.join(semi_filter(public_users(users), keys, ["email"]), "email", "inner")


def logs_for_owner(logs: DataFrame, requests: DataFrame, request_rows: int | None = None) -> DataFrame:
    """F-3: row-level security.  ``requests`` has ``request_id, id, user_id``.

    A log that is absent and a log owned by someone else give the same
    outcome ``not_found``.  With ``request_rows`` (a count of ``requests``)
    under the broadcast budget the log table is narrowed to the requested
    ids by a broadcast semi-join before the join.
    """
    found = semi_filter(log_view(logs), requests, ["id"], request_rows).withColumn("_hit", F.lit(True))
    out = found.join(requests, ["id", "user_id"], "right")
    return out.select(
        "request_id", "id", "user_id",
        F.when(F.col("_hit"), F.lit(S.OK)).otherwise(F.lit(S.NOT_FOUND)).alias("outcome"),
        *[c for c in LOG_VIEW_COLUMNS if c not in ("id", "user_id")],
    )


def owner_logs(logs: DataFrame, owners: DataFrame) -> DataFrame:
    """F-4: all logs of the given owners (``owners.user_id``); empty is fine.

    The owner keys are broadcast when their count fits the budget, so the log
    table is filtered where it is read.
    """
    return keyed_join(logs, owners, ["user_id"], "left_semi")


def active_users(users: DataFrame) -> DataFrame:
    """F-5."""
    return users.filter(F.col("is_active"))


def history(logs: DataFrame, owners: DataFrame | None = None, ranked: bool = True) -> DataFrame:
    """O-1: each owner's logs newest first, with ``rank`` (1 = newest).

    Ties on ``created_at`` are broken by ``id`` descending.  Ranking uses the
    running count of ``running_totals``, so one owner with a huge history is
    spread over many tasks instead of one window partition.  ``ranked=False`` returns the rows in that order (a global
    sort, range-partitioned the same way) without ranks.
    """
    rows = log_view(owner_logs(logs, owners) if owners is not None else logs)
    if not ranked:
        return rows.orderBy("user_id", F.desc("created_at"), F.desc("id"))
    rows = rows.withColumn("_one", F.lit(1))
    out = running_totals(rows, ["user_id"], [F.desc("created_at"), F.desc("id")],
                         ["_one"], ["rank"])
    return out.drop("_one")


def user_history(logs: DataFrame, users: DataFrame) -> DataFrame:
    """Minimum slice: newest-first history of every active user's logs."""
    return history(logs, active_users(users).select(F.col("id").alias("user_id")))


def orphans(logs: DataFrame, users: DataFrame) -> DataFrame:
    """J-1: logs whose owner does not exist (the foreign key the DB enforced)."""
    return logs.join(users.select(F.col("id").alias("user_id")), "user_id", "left_anti")


def delete_users(ids: DataFrame, users: DataFrame, logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D-5: remove users and, by cascade, their logs.  ``ids.id`` names users."""
    gone = ids.select("id")
    kept_users = keyed_join(users, gone, ["id"], "left_anti")
    kept_logs = keyed_join(logs, gone.withColumnRenamed("id", "user_id"), ["user_id"], "left_anti")
    return kept_users, kept_logs


class ChangeResult(NamedTuple):
    table: DataFrame
    outcomes: DataFrame
    rewritten: DataFrame | None = None  # new state of the touched rows
    gone: DataFrame | None = None       # ids of the deleted rows
    changed: DataFrame | None = None    # both: the rewritten rows, and deleted ones (``deleted``, only the id is set)


def principal_outcome(requests: DataFrame, users: DataFrame, key: str = "user_id",
                      request_rows: int | None = None) -> DataFrame:
    """J-2 core: add ``auth`` = unauthorized / inactive / null (authorised).

    Order of the checks: no id (bad token) -> unauthorized; no user ->
    unauthorized; inactive -> inactive.  With ``request_rows`` under the
    broadcast budget, users are first narrowed to the requesting ids.
    """
    u = users.select(F.col("id").alias(key), F.col("is_active").alias("_active"))
    u = semi_filter(u, requests, [key], request_rows)
    j = u.join(requests, key, "right")
    auth = (F.when(F.col(key).isNull(), F.lit(S.UNAUTHORIZED))
            .when(F.col("_active").isNull(), F.lit(S.UNAUTHORIZED))
            .when(~F.col("_active"), F.lit(S.INACTIVE)))
    return j.withColumn("auth", auth).drop("_active")


def stamp(df: DataFrame, now: Column) -> DataFrame:
    """D-6: defaults of a new row."""
    return df.withColumn("created_at", now).withColumn("updated_at", now)


def create_logs(batch: DataFrame, logs: DataFrame, users: DataFrame, now: Column) -> ChangeResult:
    """D-2: validate, resolve the owner, assign ids, append.

    Outcome per request: unauthorized / inactive (owner check first, as the
    identity dependency runs before the body is validated), invalid (any
    broken rule, listed in ``errors``), created.  Duplicate submissions are
    two logs, as in the reference.  New ids are ``max(id) + 1 + seq - min(seq)``
    over the batch: unique, gaps allowed, no single-task numbering.
    """
    batch = checkpoint(batch)
    checked = R.validate(principal_outcome(batch, users, request_rows=batch.count()), R.log_rules())
    outcome = (F.when(F.col("auth").isNotNull(), F.col("auth"))
               .when(F.size("errors") > 0, F.lit(S.INVALID))
               .otherwise(F.lit(S.CREATED)))
    max_id = logs.select(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    min_seq = batch.select(F.min("seq")).scalar()
    new_id = (max_id + F.lit(1) + F.col("seq") - min_seq).cast("long")
    res = checked.withColumn("outcome", outcome).withColumn(
        "id", F.when(F.col("outcome") == S.CREATED, new_id))
    outcomes = res.select("seq", "user_id", "id", "outcome",
                          F.concat_ws(",", "errors").alias("errors"))
    created = stamp(res.filter(F.col("outcome") == S.CREATED).select(
        "id", "user_id",
        F.try_to_date(F.col("workout_date"), "yyyy-MM-dd").alias("workout_date"),
        "duration_min", "intensity", "workout_type", "calories_burned"), now)
    table = log_view(logs).unionByName(created.select(*LOG_VIEW_COLUMNS))
    return ChangeResult(table, outcomes)
