"""Identity: resolving requests and logins to users, registration with unique
e-mails, token lifetime (J-2, J-3, J-4, D-1, J-6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import rules as R
from ..functions.columns import normalize_email
from ..session import checkpoint
from .records import PUBLIC_USER_COLUMNS, ChangeResult, public_users
from .sizing import semi_filter, split_join


def resolve_principals(requests: DataFrame, users: DataFrame) -> DataFrame:
    """J-2: outcome per request: unauthorized / inactive / ok, plus the user.

    ``requests.user_id`` is the id decoded from the token (null = bad token).
    ``users.id`` is unique, so each request gives exactly one row.
    """
    u = public_users(users).select(F.col("id").alias("user_id"),
                                   *[F.col(c).alias(f"user_{c}") for c in PUBLIC_USER_COLUMNS
                                     if c != "id"])
    u = semi_filter(u, requests, ["user_id"])   # counted: narrow users when the batch is small
    j = u.join(requests, "user_id", "right")
    outcome = (F.when(F.col("user_id").isNull(), F.lit(S.UNAUTHORIZED))
               .when(F.col("user_is_active").isNull(), F.lit(S.UNAUTHORIZED))
               .when(~F.col("user_is_active"), F.lit(S.INACTIVE))
               .otherwise(F.lit(S.OK)))
    ok = outcome == S.OK
    cols = [F.when(ok, F.col(f"user_{c}")).alias(f"user_{c}") for c in PUBLIC_USER_COLUMNS if c != "id"]
    return j.select(*requests.columns, outcome.alias("outcome"), *cols)


def resolve_logins(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """J-3: ``attempts``: ``attempt_id, email, password_ok``.

    Unknown e-mail and wrong password give the same ``bad_credentials``;
    inactive users may still log in (the login path does not check it).
    The e-mail is compared exactly as sent.
    """
    u = semi_filter(users.select("email", F.col("id").alias("user_id")), attempts, ["email"])
    j = u.join(attempts, "email", "right")
    outcome = (F.when(F.col("user_id").isNull(), F.lit(S.BAD_CREDENTIALS))
               .when(~F.coalesce(F.col("password_ok"), F.lit(False)), F.lit(S.BAD_CREDENTIALS))
               .otherwise(F.lit(S.OK)))
    return j.select("attempt_id", "email", outcome.alias("outcome"),
                    F.when(outcome == S.OK, F.col("user_id")).alias("user_id"))


def accept_new_users(batch: DataFrame, users: DataFrame) -> DataFrame:
    """J-4: outcome per registration request: created / conflict / invalid.

    The e-mail is normalised (domain lower-cased) before the uniqueness
    check.  An e-mail already stored is a conflict; inside the batch the first
    arrival (lowest ``seq``) among valid requests wins.  The first arrivals
    are grouped (partially aggregated) before anything is joined, and they
    join the batch over a splittable join, so one popular e-mail is not one
    task.
    """
    b = checkpoint(R.validate(batch.withColumn("email", normalize_email("email")), R.user_rules()))
    valid = b.filter(F.size("errors") == 0)
    stored = semi_filter(users.select("email"), b, ["email"], b.count())
    first = valid.groupBy("email").agg(F.min("seq").alias("_first")).join(stored, "email", "left_anti")
    j = split_join(b, first, ["email"], "left")
    outcome = (F.when(F.size("errors") > 0, F.lit(S.INVALID))
               .when(F.col("seq") == F.col("_first"), F.lit(S.CREATED))
               .otherwise(F.lit(S.CONFLICT)))
    return j.select("seq", "email", "age", "goal", "equipment",
                    outcome.alias("outcome"), F.concat_ws(",", "errors").alias("errors"))


def register_users(batch: DataFrame, users: DataFrame, now: Column) -> ChangeResult:
    """D-1: register users; new ids ``max(id) + 1 + seq - min(seq)``.

    ``seq`` must be unique and not null within the batch: it is the arrival order.
    """
    decided = accept_new_users(batch, users)
    max_id = users.select(F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    min_seq = batch.select(F.min("seq")).scalar()
    new_id = (max_id + F.lit(1) + F.col("seq") - min_seq).cast("long")
    decided = decided.withColumn("id", F.when(F.col("outcome") == S.CREATED, new_id))
    created = decided.filter(F.col("outcome") == S.CREATED).select(
        "id", "email", F.lit(True).alias("is_active"), "age", "goal", "equipment",
        now.alias("created_at"), now.alias("updated_at"))
    table = users.select(*S.USER_COLUMNS).unionByName(created)
    return ChangeResult(table, decided.select("seq", "email", "id", "outcome", "errors"))


def live_requests(requests: DataFrame, issues: DataFrame,
                  ttl_seconds: int = S.TOKEN_TTL_SECONDS) -> DataFrame:
    """J-6: outcome per request: live / expired / unauthorized (no user id).

    A token issued at ``t`` expires at ``floor(t) + ttl`` whole seconds; a
    request at ``ts`` is served when some token of its user has
    ``t <= ts`` and ``floor(ts) <= floor(t) + ttl``.

    Time is cut into buckets of ``ttl`` seconds.  A qualifying token lies in
    the request's bucket (then ``t <= ts`` suffices) or in the bucket before
    (then its latest issue must be recent enough), never earlier.  Issues are
    aggregated to one row per (user, bucket) - earliest and latest issue - so
    the request side joins a unique key: rows never multiply, and a user
    with many tokens or requests is spread over buckets.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")

    def secs(c: str) -> Column:
        return F.timestamp_diff("SECOND", epoch, F.col(c).cast("timestamp_ntz"))

    iss = (issues.select("user_id", F.col("issued_at"), secs("issued_at").alias("_s"))
           .withColumn("_b", F.floor(F.col("_s") / ttl_seconds)))
    per_bucket = iss.groupBy("user_id", "_b").agg(
        F.min("issued_at").alias("_first_issue"), F.max("_s").alias("_last_s"))
    # Each bucket row also speaks for the *next* bucket ("latest issue
    # before"); one pass emits both, then one row per (user, bucket).
    ts_type = per_bucket.schema["_first_issue"].dataType
    both = per_bucket.select("user_id", F.inline(F.array(
        F.struct(F.col("_b").alias("_b"), F.col("_first_issue").alias("_first_issue"),
                 F.lit(None).cast("long").alias("_prev_last_s")),
        F.struct((F.col("_b") + 1).alias("_b"), F.lit(None).cast(ts_type).alias("_first_issue"),
                 F.col("_last_s").alias("_prev_last_s")))))
    lookup = both.groupBy("user_id", "_b").agg(
        F.min("_first_issue").alias("_first_issue"), F.max("_prev_last_s").alias("_prev_last_s"))
    req = requests.withColumn("_s", secs("ts")).withColumn("_b", F.floor(F.col("_s") / ttl_seconds))
    j = lookup.join(req, ["user_id", "_b"], "right")
    live = (F.coalesce(F.col("_first_issue") <= F.col("ts"), F.lit(False))
            | F.coalesce(F.col("_s") <= F.col("_prev_last_s") + ttl_seconds, F.lit(False)))
    outcome = (F.when(F.col("user_id").isNull(), F.lit(S.UNAUTHORIZED))
               .when(live, F.lit(S.LIVE)).otherwise(F.lit(S.EXPIRED)))
    return j.select(*requests.columns, outcome.alias("outcome"))
