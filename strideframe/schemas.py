"""Explicit schemas and the fixed values the results depend on.

Nothing here is inferred from data: every table and request record has a
declared ``StructType`` so a scan never samples files to guess types.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Record tables
# ---------------------------------------------------------------------------

USERS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("email", T.StringType(), False),
    T.StructField("is_active", T.BooleanType(), False),
    T.StructField("age", T.IntegerType(), False),
    T.StructField("goal", T.StringType(), False),
    T.StructField("equipment", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), False),
])

LOGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("workout_date", T.DateType(), False),
    T.StructField("duration_min", T.IntegerType(), False),
    T.StructField("intensity", T.StringType(), False),
    T.StructField("workout_type", T.StringType(), False),
    T.StructField("calories_burned", T.DoubleType(), True),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("updated_at", T.TimestampNTZType(), False),
])

# Columns of the log table in storage order.
LOG_COLUMNS = [f.name for f in LOGS.fields]
USER_COLUMNS = [f.name for f in USERS.fields]

# ---------------------------------------------------------------------------
# Request records (one row per request; ``seq`` is arrival order)
# ---------------------------------------------------------------------------

NEW_USERS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("email", T.StringType(), True),
    T.StructField("age", T.IntegerType(), True),
    T.StructField("goal", T.StringType(), True),
    T.StructField("equipment", T.StringType(), True),
])

NEW_LOGS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("workout_date", T.StringType(), True),
    T.StructField("duration_min", T.IntegerType(), True),
    T.StructField("intensity", T.StringType(), True),
    T.StructField("workout_type", T.StringType(), True),
    T.StructField("calories_burned", T.DoubleType(), True),
])

PATCHES = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("id", T.LongType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("body", T.StringType(), True),
])

DELETES = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("id", T.LongType(), True),
    T.StructField("user_id", T.LongType(), True),
])

# A mixed change list.  ``op`` is create / patch / delete.  A create carries
# its own ``id`` and the new row as a JSON ``body`` with the five log fields.
CHANGES = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("op", T.StringType(), True),
    T.StructField("id", T.LongType(), True),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("body", T.StringType(), True),
])

REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), True),
    T.StructField("ts", T.TimestampNTZType(), False),
])

ISSUES = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("issued_at", T.TimestampNTZType(), False),
])

LOGINS = T.StructType([
    T.StructField("attempt_id", T.LongType(), False),
    T.StructField("email", T.StringType(), True),
    T.StructField("password_ok", T.BooleanType(), True),
])

# Training CSV: every column read as text first, nulls applied, then typed.
TRAINING_TEXT = T.StructType([
    T.StructField("workout_type", T.StringType(), True),
    T.StructField("equipment", T.StringType(), True),
    T.StructField("intensity", T.StringType(), True),
    T.StructField("duration_min", T.StringType(), True),
    T.StructField("calories_burned", T.StringType(), True),
    T.StructField("goal", T.StringType(), True),
])

SCORE_REQUESTS = T.StructType([
    T.StructField("request_id", T.LongType(), False),
    T.StructField("workout_type", T.StringType(), True),
    T.StructField("equipment", T.StringType(), True),
    T.StructField("intensity", T.StringType(), True),
    T.StructField("duration_min", T.IntegerType(), True),
    T.StructField("calories_burned", T.DoubleType(), True),
])

# Rows of a change folder: the new state of a touched log, or its deletion.
LOG_CHANGES = T.StructType([
    *[T.StructField(f.name, f.dataType, True) for f in LOGS.fields],
    T.StructField("deleted", T.BooleanType(), True),
    T.StructField("change", T.LongType(), True),
])

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results)
# ---------------------------------------------------------------------------

# Ordinal encoding of intensity, used for training and for scoring.
INTENSITY_ORDINAL = {"very_low": 1, "low": 2, "moderate": 3, "high": 4}

# Accepted values at scoring time.
VALID_WORKOUT_TYPES = ["deadlift", "running", "bench_press", "yoga", "cycling"]
VALID_EQUIPMENT = ["full_gym", "home_gym", "yoga_mat", "none"]
VALID_INTENSITY = ["very_low", "low", "moderate", "high"]

# Message for a scoring request outside the accepted values.
SCORING_DOMAIN_MESSAGE = "Invalid selection for workout type, equipment, or intensity."

# Result line at scoring: workout type, equipment, predicted goal.
RESULT_LINE_FORMAT = "Input: %s, %s -> Predicted Goal: %s"

# Lifetime of an access token, whole seconds (30 minutes).
TOKEN_TTL_SECONDS = 30 * 60

# Storage limits: age range, string lengths.
AGE_MIN, AGE_MAX = 18, 120
EMAIL_MAX_LEN = 255
GOAL_MAX_LEN = 50
EQUIPMENT_MAX_LEN = 100
LOG_TEXT_MAX_LEN = 50

# Cells read as null from the training CSV (pandas' default list; exact case).
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Features of the goal model.
NUMERIC_FEATURES = ["duration_min", "calories_burned", "intensity_numeric"]
CATEGORICAL_FEATURES = ["workout_type", "equipment"]
LABEL = "goal"

# Fields a log patch may change; other keys in a patch body are ignored.
PATCHABLE_FIELDS = ["intensity", "duration_min", "workout_type"]

# Held-out share of the train/test split, in percent.
TEST_PERCENT = 20

# Outcome labels.
CREATED, CONFLICT, INVALID = "created", "conflict", "invalid"
OK, NOT_FOUND, DELETED = "ok", "not_found", "deleted"
REJECTED_NOT_NULL, REJECTED_TOO_LONG = "rejected_not_null", "rejected_too_long"
UNAUTHORIZED, INACTIVE, BAD_CREDENTIALS = "unauthorized", "inactive", "bad_credentials"
LIVE, EXPIRED = "live", "expired"
