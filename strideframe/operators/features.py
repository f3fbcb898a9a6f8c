"""Feature table and feature encodings of the goal model (J-5, P-1..P-4,
A-2, A-3, M-1..M-4).

Each encoding exists twice: as plain columns (checked against SQL) and as
``pyspark.ml`` stages for training and scoring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import md5_bucket, ordinal
from ..session import checkpoint
from .ranking import running_totals
from .sizing import split_join


def training_frame(logs: DataFrame, users: DataFrame) -> DataFrame:
    """J-5: logs ⋈ users: the five features, the target, and the keys.

    Inner join on the owner.  Spark broadcasts ``users`` only when its
    measured size is under the broadcast threshold (AQE); otherwise it is a
    shuffle join on ``user_id`` and AQE splits a skewed owner's partition.
    """
    u = users.select(F.col("id").alias("user_id"), "goal", "equipment")
    return logs.select("id", "user_id", "workout_type", "intensity", "duration_min",
                       "calories_burned").join(u, "user_id").select(
        "id", "user_id", "workout_type", "equipment", "intensity",
        "duration_min", "calories_burned", "goal")


def select_features(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """P-1: the five features and the target (a missing column is an error)."""
    return df.select(*keys, "workout_type", "equipment", "intensity", "duration_min",
                     "calories_burned", S.LABEL)


def with_ordinal(df: DataFrame, col: str = "intensity", out: str = "intensity_numeric") -> DataFrame:
    """P-2 + P-3: ordinal-encode intensity and drop the source column."""
    return df.withColumn(out, ordinal(col)).drop(col)


def split(df: DataFrame, key: str = "id", test_percent: int = S.TEST_PERCENT) -> DataFrame:
    """M-1: add ``part`` = test / train from a stable hash bucket of ``key``.

    Disjoint, complete, and the same for any partitioning or engine.  Keying
    on ``user_id`` keeps all logs of a user on one side (goal is a user
    attribute, so a per-log split leaks it).
    """
    return df.withColumn(
        "part", F.when(md5_bucket(key) < test_percent, F.lit("test")).otherwise(F.lit("train")))


def standardize(df: DataFrame, cols: list[str], fit: DataFrame | None = None,
                suffix: str = "_scaled") -> DataFrame:
    """A-2: ``(x - mean) / stddev_pop`` with mean and deviation from ``fit``.

    A zero (or undefined) deviation divides by 1; null stays null.  The
    statistics are one scalar subquery: one aggregate job, no join.
    """
    fit = fit if fit is not None else df
    # All statistics in one aggregate; every reference below is the same
    # scalar subquery, which Spark computes once.
    stats = fit.select(F.struct(*[
        e for c in cols for e in (F.avg(F.col(c).cast("double")).alias(f"m_{c}"),
                                  F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}"))
    ]).alias("s")).scalar()
    out = df
    for c in cols:
        mean, sd = stats.getField(f"m_{c}"), stats.getField(f"s_{c}")
        denom = F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
        out = out.withColumn(c + suffix, (F.col(c).cast("double") - mean) / denom)
    return out


def vocabulary(df: DataFrame, cols: list[str]) -> DataFrame:
    """A-3: (feature, value, index) with values sorted ascending per feature.

    Values come from a distinct (partially aggregated); the index is a running
    count per feature, so a feature with very many values is not one task.
    Null is not a category.
    """
    # one pass: every row emits one (feature, value) pair per column
    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols])))
    distinct = stacked.filter(F.col("value").isNotNull()).distinct().withColumn("_one", F.lit(1))
    ranked = running_totals(distinct, ["feature"], ["value"], ["_one"], ["_cum"])
    return ranked.select("feature", "value", (F.col("_cum") - 1).alias("index"))


def one_hot(df: DataFrame, col: str, fit: DataFrame | None = None, as_text: bool = True) -> DataFrame:
    """M-3 in column form: slot of the category in the sorted vocabulary of
    ``fit`` and the width; ``as_text`` adds the 0/1 vector as text (an output
    format for few categories).  Unseen and null give no slot (all zeros),
    like the reference's ``handle_unknown='ignore'``.

    The rows meet the vocabulary (unique per category) in a join that Spark can split.
    """
    fit = fit if fit is not None else df
    # materialised: the vocabulary is numbered once, for the width and the join
    vocab = checkpoint(vocabulary(fit, [col]))
    slot, width, key = F.col(f"{col}_slot"), F.col(f"{col}_width"), f"_key_{col}"
    slots = vocab.select(F.col("value").alias(key), F.col("index").cast("int").alias(f"{col}_slot"))
    out = split_join(df.withColumn(key, F.col(col).cast("string")), slots, [key], "left").drop(key)
    out = out.withColumn(f"{col}_width", F.lit(vocab.count()).cast("int"))
    if not as_text:
        return out
    places = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    return out.withColumn(f"{col}_onehot", F.array_join(
        F.transform(places, lambda i: F.when(i == slot, F.lit("1")).otherwise(F.lit("0"))), ","))


def feature_stages(numeric: list[str] | None = None, categorical: list[str] | None = None,
                   features_col: str = "features"):
    """M-2..M-4: impute + scale numeric, index + one-hot categorical, assemble.

    * numeric: cast to double, mean-impute (a null would make the scaler's
      statistics NaN), assemble, ``StandardScaler(withMean=True)``;
    * categorical: ``StringIndexer(alphabetAsc, handleInvalid='keep')`` then
      ``OneHotEncoder(dropLast=True)``: unseen and null drop into the extra
      last slot, which is dropped, so they encode as all zeros.
    """
    from pyspark.ml.feature import (Imputer, OneHotEncoder, StandardScaler, StringIndexer,
                                    VectorAssembler)

    numeric = list(numeric if numeric is not None else S.NUMERIC_FEATURES)
    categorical = list(categorical if categorical is not None else S.CATEGORICAL_FEATURES)
    stages = []
    parts = []
    if numeric:
        imputed = [f"_imp_{c}" for c in numeric]
        stages.append(Imputer(strategy="mean", inputCols=[f"_dbl_{c}" for c in numeric],
                              outputCols=imputed))
        stages.append(VectorAssembler(inputCols=imputed, outputCol="_num_vec"))
        stages.append(StandardScaler(inputCol="_num_vec", outputCol="_num_scaled",
                                     withMean=True, withStd=True))
        parts.append("_num_scaled")
    if categorical:
        idx = [f"_idx_{c}" for c in categorical]
        ohe = [f"_ohe_{c}" for c in categorical]
        stages.append(StringIndexer(inputCols=categorical, outputCols=idx,
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True))
        parts.extend(ohe)
    stages.append(VectorAssembler(inputCols=parts, outputCol=features_col))
    return stages
