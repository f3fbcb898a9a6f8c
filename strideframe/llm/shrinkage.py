"""Empirical-Bayes shrinkage of rates: beta priors whose strength is estimated from the groups themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strength of the prior (in observations) where the groups cannot tell it, and its bounds.
DEFAULT_STRENGTH = 10.0
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 10_000.0


def prior(groups: DataFrame, n: str, bad: str) -> tuple[float, float]:
    """(rate, strength) of the beta prior of ``groups``, a row per group with ``n`` observations, ``bad`` of them bad.

    The strength follows from the correlation within groups, estimated by
    analysis of variance of the beta-binomial.  One row of sums reaches the
    driver.  Fewer than two groups, or one observation each, tell no strength;
    without observations the rate is 0.
    """
    s = groups.filter(F.col(n) > 0).agg(
        F.count(F.lit(1)).alias("k"), F.sum(n).cast("double").alias("n"), F.sum(bad).cast("double").alias("f"),
        F.sum(F.col(n).cast("double") * F.col(n)).alias("n2"),
        F.sum(F.col(bad).cast("double") * F.col(bad) / F.col(n)).alias("f2")).first()
    k, total = s["k"], s["n"] or 0.0
    if not k or not total:
        return 0.0, DEFAULT_STRENGTH
    rate = s["f"] / total
    if k < 2 or total <= k:
        return rate, DEFAULT_STRENGTH
    between = (s["f2"] - total * rate * rate) / (k - 1)
    within = (s["f"] - s["f2"]) / (total - k)
    per_group = (total - s["n2"] / total) / (k - 1)
    scale = between + (per_group - 1) * within
    if scale <= 0:
        return rate, DEFAULT_STRENGTH
    correlation = (between - within) / scale
    if correlation <= 0:
        return rate, MOST_STRENGTH
    return rate, min(MOST_STRENGTH, max(LEAST_STRENGTH, 1 / correlation - 1))


def shrunk(n: Column, bad: Column, rate: Column, strength: float) -> Column:
    """Posterior mean of a group's rate."""
    return (F.lit(strength) * rate + bad) / (F.lit(strength) + n)


def lower_bound(n: Column, bad: Column, rate: Column, strength: float, z: float) -> Column:
    """Posterior mean less ``z`` posterior standard deviations."""
    mean = shrunk(n, bad, rate, strength)
    return mean - F.lit(z) * F.sqrt(mean * (1 - mean) / (F.lit(strength) + n + 1))


#: The same in DuckDB SQL: rate and strength of a table of groups (n, f).
PRIOR_SQL = """
SELECT CASE WHEN coalesce(k, 0) = 0 THEN 0.0 ELSE rate END AS rate,
       CASE WHEN coalesce(k, 0) < 2 OR total <= k OR scale <= 0 THEN 10.0
            WHEN (msb - msw) / scale <= 0 THEN 10000.0
            ELSE least(10000.0, greatest(1.0, 1 / ((msb - msw) / scale) - 1)) END AS strength
FROM (SELECT *, msb + ((total - n2 / total) / (k - 1) - 1) * msw AS scale
      FROM (SELECT *, f / total AS rate,
                   CASE WHEN k > 1 THEN (f2 - total * (f / total) * (f / total)) / (k - 1) END AS msb,
                   CASE WHEN total > k THEN (f - f2) / (total - k) END AS msw
            FROM (SELECT count(*) AS k, sum(n)::DOUBLE AS total, sum(f)::DOUBLE AS f,
                         sum(n::DOUBLE * n) AS n2, sum(f::DOUBLE * f / n) AS f2
                  FROM {groups} WHERE n > 0)))
"""
