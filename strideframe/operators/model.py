"""Training, evaluation and scoring of the goal classifier (A-1, A-5, M-5..M-7,
P-8) with ``pyspark.ml``; the exact root split (A-5) with DataFrame ops."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.columns import ordinal, result_line
from . import features as FE
from .quality import scoring_domain
from ..session import checkpoint
from .ranking import running_totals
from .sizing import split_join

# Depth of the tree: the most that Spark's tree takes (there is no unbounded one).
MAX_DEPTH = 30
#: Weighted rows that one task of the tree's training takes, as long as there are tasks.
CELLS_PER_TASK = 50_000


class TrainedModel(NamedTuple):
    pipeline: object          # PipelineModel: casts, features, tree, class names (no label stage)
    labels: list[str]         # class names by label index


def _label_indexer(train: DataFrame, label: str):
    from pyspark.ml.feature import StringIndexer

    return StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc",
                         handleInvalid="skip").fit(train)


def _literal(x: float) -> str:
    return f"{x!r}D" if math.isfinite(x) else f"CAST('{x!r}' AS DOUBLE)"


def _counted_ends(df: DataFrame, values: dict[str, str], max_bins: int) -> dict[str, list[float]]:
    """The thresholds of Spark's candidate search over few rows: halfway between neighbouring values, all of them or
    one after about each ``1 / max_bins`` of the rows."""
    counts = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("c"), F.expr(x).alias("x")) for c, x in values.items()])))
    found: dict[str, list] = {c: [] for c in values}
    for r in counts.groupBy("c", "x").agg(F.count(F.lit(1)).alias("n")).collect():
        found[r["c"]].append((r["x"], r["n"]))
    out = {}
    for c, seen in found.items():
        seen.sort()
        few = len(seen) <= max_bins
        stride = target = sum(n for _, n in seen) / max_bins
        upto, ends = 0, []
        for (scaled, n), after in zip(seen, seen[1:]):
            upto += n
            if few or abs(upto - target) < abs(upto + after[1] - target):
                ends.append((scaled + after[0]) / 2)
                target += stride
        out[c] = ends
    return out


def _searched_ends(df: DataFrame, values: dict[str, str], scaled: str, max_bins: int, seed: int) -> dict[str, list[float]]:
    """The thresholds that Spark's tree searches among on these rows, in this layout and with this seed.

    Beyond 10,000 rows (or ``max_bins ** 2``) it draws them from rows it samples by seed and place, and does not tell
    them.  A regression of one feature on itself splits at each of them that has rows on both sides.
    """
    from pyspark.ml.feature import VectorSlicer
    from pyspark.ml.regression import DecisionTreeRegressor

    out = {}
    for i, (c, x) in enumerate(values.items()):
        one = VectorSlicer(inputCol=scaled, outputCol="_one", indices=[i]).transform(df)
        # within -1 and 1: far values do not drown the steps between near ones
        own = one.select("_one", F.expr(f"{x} / (1D + abs({x}))").alias("_own"))
        grown = DecisionTreeRegressor(featuresCol="_one", labelCol="_own", maxDepth=MAX_DEPTH, maxBins=max_bins,
                                      seed=seed).fit(own)
        out[c] = sorted({float(t) for t in re.findall(r"If \(feature 0 <= (\S+)\)", grown.toDebugString)})
    return out


def _bins(df: DataFrame, values: dict[str, str], ends: dict[str, list[float]]) -> list[str]:
    """Per numeric feature the SQL that puts the largest value of its bin in a value's place.

    ``values`` maps a column to the SQL of its scaled value, which Spark's tree compares, ``ends`` to the upper ends
    of its bins but the last.  A bin without rows goes with the next one.
    """
    def bin_of(c: str, x: str) -> str:
        return "CASE" + "".join(f" WHEN {x} <= {_literal(t)} THEN {i}" for i, t in enumerate(ends[c])) \
            + f" ELSE {len(ends[c])} END" if ends[c] else "0"

    rows = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("c"), F.expr(bin_of(c, x)).alias("b"), F.col(c).alias("v")) for c, x in values.items()])))
    largest = {(r["c"], r["b"]): r["v"] for r in rows.groupBy("c", "b").agg(F.max("v").alias("v")).collect()}
    out = []
    for c, x in values.items():
        kept = [(t, largest[c, i]) for i, t in enumerate([*ends[c], math.inf]) if (c, i) in largest]
        whens = "".join(f" WHEN {x} <= {_literal(t)} THEN {_literal(v)}" for t, v in kept[:-1])
        last = _literal(kept[-1][1] if kept else 0.0)
        out.append(f"CASE{whens} ELSE {last} END" if whens else last)
    return out


def train(df: DataFrame, max_depth: int = MAX_DEPTH, max_bins: int = 32, seed: int = 42,
          numeric: list[str] | None = None, categorical: list[str] | None = None,
          label: str = S.LABEL) -> TrainedModel:
    """M-5: fit features + decision tree (gini, seed 42) on ``df``.

    ``df`` carries raw features with ``intensity_numeric`` already encoded.
    The label indexer is fitted apart and kept out of the scoring pipeline,
    which therefore runs on rows without a goal.  Casts and class names are
    stages of it, so a saved pipeline scores by itself, whatever its features.  Spark's tree is depth-bounded
    (≤ 30) and bins numeric features; ``best_split`` gives the exact root split.

    The feature stages are fitted on all rows, and the bins are those that
    Spark's tree would make of them.  Rows of the same bins,
    categories and class are the same to the tree: they are counted, and it
    is grown on one weighted row for each.  Every level of the tree sends its
    nodes' counts once a partition, so what it shuffles grows with the number
    of such rows (at most ``max_bins`` per numeric feature times the
    categories, never more than the rows), not with rows times partitions.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import IndexToString, SQLTransformer, StandardScalerModel

    numeric = list(numeric if numeric is not None else S.NUMERIC_FEATURES)
    categorical = list(categorical if categorical is not None else S.CATEGORICAL_FEATURES)
    from pyspark import StorageLevel

    lab = _label_indexer(df, label)
    # Every stage fit is a pass over the input: keep the prepared columns
    # (memory, spilling to disk; recomputed from lineage if an executor is
    # lost) instead of re-running the join per pass.
    used = dict.fromkeys([*numeric, *categorical])
    labeled = lab.transform(df).select(*used, "_label").persist(StorageLevel.MEMORY_AND_DISK)
    casts = SQLTransformer(statement="SELECT *, " + ", ".join(
        [f"CAST(`{c}` AS DOUBLE) AS `_dbl_{c}`" for c in numeric] or ["1 AS _dbl_"]) + " FROM __THIS__")
    names = IndexToString(inputCol="_prediction", outputCol="predicted_goal", labels=list(lab.labels))
    cells = None
    try:
        stages = Pipeline(stages=[casts, *FE.feature_stages(numeric, categorical)]).fit(labeled).stages
        before, after = (stages[:2], stages[2:]) if numeric else (stages[:1], stages[1:])
        if numeric:
            imputed = [f"_imp_{c}" for c in numeric]
            scaler = next(s for s in after if isinstance(s, StandardScalerModel))
            scaled = {c: f"((`{c}` - {_literal(float(m))}) * {_literal(1 / float(sd) if sd else 0.0)})"
                      for c, m, sd in zip(imputed, scaler.mean, scaler.std)}
            ready = PipelineModel(stages).transform(labeled)
            if labeled.count() <= max(max_bins * max_bins, 10_000):
                ends = _counted_ends(ready, scaled, max_bins)
            else:
                ends = _searched_ends(ready, scaled, scaler.getOutputCol(), max_bins, seed)
            bins = _bins(ready, scaled, ends)
            before = [*before, SQLTransformer(statement=(
                f"SELECT * EXCEPT ({', '.join(f'`{c}`' for c in imputed)}), "
                + ", ".join(f"{b} AS `{c}`" for c, b in zip(imputed, bins)) + " FROM __THIS__"))]
        else:
            imputed = []
        cells = (PipelineModel(before).transform(labeled).groupBy(*imputed, *categorical, "_label")
                 .agg(F.count(F.lit(1)).cast("double").alias("_weight")).persist(StorageLevel.MEMORY_AND_DISK))
        n = cells.count()
        parts = min(n // CELLS_PER_TASK + 1, df.sparkSession.sparkContext.defaultParallelism)
        tree = DecisionTreeClassifier(featuresCol="features", labelCol="_label", weightCol="_weight",
                                      predictionCol="_prediction", probabilityCol="_probability",
                                      rawPredictionCol="_raw", impurity="gini", maxDepth=max_depth, seed=seed,
                                      # at most ``max_bins`` values a feature are left, and none is to be sampled away
                                      maxBins=max(max_bins, int(n ** 0.5) + 1),
                                      # deep trees: more nodes per pass, rows keep their node
                                      maxMemoryInMB=1024, cacheNodeIds=True)
        grown = tree.fit(PipelineModel(after).transform(cells.coalesce(parts)))
    finally:
        labeled.unpersist()
        if cells is not None:
            cells.unpersist()
    # the class names need no fit
    return TrainedModel(PipelineModel([*before, *after, grown, names]), list(lab.labels))


def predict(model, df: DataFrame, out: str = "predicted_goal") -> DataFrame:
    """Apply a fitted model (``train``'s, or one loaded from disk): ``df`` and the predicted class name."""
    scored = getattr(model, "pipeline", model).transform(df)
    return scored.select(*df.columns, F.col("predicted_goal").alias(out))


def score(requests: DataFrame, model) -> DataFrame:
    """M-7: scoring requests -> accepted / message / predicted goal / line.

    ``model`` is ``train``'s result or a loaded one.  Requests outside the
    accepted values keep the domain message.  An absent model is an error
    naming the cause.
    """
    if model is None:
        raise RuntimeError("ML model is not loaded: train or load a model before scoring")
    checked = scoring_domain(requests).withColumn("intensity_numeric", ordinal("intensity"))
    # One pass: every request goes through the pipeline (unseen and null
    # values encode safely), rejected ones keep no prediction.
    both = predict(model, checked).withColumn(
        "predicted_goal", F.when(F.col("accepted"), F.col("predicted_goal")))
    return both.withColumn(
        "result", F.when(F.col("accepted"),
                         result_line("workout_type", "equipment", "predicted_goal"))).drop(
        "intensity_numeric")


def tree_scores(train_df: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """M-5..M-7 end to end: split by owner, fit on train, predict both parts."""
    df = FE.split(FE.with_ordinal(train_df), key="user_id")
    model = train(df.filter(F.col("part") == "train"), max_depth=max_depth)
    return predict(model, df)


def split_accuracy(train_df: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """A-1 + M-6: held-out accuracy for a per-log split and a per-owner split.

    ``goal`` is a user attribute, so a per-log split puts one user's logs on
    both sides and can inflate accuracy; the per-owner split cannot.  One
    scoring pass per split.
    """
    base, parts = FE.with_ordinal(train_df), []
    for key in ("id", "user_id"):
        df = FE.split(base, key=key)
        model = train(df.filter(F.col("part") == "train"), max_depth=max_depth)
        test = predict(model, df.filter(F.col("part") == "test"))
        parts.append(test.agg(F.count(F.lit(1)).alias("n_test"),
                              F.avg((F.col("predicted_goal") == F.col(S.LABEL)).cast("double")).alias("accuracy"))
                     .select(F.lit(key).alias("split_key"), "n_test", "accuracy"))
    return parts[0].unionByName(parts[1])


def best_split(df: DataFrame, numeric: list[str] | None = None,
               categorical: list[str] | None = None, label: str = S.LABEL) -> DataFrame:
    """A-5: the best Gini split of the root, per feature and overall.

    Numeric feature: thresholds halfway between consecutive distinct values
    (left = ``x <= t``); nulls are left out of that feature's counts.
    Categorical feature: one indicator per category (``col=value``, left =
    other categories, right = this one; null counts as other), threshold 0.5.

    Counts are pre-aggregated to (feature, value, class); running class counts
    come from ``running_totals`` (no per-feature window, no list of classes),
    and the picks are grouped ``min`` over structs.  Ties: lowest
    impurity (to 1e-9), then threshold; overall, then lowest feature name.
    """
    numeric = list(numeric if numeric is not None else S.NUMERIC_FEATURES)
    categorical = list(categorical if categorical is not None else S.CATEGORICAL_FEATURES)
    labelled = df.filter(F.col(label).isNotNull())

    # One pass over the rows: counts per (feature, value, class) for every
    # feature at once, materialised (its size is the number of distinct
    # values, not of rows) and read by every step below.
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("num"),
                      F.lit(None).cast("string").alias("cat")) for c in numeric]
    pairs += [F.struct(F.lit(c).alias("feature"), F.lit(None).cast("double").alias("num"),
                       F.col(c).cast("string").alias("cat")) for c in categorical]
    stacked = labelled.select(label, F.inline(F.array(*pairs)))
    counts = checkpoint(stacked.groupBy("feature", "num", "cat", label)
                        .agg(F.count(F.lit(1)).alias("n")))
    by_class = counts.groupBy("feature", label).agg(F.sum("n").alias("t"))
    # per feature: rows and squared class counts, the same for every split
    whole = by_class.groupBy("feature").agg(
        F.sum("t").alias("n_all"), F.sum(F.col("t").cast("double") * F.col("t")).alias("sq_all"))

    # numeric features: a class has L rows before a value and n at it, so the
    # value takes 2 L n + n^2 to the left sum of squares and 2 (T - L) n - n^2
    # from the right one; no list of classes is needed.
    numbers = counts.filter(F.col("feature").isin(*numeric) & F.col("num").isNotNull()).select(
        "feature", label, F.col("num").alias("value"), "n")
    classes = numbers.groupBy("feature", label).agg(F.sum("n").alias("t"))
    before = split_join(running_totals(numbers, ["feature", label], ["value"], ["n"], ["upto"]),
                        classes, ["feature", label])
    n, left, total = F.col("n").cast("double"), (F.col("upto") - F.col("n")).cast("double"), F.col("t").cast("double")
    per_value = before.groupBy("feature", "value").agg(
        F.sum("n").alias("n"), F.sum(2 * left * n + n * n).alias("gain"),
        F.sum(2 * (total - left) * n - n * n).alias("loss"), F.lit(1).alias("_one"))
    cum = running_totals(per_value, ["feature"], ["value"], ["n", "gain", "loss", "_one"],
                         ["n_left", "sq_left", "lost", "_rank"])
    nxt = cum.select("feature", (F.col("_rank") - 1).alias("_rank"), F.col("value").alias("_next"))
    num_whole = classes.groupBy("feature").agg(
        F.sum("t").alias("n_all"), F.sum(F.col("t").cast("double") * F.col("t")).alias("sq_all"))
    cand = (cum.join(nxt, ["feature", "_rank"])          # unique (feature, rank): no growth
            .join(F.broadcast(num_whole), "feature")    # one row per feature
            .select("feature", ((F.col("value") + F.col("_next")) / 2).alias("threshold"), "n_left",
                    (F.col("n_all") - F.col("n_left")).alias("n_right"), "sq_left",
                    (F.col("sq_all") - F.col("lost")).alias("sq_right")))

    # categorical indicators: left = other categories, right = this one
    if categorical:
        cats = split_join(counts.filter(F.col("feature").isin(*categorical) & F.col("cat").isNotNull()),
                          by_class, ["feature", label])
        n, total = F.col("n").cast("double"), F.col("t").cast("double")
        per_cat = cats.groupBy("feature", "cat").agg(
            F.sum("n").alias("n_right"), F.sum(n * n).alias("sq_right"), F.sum(2 * total * n - n * n).alias("lost"))
        cand = cand.unionByName(per_cat.join(F.broadcast(whole), "feature").select(  # one row per feature
            F.concat("feature", F.lit("="), "cat").alias("feature"), F.lit(0.5).alias("threshold"),
            (F.col("n_all") - F.col("n_right")).alias("n_left"), "n_right",
            (F.col("sq_all") - F.col("lost")).alias("sq_left"), "sq_right"))

    n_left, n_right = F.col("n_left"), F.col("n_right")
    imp = ((n_left - F.col("sq_left") / n_left) + (n_right - F.col("sq_right") / n_right)) / (n_left + n_right)
    scored = cand.filter((n_left > 0) & (n_right > 0)).select(
        "feature", "threshold", n_left.cast("long").alias("n_left"), n_right.cast("long").alias("n_right"),
        imp.alias("impurity"))
    key = F.round("impurity", 9)
    per_feature = scored.groupBy("feature").agg(
        F.min(F.struct(key.alias("k"), "threshold", "impurity", "n_left", "n_right")).alias("b"))
    per_feature = per_feature.select("feature", "b.threshold", "b.impurity", "b.n_left", "b.n_right",
                                     F.col("b.k").alias("_k"))
    overall = per_feature.select(F.min(F.struct("_k", "feature")).alias("m")).select("m.feature").scalar()
    return per_feature.select(
        "feature", F.round("threshold", 6).alias("threshold"), F.round("impurity", 6).alias("impurity"),
        "n_left", "n_right", (F.col("feature") == overall).alias("best"))
