"""Exact decision trees, grown level by level (M-5, M-6, A-1; R-3, R-4).

Every threshold between two neighbouring values is tried (no bins), and every
tie has a rule, so the same rows give the same tree on any cluster, and SQL can
state it.  Classification splits by Gini impurity, regression by the squared
error left.

* numeric feature: left if ``x <= threshold``; a null goes right;
* categorical feature: one indicator per category, ``column=value``; right if equal;
* the split with the lowest remaining impurity (to 1e-9) wins, then the lower
  name, then the lower threshold; a node splits if it is impure and any split
  leaves rows on both sides, up to ``max_depth``;
* a leaf predicts its commonest class (ties: the first by name), or its mean.

Rows of equal features and target are one cell with a count, made once.  A
level is one set of jobs whatever the number of nodes: counts per (node,
feature, value, class), running totals over them by range (no node, feature or
class in one task), one best split per node.  The nodes of a level, at most
``2 ** depth`` rows, are all that reaches the driver, and go back as a broadcast.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import checkpoint
from .ranking import running_totals
from .sizing import split_join

CLASSIFY, REGRESS = "classify", "regress"
#: Levels at most: what is collected and broadcast has ``2 ** MAX_LEVELS`` rows.
MAX_LEVELS = 12
NODES = ("node long, feature string, `column` string, category string, threshold double, n long, impurity double, "
         "label string, mean double")
#: Less is no impurity: it rounds to 0 at the nine places that splits are compared by.
IMPURE = 5e-10
_NODE, _Y, _N = "__node", "__y", "__n"


class Node(NamedTuple):
    """``node`` is 1 for the root and 2k, 2k + 1 for the children of k; a leaf has no ``feature``."""

    node: int
    feature: str | None
    column: str | None
    category: str | None
    threshold: float | None
    n: int
    impurity: float
    label: str | None
    mean: float | None


class Tree(NamedTuple):
    nodes: list[Node]
    kind: str
    numeric: list[str]
    categorical: list[str]
    out: str = "predicted_goal"

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(n) for n in self.nodes], NODES)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` and the prediction: a class, or for regression a number.  No shuffle: a broadcast join per level."""
        spark, at = df.sparkSession, df.withColumn(_NODE, F.lit(1).cast("long"))
        splits = [n for n in self.nodes if n.feature is not None]
        for level in range(max([n.node.bit_length() for n in splits], default=0)):
            here = [n for n in splits if n.node.bit_length() == level + 1]
            at = _descend(at, spark.createDataFrame([tuple(n) for n in here], NODES), self.numeric, self.categorical, "left")
        leaves = spark.createDataFrame([(n.node, n.label if self.kind == CLASSIFY else n.mean) for n in self.nodes],
                                       f"{_NODE} long, `{self.out}` {'string' if self.kind == CLASSIFY else 'double'}")
        return at.join(F.broadcast(leaves), _NODE, "left").select(*[f"`{c}`" for c in df.columns], self.out)


def read_tree(nodes: DataFrame, kind: str, numeric: list[str], categorical: list[str], out: str = "predicted_goal") -> Tree:
    """The tree of a stored node table (at most ``2 ** (MAX_LEVELS + 1)`` rows)."""
    names = Node._fields
    rows = nodes.select(*[f"`{c}`" for c in names]).orderBy("node").limit(2 << MAX_LEVELS).collect()
    return Tree([Node(*r) for r in rows], kind, list(numeric), list(categorical), out)


def _descend(at: DataFrame, level: DataFrame, numeric: list[str], categorical: list[str], how: str) -> DataFrame:
    """Rows of the split nodes of one level, moved to the children (``left``: other rows stay where they are)."""
    s = level.select(F.col("node").alias(_NODE), *[F.col(f"`{c}`").alias(f"__{c}") for c in ("column", "category", "threshold")])
    goes_left: Column = F.lit(None).cast("boolean")
    for c in numeric:
        goes_left = F.when(F.col("__column") == c, F.coalesce(F.col(f"`{c}`").cast("double") <= F.col("__threshold"), F.lit(False))).otherwise(goes_left)
    for c in categorical:
        goes_left = F.when(F.col("__column") == c, ~F.col(f"`{c}`").cast("string").eqNullSafe(F.col("__category"))).otherwise(goes_left)
    node = F.when(goes_left.isNull(), F.col(_NODE)).otherwise(2 * F.col(_NODE) + F.when(goes_left, 0).otherwise(1))
    return at.join(F.broadcast(s), _NODE, how).withColumn(_NODE, node).drop("__column", "__category", "__threshold")


def _checked(features: list[str], max_depth: int) -> None:
    if not features:
        raise ValueError("a tree needs a feature")
    if not 0 <= max_depth <= MAX_LEVELS:
        raise ValueError(f"max_depth is 0 to {MAX_LEVELS}: a level's nodes pass through the driver")


def grow(df: DataFrame, max_depth: int, kind: str = CLASSIFY, target: str = S.LABEL, numeric: list[str] | None = None,
         categorical: list[str] | None = None, out: str = "predicted_goal") -> Tree:
    """A tree of at most ``max_depth`` splits above a leaf on the rows of ``df`` whose target is not null.

    An empty input gives a root without rows that predicts null.
    """
    numeric = list(numeric if numeric is not None else S.NUMERIC_FEATURES)
    categorical = list(categorical if categorical is not None else S.CATEGORICAL_FEATURES)
    _checked(numeric + categorical, max_depth)
    y = F.col(f"`{target}`").cast("string" if kind == CLASSIFY else "double")
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in numeric],
                     *[F.col(f"`{c}`").cast("string").alias(c) for c in categorical], y.alias(_Y)).filter(F.col(_Y).isNotNull())
    cells = checkpoint(rows.groupBy(*numeric, *categorical, _Y).agg(F.count(F.lit(1)).alias(_N)))
    at = cells.withColumn(_NODE, F.lit(1).cast("long"))
    nodes: list[Node] = []
    for level in range(max_depth + 1):
        totals = _totals(at, kind)
        seen = totals.collect()  # at most 2 ** level rows
        # impure nodes only: the others are leaves
        impure = [r for r in seen if r["impurity"] >= IMPURE]
        best = {}
        if impure and level < max_depth:
            whole = cells.sparkSession.createDataFrame(impure, totals.schema)
            best = {r["node"]: tuple(r)[1:] for r in _best_splits(at, whole, kind, numeric, categorical).collect()}
        here = [Node(r["node"], *best.get(r["node"], (None,) * 4), r["n"], r["impurity"], r["label"], r["mean"])
                for r in sorted(seen, key=lambda r: r["node"])]
        nodes += here
        split = [tuple(n) for n in here if n.feature is not None]
        if not split:
            break
        at = _descend(at, cells.sparkSession.createDataFrame(split, NODES), numeric, categorical, "inner")
    return Tree(nodes or [Node(1, None, None, None, None, 0, 0.0, None, None)], kind, numeric, categorical, out)


def _totals(at: DataFrame, kind: str) -> DataFrame:
    """node, n, impurity, label, mean of each node, and what a split's other side is told by: sq (or s and q)."""
    if kind == CLASSIFY:
        t = at.groupBy(F.col(_NODE).alias("node"), _Y).agg(F.sum(_N).alias("t"))
        x = F.col("t").cast("double")
        got = t.groupBy("node").agg(F.sum("t").alias("n"), F.sum(x * x).alias("sq"),
                                    F.min(F.struct((-F.col("t")).alias("less"), F.col(_Y).alias("label"))).alias("m"))
        n = F.col("n").cast("double")
        return got.select("node", "n", ((n - F.col("sq") / n) / n).alias("impurity"), "m.label",
                          F.lit(None).cast("double").alias("mean"), "sq")
    n, y = F.col(_N), F.col(_Y)
    got = at.groupBy(F.col(_NODE).alias("node")).agg(F.sum(n).alias("n"), F.sum(n * y).alias("s"), F.sum(n * y * y).alias("q"))
    n, s = F.col("n").cast("double"), F.col("s")
    return got.select("node", "n", ((F.col("q") - s * s / n) / n).alias("impurity"), F.lit(None).cast("string").alias("label"),
                      (s / n).alias("mean"), "s", "q")


def _best_splits(at: DataFrame, impure: DataFrame, kind: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """node, feature, column, category, threshold of the best split of each node of ``impure`` that has one."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("num"), F.lit(None).cast("string").alias("cat")) for c in numeric]
    pairs += [F.struct(F.lit(c).alias("column"), F.lit(None).cast("double").alias("num"), F.col(f"`{c}`").alias("cat")) for c in categorical]
    measures = [F.col(_N).alias("n")]
    if kind == REGRESS:
        measures += [(F.col(_N) * F.col(_Y)).alias("s"), (F.col(_N) * F.col(_Y) * F.col(_Y)).alias("q")]
    names = [m for m in ("n", "s", "q") if m == "n" or kind == REGRESS]
    keys = ["node", "column", "num", "cat"] + ([_Y] if kind == CLASSIFY else [])
    stacked = at.select(F.col(_NODE).alias("node"), _Y, *measures, F.inline(F.array(*pairs)))
    # at most 2 ** depth nodes: the size of the broadcast is bounded by the depth
    counts = checkpoint(stacked.join(F.broadcast(impure.select("node")), "node", "left_semi").filter(
        F.col("num").isNotNull() | F.col("cat").isNotNull()).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in names]))
    sides = _class_sides if kind == CLASSIFY else _value_sides
    cand = sides(at, counts.filter(F.col("num").isNotNull()), counts.filter(F.col("cat").isNotNull()), impure)
    n_left, n_right = F.col("n_left"), F.col("n_right")
    feature = F.when(F.col("category").isNull(), F.col("column")).otherwise(F.concat("column", F.lit("="), "category"))
    scored = cand.filter((n_left > 0) & (n_right > 0)).select(
        "node", feature.alias("feature"), "column", "category", "threshold",
        F.round((F.col("loss_left") + F.col("loss_right")) / (n_left + n_right), 9).alias("left_over"))
    picked = scored.groupBy("node").agg(F.min(F.struct("left_over", "feature", "threshold", "column", "category")).alias("b"))
    return picked.select("node", "b.feature", "b.column", "b.category", "b.threshold")


def _next_values(cum: DataFrame) -> DataFrame:
    """Running totals of (node, column, value) rows with ``threshold``, halfway to the next value; the last has none."""
    nxt = cum.select("node", "column", (F.col("_rank") - 1).alias("_rank"), F.col("num").alias("_next"))
    return cum.join(nxt, ["node", "column", "_rank"]).withColumn("threshold", (F.col("num") + F.col("_next")) / 2)


_SIDES = ["node", "column", "category", "threshold", "n_left", "n_right", "loss_left", "loss_right"]


def _class_sides(at: DataFrame, numbers: DataFrame, cats: DataFrame, impure: DataFrame) -> DataFrame:
    """Rows and Gini loss on both sides of every split.

    A class with L rows before a value and n at it, of T in the node, adds
    2 L n + n^2 to the left sum of squares and takes 2 (T - L) n - n^2 from the
    right one, so no list of classes is needed.
    """
    classes = at.groupBy(F.col(_NODE).alias("node"), _Y).agg(F.sum(_N).alias("t"))
    whole = impure.select("node", F.col("n").cast("double").alias("n_all"), "sq")
    before = split_join(running_totals(numbers, ["node", "column", _Y], ["num"], ["n"], ["upto"]), classes, ["node", _Y])
    n, left, total = F.col("n").cast("double"), (F.col("upto") - F.col("n")).cast("double"), F.col("t").cast("double")
    per_value = before.groupBy("node", "column", "num").agg(
        F.sum("n").alias("n"), F.sum(2 * left * n + n * n).alias("gain"), F.sum(2 * (total - left) * n - n * n).alias("loss"),
        F.lit(1).alias("_one"))
    cum = running_totals(per_value, ["node", "column"], ["num"], ["n", "gain", "loss", "_one"], ["n_l", "sq_l", "lost", "_rank"])
    steps = _next_values(cum).join(F.broadcast(whole), "node").select(
        "node", "column", F.lit(None).cast("string").alias("category"), "threshold", F.col("n_l").cast("double").alias("n_left"),
        (F.col("n_all") - F.col("n_l")).alias("n_right"), F.col("sq_l").alias("sq_left"), (F.col("sq") - F.col("lost")).alias("sq_right"))
    per_cat = split_join(cats, classes, ["node", _Y]).groupBy("node", "column", "cat").agg(
        F.sum("n").cast("double").alias("n_right"), F.sum(n * n).alias("sq_right"), F.sum(2 * total * n - n * n).alias("lost"))
    equal = per_cat.join(F.broadcast(whole), "node").select(
        "node", "column", F.col("cat").alias("category"), F.lit(0.5).alias("threshold"),
        (F.col("n_all") - F.col("n_right")).alias("n_left"), "n_right", (F.col("sq") - F.col("lost")).alias("sq_left"), "sq_right")
    both = steps.unionByName(equal)
    return both.withColumns({f"loss_{side}": F.col(f"n_{side}") - F.col(f"sq_{side}") / F.nullif(F.col(f"n_{side}"), F.lit(0.0))
                             for side in ("left", "right")}).select(*_SIDES)


def _value_sides(at: DataFrame, numbers: DataFrame, cats: DataFrame, impure: DataFrame) -> DataFrame:
    """Rows and squared error on both sides of every split, from running sums of 1, y and y squared."""
    whole = impure.select("node", F.col("n").cast("double").alias("n_all"), F.col("s").alias("s_all"), F.col("q").alias("q_all"))
    cum = running_totals(numbers.withColumn("_one", F.lit(1)), ["node", "column"], ["num"], ["n", "s", "q", "_one"],
                         ["n_l", "s_l", "q_l", "_rank"])
    steps = _next_values(cum).select("node", "column", F.lit(None).cast("string").alias("category"), "threshold",
                                     *[F.col(f"{m}_l").cast("double").alias(f"{m}_left") for m in "nsq"])
    steps = steps.join(F.broadcast(whole), "node").withColumns(
        {f"{m}_right": F.col(f"{m}_all") - F.col(f"{m}_left") for m in "nsq"})
    equal = cats.select("node", "column", F.col("cat").alias("category"), F.lit(0.5).alias("threshold"),
                        *[F.col(m).cast("double").alias(f"{m}_right") for m in "nsq"])
    equal = equal.join(F.broadcast(whole), "node").withColumns(
        {f"{m}_left": F.col(f"{m}_all") - F.col(f"{m}_right") for m in "nsq"})
    both = steps.unionByName(equal)
    return both.withColumns({f"loss_{side}": F.col(f"q_{side}") - F.col(f"s_{side}") * F.col(f"s_{side}") / F.nullif(F.col(f"n_{side}"), F.lit(0.0))
                             for side in ("left", "right")}).select(*_SIDES)


def accuracy(scored: DataFrame, target: str = S.LABEL, predicted: str = "predicted_goal") -> DataFrame:
    """A-1: n_test, n_correct and accuracy of the rows whose target is known."""
    known = scored.filter(F.col(f"`{target}`").isNotNull())
    hit = F.coalesce(F.col(f"`{predicted}`") == F.col(f"`{target}`"), F.lit(False))
    return known.agg(F.count(F.lit(1)).alias("n_test"), F.count_if(hit).alias("n_correct"), F.avg(hit.cast("double")).alias("accuracy"))


def errors(scored: DataFrame, target: str, predicted: str, by: list[str]) -> DataFrame:
    """R-3: n, mean squared and mean absolute error per ``by``, of the rows whose target is known."""
    miss = F.col(f"`{predicted}`") - F.col(f"`{target}`").cast("double")
    return scored.filter(F.col(f"`{target}`").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(miss * miss).alias("mse"), F.avg(F.abs(miss)).alias("mae"))
