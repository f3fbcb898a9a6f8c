"""Exact trees against a recursive version in plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strideframe.operators import tree as TR

DDL = "x double, z int, c string, d string, y string, t double"


def plain(rows, depth, regress, numeric, categorical, node=1):
    """[(node, feature, threshold, n, impurity, prediction)] of the tree on rows (dicts) whose target is ``v``."""
    def loss(part):
        n = len(part)
        if regress:
            return sum(r["v"] ** 2 for r in part) - sum(r["v"] for r in part) ** 2 / n
        return n - sum(k * k for k in Counter(r["v"] for r in part).values()) / n

    n = len(rows)
    impurity = loss(rows) / n
    guess = sum(r["v"] for r in rows) / n if regress else min(Counter(r["v"] for r in rows).items(), key=lambda x: (-x[1], x[0]))[0]
    found = []
    if depth and round(impurity, 9) > 0:
        tests = []
        for c in numeric:
            values = sorted({r[c] for r in rows if r[c] is not None})
            tests += [(c, (a + b) / 2, lambda r, c=c, t=(a + b) / 2: r[c] is not None and r[c] <= t) for a, b in zip(values, values[1:])]
        for c in categorical:
            tests += [(f"{c}={v}", 0.5, lambda r, c=c, v=v: r[c] != v) for v in {r[c] for r in rows if r[c] is not None}]
        for name, threshold, left in tests:
            a, b = [r for r in rows if left(r)], [r for r in rows if not left(r)]
            if a and b:
                found.append((round((loss(a) + loss(b)) / n, 9), name, threshold, a, b))
    if not found:
        return [(node, None, None, n, round(impurity, 6), guess)]
    _, name, threshold, a, b = min(found, key=lambda f: f[:3])
    more = [plain(part, depth - 1, regress, numeric, categorical, 2 * node + k) for k, part in enumerate((a, b))]
    return [(node, name, threshold, n, round(impurity, 6), guess), *more[0], *more[1]]


def table(seed, n):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        x, z = r.choice([None, *map(float, range(6))]), r.choice([None, 1, 2, 3])
        c, d = r.choice([None, "a", "b", "c"]), r.choice(["p", "q"])
        y = None if r.random() < 0.05 else ("hi" if (x or 0) + (c == "b") * 3 + r.random() * 2 > 3 else r.choice(["lo", "mid"]))
        rows.append((x, z, c, d, y, None if r.random() < 0.05 else float(round((x or 0) * 2 + (z or 0) + (d == "p") * 4 + r.randrange(3)))))
    return rows


@pytest.mark.parametrize("seed,regress,depth", [(1, False, 3), (2, True, 3), (3, False, 2)])
def test_tree_equals_the_plain_version(spark, seed, regress, depth):
    rows = table(seed, 160)
    target = "t" if regress else "y"
    # a third of the rows are one row
    rows += [rows[0]] * 80
    df = spark.createDataFrame(rows, DDL)
    tree = TR.grow(df, depth, TR.REGRESS if regress else TR.CLASSIFY, target, ["x", "z"], ["c", "d"], out="guess")
    dicts = [dict(zip("x z c d y t".split(), r)) | {"v": r[5 if regress else 4]} for r in rows]
    want = sorted(plain([r for r in dicts if r["v"] is not None], depth, regress, ["x", "z"], ["c", "d"]))
    got = [(n.node, n.feature, n.threshold, n.n, round(n.impurity, 6), n.mean if regress else n.label) for n in tree.nodes]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3:] for g in got] == [pytest.approx(w[3:], abs=2e-6) if regress else w[3:] for w in want]
    # every row's prediction is that of its leaf
    leaf = {n.node: n for n in tree.nodes}
    for r in tree.transform(df).collect():
        at = leaf[1]
        while at.feature is not None:
            value = r[at.column]
            left = value != at.category if at.category is not None else value is not None and value <= at.threshold
            at = leaf[2 * at.node + (not left)]
        assert r["guess"] == (at.mean if regress else at.label)


def test_ties_pure_nodes_and_empty_inputs(spark):
    # both features split alike: the lower name, then the lower threshold; the majority tie goes to the first name
    df = spark.createDataFrame([(1.0, 1, "a", "p", "u", 0.0), (2.0, 2, "b", "q", "v", 0.0)], DDL)
    tree = TR.grow(df, 5, target="y", numeric=["z", "x"], categorical=["c"])
    assert [(n.node, n.feature, n.label) for n in tree.nodes] == [(1, "c=a", "u"), (2, None, "v"), (3, None, "u")]
    assert [n.node for n in TR.grow(df, 5, TR.REGRESS, "t", ["x"], []).nodes] == [1]
    empty = TR.grow(df.filter("false"), 2, target="y", numeric=["x"], categorical=["c"])
    assert empty.nodes == [TR.Node(1, None, None, None, None, 0, 0.0, None, None)]
    assert [r["predicted_goal"] for r in empty.transform(df).collect()] == [None, None]
    assert TR.grow(df, 0, target="y", numeric=["x"], categorical=[]).nodes[0].label == "u"
    with pytest.raises(ValueError):
        TR.grow(df, 99, target="y", numeric=["x"], categorical=[])
    with pytest.raises(ValueError):
        TR.grow(df, 1, target="y", numeric=[], categorical=[])


def test_stored_tree_predicts_alike_and_levels_need_no_shuffle(spark, tmp_path):
    df = spark.createDataFrame(table(7, 120), DDL)
    tree = TR.grow(df, 3, target="y", numeric=["x", "z"], categorical=["c", "d"])
    tree.table(spark).write.parquet(str(tmp_path / "tree"))
    again = TR.read_tree(spark.read.parquet(str(tmp_path / "tree")), tree.kind, tree.numeric, tree.categorical)
    assert again == tree
    scored = again.transform(df)
    assert sorted(map(repr, scored.collect())) == sorted(map(repr, tree.transform(df).collect()))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert TR.accuracy(scored, "y").first()["n_test"] == df.filter(F.col("y").isNotNull()).count()
