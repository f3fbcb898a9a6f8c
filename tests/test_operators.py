"""Validation boundaries, identity outcomes, running totals, split, sources."""

import datetime as dt
import os
import random
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from strideframe import schemas as S
from strideframe.functions.columns import display_label, md5_bucket, normalize_email, ordinal
from strideframe.operators import features as FE
from strideframe.operators import identity as ID
from strideframe.operators import quality as QA
from strideframe.operators.ranking import running_totals
from strideframe.sources import tables as TB

T0 = dt.datetime(2024, 1, 1)


def _errors(df):
    return {r["seq"]: r["e"] for r in df.select("seq", F.concat_ws(",", "errors").alias("e")).collect()}


def test_user_rule_boundaries(spark):
    rows = [
        (1, "a@b.co", 17, "g", "e"), (2, "a@b.co", 18, "g", "e"), (3, "a@b.co", 120, "g", "e"),
        (4, "a@b.co", 121, "g", "e"), (5, "x@", 30, "g", "e"), (6, "Ann@EXAMPLE.com", 30, "g", "e"),
        (7, "a@b.co", 30, "g" * 50, "e" * 100), (8, "a@b.co", 30, "g" * 51, "e" * 101),
        (9, "a@b.co", 30, "", ""), (10, None, None, None, None),
        (11, "a" * 248 + "@b.test", 30, "g", "e"), (12, "a" * 249 + "@b.test", 30, "g", "e"),
    ]
    df = QA.validate_users(spark.createDataFrame(rows, S.NEW_USERS))
    assert _errors(df) == {
        1: "age_range", 2: "", 3: "", 4: "age_range", 5: "email_syntax", 6: "", 7: "",
        8: "goal_len,equipment_len", 9: "",
        10: "email_syntax,age_range,goal_len,equipment_len", 11: "", 12: "email_len",
    }


def test_log_rule_boundaries(spark):
    rows = [
        (1, 1, "2025-10-26", 1, "high", "HIIT", 0.01), (2, 1, "2025-10-26", 0, "high", "HIIT", None),
        (3, 1, "2025-10-26", -1, "high", "HIIT", 0.0), (4, 1, "2025-13-01", 5, "x" * 50, "y" * 51, 5.0),
    ]
    df = QA.validate_logs(spark.createDataFrame(rows, S.NEW_LOGS))
    assert _errors(df) == {1: "", 2: "duration_positive", 3: "duration_positive,calories_positive",
                           4: "date_parse,type_len"}


def test_scoring_domain_and_labels(spark):
    df = spark.createDataFrame([
        (1, "running", "none", "high", 30, 100.0), (2, "HIIT", "none", "high", 30, 100.0),
        (3, "running", None, "high", 30, 100.0), (4, "bench_press", "yoga_mat", "very_low", 30, 1.0),
    ], S.SCORE_REQUESTS)
    out = {r["request_id"]: (r["accepted"], r["message"]) for r in QA.scoring_domain(df).collect()}
    assert out[1] == (True, None) and out[4] == (True, None)
    assert out[2] == (False, S.SCORING_DOMAIN_MESSAGE) and out[3] == (False, S.SCORING_DOMAIN_MESSAGE)
    labels = df.select(display_label("workout_type").alias("l"), ordinal("intensity").alias("o")).collect()
    assert [r["l"] for r in labels] == ["Running", "Hiit", "Running", "Bench Press"]
    assert [r["o"] for r in labels] == [4, 4, 4, 1]


def test_email_normalisation_and_registration(spark):
    users = spark.createDataFrame([(1, "ann@example.com", True, 30, "g", "e", T0, T0)], S.USERS)
    batch = spark.createDataFrame([
        (1, "Ann@EXAMPLE.com", 30, "g", "e"),   # different local case: new
        (2, "ann@EXAMPLE.com", 30, "g", "e"),   # same as stored after normalising: conflict
        (3, "bob@x.io", 30, "g", "e"), (4, "bob@X.IO", 40, "g", "e"),   # twice in the batch
        (5, "bob@x.io", 17, "g", "e"),          # invalid
    ], S.NEW_USERS)
    out = {r["seq"]: (r["email"], r["outcome"]) for r in ID.accept_new_users(batch, users).collect()}
    assert out == {1: ("Ann@example.com", "created"), 2: ("ann@example.com", "conflict"),
                   3: ("bob@x.io", "created"), 4: ("bob@x.io", "conflict"), 5: ("bob@x.io", "invalid")}
    assert spark.range(1).select(normalize_email(F.lit("x@")).alias("e")).first()["e"] == "x@"


def test_principals_and_logins(spark):
    users = spark.createDataFrame([(1, "a@b.co", True, 30, "g", "e", T0, T0),
                                   (2, "c@d.co", False, 30, "g", "e", T0, T0)], S.USERS)
    req = spark.createDataFrame([(1, 1, T0), (2, 2, T0), (3, 3, T0), (4, None, T0)], S.REQUESTS)
    out = {r["request_id"]: r["outcome"] for r in ID.resolve_principals(req, users).collect()}
    assert out == {1: "ok", 2: "inactive", 3: "unauthorized", 4: "unauthorized"}
    att = spark.createDataFrame([(1, "a@b.co", True), (2, "a@b.co", False), (3, "zz@b.co", True),
                                 (4, "c@d.co", True)], S.LOGINS)
    out = {r["attempt_id"]: r["outcome"] for r in ID.resolve_logins(att, users).collect()}
    assert out == {1: "ok", 2: "bad_credentials", 3: "bad_credentials", 4: "ok"}  # inactive may log in


def test_live_requests_against_brute_force(spark):
    rng = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    issues = [(rng.randint(1, 4), base + dt.timedelta(seconds=rng.randint(0, 20000),
                                                       microseconds=rng.randint(0, 999999)))
              for _ in range(40)]
    reqs = [(i, rng.choice([1, 2, 3, 4, 5, None]),
             base + dt.timedelta(seconds=rng.randint(0, 22000), microseconds=rng.randint(0, 999999)))
            for i in range(400)]
    # exact boundaries: issued + 1800 s in the same whole second, and one second after
    t = dt.datetime(2024, 1, 2, 0, 0, 0, 500000)
    issues.append((9, t))
    reqs += [(1000, 9, t + dt.timedelta(seconds=1800, microseconds=400000)),
             (1001, 9, t + dt.timedelta(seconds=1801)), (1002, 9, t - dt.timedelta(microseconds=1))]

    def secs(x):
        return int((x - dt.datetime(1970, 1, 1)).total_seconds() // 1)

    def live(uid, ts):
        if uid is None:
            return "unauthorized"
        ok = any(u == uid and it <= ts and secs(ts) <= secs(it) + 1800 for u, it in issues)
        return "live" if ok else "expired"

    got = ID.live_requests(spark.createDataFrame(reqs, S.REQUESTS), spark.createDataFrame(issues, S.ISSUES))
    out = {r["request_id"]: r["outcome"] for r in got.collect()}
    assert out == {i: live(u, ts) for i, u, ts in reqs}
    assert out[1000] == "live" and out[1001] == "expired" and out[1002] == "expired"


def test_running_totals_hot_group_matches_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1] * 6 + [2, 3, 4]), rng.randint(0, 30), i, rng.random()) for i in range(4000)]
    df = spark.createDataFrame(rows, "g int, t int, id int, x double").withColumn("one", F.lit(1))
    w = Window.partitionBy("g").orderBy(F.desc("t"), F.desc("id"))
    ref = {r["id"]: (r["rn"], r["cx"]) for r in df.select(
        "id", F.row_number().over(w).alias("rn"),
        F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cx")).collect()}
    for n in (1, 3, 11):
        got = running_totals(df, ["g"], [F.desc("t"), F.desc("id")], ["one", "x"], ["rn", "cx"],
                             num_partitions=n)
        for r in got.collect():
            rn, cx = ref[r["id"]]
            assert r["rn"] == rn and abs(r["cx"] - cx) < 1e-9


def test_running_totals_large_ids_null_groups_and_nullable_longs(spark):
    big = 1 << 53
    rng = random.Random(4)
    rows = [(rng.choice([None, big, big + 1, big + 2]), i, rng.choice([None, big + 1, 3])) for i in range(900)]
    df = spark.createDataFrame(rows, "g long, t int, x long").withColumn("one", F.lit(1))
    exp, sums = {}, {}
    for g, t, x in rows:
        n, s = sums.get(g, (0, 0))
        sums[g] = exp[t] = (n + 1, s + (x or 0))
    for n in (1, 4, 9):
        got = running_totals(df, ["g"], ["t"], ["one", "x"], ["rn", "cx"], num_partitions=n)
        assert dict(got.dtypes)["cx"] == "bigint"
        assert {r["t"]: (r["rn"], r["cx"]) for r in got.collect()} == exp
        assert "Python" not in got._jdf.queryExecution().toString()


def test_running_totals_one_hot_group_over_partitions(spark):
    df = spark.range(0, 3000).select(F.lit(7).cast("long").alias("g"), F.col("id").alias("t"), F.lit(1).alias("one"))
    got = running_totals(df, ["g"], [F.desc("t")], ["one"], ["rn"], num_partitions=8)
    assert all(r["rn"] == 3000 - r["t"] for r in got.collect())


def test_split_is_disjoint_complete_and_stable(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "k")
    parts = [FE.split(df.repartition(n), "k").select("k", "part") for n in (1, 7)]
    a = {r["k"]: r["part"] for r in parts[0].collect()}
    b = {r["k"]: r["part"] for r in parts[1].collect()}
    assert a == b and len(a) == 5000
    share = sum(1 for v in a.values() if v == "test") / len(a)
    assert 0.17 < share < 0.23
    assert spark.range(1).select(md5_bucket(F.lit(7)).alias("b")).first()["b"] == \
        int(__import__("hashlib").md5(b"7").hexdigest()[:8], 16) % 100


def test_training_csv_null_tokens(spark):
    folder = tempfile.mkdtemp(prefix="sf-csv-")
    path = os.path.join(folder, "train.csv")
    with open(path, "w") as f:
        f.write("workout_type,equipment,intensity,duration_min,calories_burned,goal\n")
        f.write("running,none,high,30,100.5,lose_weight\n")
        f.write("yoga,None,NA,,abc,gain_muscle\n")
        f.write("cycling,n/a,low,45,NULL,\n")
    rows = TB.read_training(spark, path).collect()
    assert rows[0]["equipment"] == "none" and rows[0]["duration_min"] == 30.0
    assert rows[1]["equipment"] is None and rows[1]["intensity"] is None
    assert rows[1]["duration_min"] is None and rows[1]["calories_burned"] is None
    assert rows[2]["equipment"] is None and rows[2]["goal"] is None
    raised = False
    try:
        TB.read_training(spark, os.path.join(folder, "absent.csv"))
    except Exception:
        raised = True
    assert raised


def test_tables_are_versioned_not_overwritten(spark):
    base = tempfile.mkdtemp(prefix="sf-tab-")
    p = os.path.join(base, "logs0")
    assert TB.ensure_table(spark, p, S.LOGS) is True
    assert TB.ensure_table(spark, p, S.LOGS) is False
    df = spark.createDataFrame([(1, 1, dt.date(2024, 1, 1), 5, "low", "yoga", None, T0, T0)], S.LOGS)
    v1 = TB.write_snapshot(df, os.path.join(base, "t"), 1, cluster_by=["user_id", "id"])
    v2 = TB.write_snapshot(df.union(df), os.path.join(base, "t"), 2)
    assert TB.latest_snapshot(spark, os.path.join(base, "t")) == v2
    assert TB.read_logs(spark, v1).count() == 1
    try:
        TB.write_snapshot(df, os.path.join(base, "t"), 2)
        raised = False
    except Exception:
        raised = True
    assert raised


def test_history_distributed_path_equals_window_path(spark):
    from strideframe.operators import records as RC
    from strideframe.sources import fixtures as FX
    from conftest import SF_SMALL

    logs = FX.logs(spark, SF_SMALL)
    a = {r["id"]: r["rank"] for r in RC.history(logs).collect()}
    b = {r["id"]: r["rank"] for r in RC.history(logs).collect()}
    assert a == b and len(a) == logs.count()


def test_scale_settings():
    from strideframe.session import scale_settings

    s = scale_settings(100 * (1 << 40), cores=8000)
    assert int(s["spark.sql.shuffle.partitions"]) == 409600
    assert int(scale_settings(1000, cores=8)["spark.sql.shuffle.partitions"]) == 16


def test_broadcast_budget_and_checked_joins(spark):
    from strideframe.operators import sizing as SZ

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for raw, want in (("10485760b", 10485760), ("20MB", 20 << 20), ("1g", 1 << 30), ("-1", -1)):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", raw)
            assert SZ.broadcast_budget(spark) == want
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1kb")
        keys = spark.range(0, 100).withColumnRenamed("id", "k")
        big = spark.range(0, 1000).withColumnRenamed("id", "k")
        assert SZ.fits_broadcast(keys, 10) and not SZ.fits_broadcast(keys, 100)
        # over the budget: the anti / semi joins still run (as shuffles) and agree
        for budget in ("1kb", "10MB"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", budget)
            assert SZ.keyed_join(big, keys, ["k"], "left_semi").count() == 100
            assert SZ.keyed_join(big, keys, ["k"], "left_anti").count() == 900
            assert SZ.semi_filter(big, keys, ["k"]).join(keys, "k").count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_best_split_against_brute_force(spark):
    from strideframe.operators import model as MO

    rng = random.Random(5)
    rows = []
    for i in range(300):
        goal = rng.choice(["a", "b", "c"])
        dur = rng.randint(1, 12) + (5 if goal == "a" else 0)
        cal = None if i % 37 == 0 else round(rng.random() * 10, 1)
        rows.append((rng.choice(["run", "yoga", None]), rng.choice(["gym", "none"]), dur, cal,
                     rng.choice([1, 2, 3, 4]), goal))
    df = spark.createDataFrame(
        rows, "workout_type string, equipment string, duration_min int, calories_burned double, "
              "intensity_numeric int, goal string")
    got = {r["feature"]: r for r in MO.best_split(df).collect()}

    def gini_split(left, right):
        def imp(part):
            n = sum(part.values())
            return n - sum(v * v for v in part.values()) / n
        nl, nr = sum(left.values()), sum(right.values())
        return (imp(left) + imp(right)) / (nl + nr)

    def count(labels):
        out = {}
        for g in labels:
            out[g] = out.get(g, 0) + 1
        return out

    expected = {}
    for j, name in ((2, "duration_min"), (3, "calories_burned"), (4, "intensity_numeric")):
        pts = [(r[j], r[5]) for r in rows if r[j] is not None]
        vals = sorted({v for v, _ in pts})
        best = None
        for a, b in zip(vals, vals[1:]):
            t = (a + b) / 2
            imp = gini_split(count(g for v, g in pts if v <= t), count(g for v, g in pts if v > t))
            key = (round(imp, 9), t)
            best = key if best is None or key < best else best
        expected[name] = best
    for j, col in ((0, "workout_type"), (1, "equipment")):
        for cat in {r[j] for r in rows if r[j] is not None}:
            imp = gini_split(count(r[5] for r in rows if r[j] != cat),
                             count(r[5] for r in rows if r[j] == cat))
            expected[f"{col}={cat}"] = (round(imp, 9), 0.5)
    assert set(got) == set(expected)
    for f, (imp, t) in expected.items():
        assert abs(got[f]["impurity"] - imp) < 1e-6 and abs(got[f]["threshold"] - t) < 1e-6, f
    best = min(expected, key=lambda f: (expected[f][0], f))
    assert [f for f, r in got.items() if r["best"]] == [best]


def test_one_hot_unseen_and_standardize_zero_deviation(spark):
    fit = spark.createDataFrame([("yoga", 5.0), ("run", 5.0), ("yoga", 5.0)], "t string, x double")
    df = spark.createDataFrame([("yoga", 5.0), ("zumba", None), (None, 7.0)], "t string, x double")
    oh = {r["t"]: r for r in FE.one_hot(df, "t", fit=fit).collect()}
    assert oh["yoga"]["t_slot"] == 1 and oh["yoga"]["t_width"] == 2 and oh["yoga"]["t_onehot"] == "0,1"
    assert oh["zumba"]["t_slot"] is None and oh["zumba"]["t_onehot"] == "0,0"
    assert oh[None]["t_slot"] is None and oh[None]["t_onehot"] == "0,0"
    sc = {r["t"]: r["x_scaled"] for r in FE.standardize(df, ["x"], fit=fit).collect()}
    assert sc["yoga"] == 0.0 and sc["zumba"] is None and sc[None] == 2.0   # deviation 0 -> divide by 1
