"""Model training and scoring, streaming jobs (incl. replay), plan shapes."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from strideframe import schemas as S
from strideframe.operators import features as FE
from strideframe.operators import model as MO
from strideframe.operators import records as RC
from strideframe.sources import fixtures as FX
from strideframe.sources import tables as TB
from strideframe.session import scratch_dir
from strideframe.streaming import jobs as JB


@pytest.fixture(scope="module")
def trained(spark):
    t = FE.with_ordinal(FE.split(FX.training(spark, SF_SMALL), "user_id"))
    return t, MO.train(t.filter(F.col("part") == "train"))


def test_train_and_score(spark, trained):
    t, model = trained
    assert model.labels == sorted(model.labels)
    # the scoring pipeline has no label stage: it runs on rows without a goal
    stages = [type(s).__name__ for s in model.pipeline.stages]
    assert "StringIndexerModel" in stages and stages[-2:] == ["DecisionTreeClassificationModel", "IndexToStringModel"] or stages[-1] == "IndexToString"
    scored = MO.predict(model, t.drop("goal").withColumn("goal", F.lit(None).cast("string")))
    assert scored.filter(F.col("predicted_goal").isNull()).count() == 0
    rows = {r["split_key"]: r for r in MO.split_accuracy(FX.training(spark, SF_SMALL), max_depth=3).collect()}
    assert set(rows) == {"id", "user_id"}
    # the plain average is what Spark's evaluator gives
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import StringIndexer

    part = t.filter(F.col("part") == "test")
    small = MO.train(t.filter(F.col("part") == "train"), max_depth=3)
    test = MO.predict(small, part)
    both = test.select("goal", "predicted_goal")
    names = StringIndexer(inputCol="goal", outputCol="l", stringOrderType="alphabetAsc").fit(
        both.select("goal").union(both.select(F.col("predicted_goal"))))
    indexed = names.transform(both).withColumnRenamed("goal", "g").withColumn("goal", F.col("predicted_goal"))
    indexed = names.copy({names.outputCol: "p"}).transform(indexed)
    ml = MulticlassClassificationEvaluator(labelCol="l", predictionCol="p", metricName="accuracy").evaluate(indexed)
    assert abs(ml - rows["user_id"]["accuracy"]) < 1e-9


def _feature_rows(spark, n, shift=0.0):
    """Made rows: more values than bins, gaps, ties, nulls in every feature; the goal hangs on all of them."""
    i, r = F.col("id"), F.abs(F.xxhash64(F.col("id"), F.lit(shift)))
    return spark.range(n).select(
        "id", F.when(i % 17 != 3, (r % 97 * 2).cast("int")).alias("duration_min"),
        F.when(i % 19 != 4, (r % 4001) / 7.0 + shift).alias("calories_burned"),
        F.when(i % 23 != 5, (r % 4).cast("int")).alias("intensity_numeric"),
        F.when(i % 29 != 6, F.concat(F.lit("w"), (r % 5).cast("string"))).alias("workout_type"),
        F.when(i % 31 != 7, F.concat(F.lit("e"), (F.floor(r / 8) % 3).cast("string"))).alias("equipment"),
        F.when(i % 37 != 8, F.concat(F.lit("g"), ((r % 97 + r % 4001 + F.floor(r / 64) % 3) % 5).cast("string"))).alias("goal"))


def test_tree_of_counted_rows_is_the_tree_of_all_rows(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import SQLTransformer, StringIndexer

    rows, asked = _feature_rows(spark, 3000), _feature_rows(spark, 1500, 0.25)
    got = MO.train(rows, max_depth=12)
    labeled = StringIndexer(inputCol="goal", outputCol="_label", stringOrderType="alphabetAsc",
                            handleInvalid="skip").fit(rows).transform(rows)
    casts = SQLTransformer(statement="SELECT *, " + ", ".join(
        f"CAST(`{c}` AS DOUBLE) AS `_dbl_{c}`" for c in S.NUMERIC_FEATURES) + " FROM __THIS__")
    tree = DecisionTreeClassifier(featuresCol="features", labelCol="_label", predictionCol="_prediction", maxDepth=12, seed=42)
    plain = Pipeline(stages=[casts, *FE.feature_stages(), tree]).fit(labeled)
    made = next(s for s in got.pipeline.stages if hasattr(s, "numNodes"))
    assert (made.numNodes, made.depth) == (plain.stages[-1].numNodes, plain.stages[-1].depth) and made.numNodes > 500
    for df in (rows, asked):
        a = {r["id"]: r["predicted_goal"] for r in MO.predict(got, df).collect()}
        b = {r["id"]: got.labels[int(r["_prediction"])] for r in plain.transform(df).select("id", "_prediction").collect()}
        assert a == b


def test_tree_of_counted_rows_has_the_thresholds_of_a_searched_sample(spark):
    """Beyond 10,000 rows Spark's tree draws its thresholds from a sample of its own: the same ones are used."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import SQLTransformer, StringIndexer

    rows, asked = _feature_rows(spark, 25_000), _feature_rows(spark, 3000, 0.25)
    got = MO.train(rows, max_depth=9)
    labeled = StringIndexer(inputCol="goal", outputCol="_label", stringOrderType="alphabetAsc",
                            handleInvalid="skip").fit(rows).transform(rows)
    casts = SQLTransformer(statement="SELECT *, " + ", ".join(
        f"CAST(`{c}` AS DOUBLE) AS `_dbl_{c}`" for c in S.NUMERIC_FEATURES) + " FROM __THIS__")
    tree = DecisionTreeClassifier(featuresCol="features", labelCol="_label", predictionCol="_prediction", maxDepth=9, seed=42)
    plain = Pipeline(stages=[casts, *FE.feature_stages(), tree]).fit(labeled)
    made = next(s for s in got.pipeline.stages if hasattr(s, "numNodes"))
    assert (made.numNodes, made.depth) == (plain.stages[-1].numNodes, plain.stages[-1].depth) and made.numNodes > 300
    for df in (rows, asked):
        a = {r["id"]: r["predicted_goal"] for r in MO.predict(got, df).collect()}
        b = {r["id"]: got.labels[int(r["_prediction"])] for r in plain.transform(df).select("id", "_prediction").collect()}
        assert a == b


def test_tree_trains_on_counted_rows_in_few_partitions(spark, monkeypatch):
    """Each partition sends the counts of every node: rows times partitions would be shuffled, level by level."""
    from pyspark.ml.classification import DecisionTreeClassifier

    fit, seen = DecisionTreeClassifier.fit, []

    def spy(self, dataset, params=None):
        seen.append((dataset.count(), dataset.rdd.getNumPartitions()))
        return fit(self, dataset, params)

    monkeypatch.setattr(DecisionTreeClassifier, "fit", spy)
    rows = _feature_rows(spark, 1000).crossJoin(spark.range(20).select(F.lit(0).alias("_k"))).repartition(64)
    MO.train(rows, max_depth=2)
    (n, parts), = seen
    assert n <= 1000 and parts <= spark.sparkContext.defaultParallelism


def test_unseen_category_encodes_as_zeros(spark, trained):
    _, model = trained
    req = spark.createDataFrame([
        (1, "running", "none", "high", 30, 100.0),
        (2, "cycling", "full_gym", "low", 45, 12.0),
        (3, "HIIT", "none", "high", 30, 100.0),
    ], S.SCORE_REQUESTS)
    out = {r["request_id"]: r for r in MO.score(req, model).collect()}
    assert out[3]["accepted"] is False and out[3]["predicted_goal"] is None
    assert out[3]["message"] == S.SCORING_DOMAIN_MESSAGE
    assert out[1]["result"].startswith("Input: running, none -> Predicted Goal: ")
    # a category unseen in training (as the one-hot layer sees it) still scores
    odd = spark.createDataFrame([(9, "zumba", "trampoline", "high", 30, 100.0)], S.SCORE_REQUESTS)
    assert MO.predict(model, odd.withColumn("intensity_numeric", F.lit(4))).count() == 1


def test_score_without_model_names_the_cause(spark):
    req = spark.createDataFrame([(1, "running", "none", "high", 30, 100.0)], S.SCORE_REQUESTS)
    with pytest.raises(RuntimeError, match="not loaded"):
        MO.score(req, None)


def test_model_round_trip(spark, trained, tmp_path):
    t, model = trained
    path = str(tmp_path / "model")
    TB.save_model(model, path)
    loaded = TB.load_model(spark, path)
    assert TB.load_model(spark, str(tmp_path / "absent")) is None
    a = MO.predict(model, t).select("id", "predicted_goal").orderBy("id").collect()
    b = MO.predict(loaded, t).select("id", "predicted_goal").orderBy("id").collect()
    assert a == b
    reqs = FX.score_requests(spark, SF_SMALL)
    assert sorted(map(tuple, MO.score(reqs, loaded).collect()), key=repr) == sorted(map(tuple, MO.score(reqs, model).collect()), key=repr)


def test_other_feature_lists_save_load_and_score(spark, tmp_path):
    u = FX.users(spark, SF_SMALL).select("id", "age", "goal", "equipment")
    model = MO.train(u, numeric=["age"], categorical=["equipment"], max_depth=2)
    path = str(tmp_path / "other")
    TB.save_model(model, path)
    reqs = spark.createDataFrame([(1, "running", "none", "high", 30, 100.0, 44)],
                                 "request_id long, workout_type string, equipment string, intensity string, "
                                 "duration_min int, calories_burned double, age int")
    row = MO.score(reqs, TB.load_model(spark, path)).first()
    assert row["accepted"] and row["predicted_goal"] in model.labels


def test_stream_intake_equals_batch_and_replay_adds_nothing(spark):
    base = scratch_dir(spark, "test-intake")
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "ckpt")
    users = FX.users(spark, SF_SMALL)
    reqs = FX.new_logs_from(FX.logs_from_events(JB.events_stream(spark, SF_SMALL)))
    JB.stream_logs(reqs, users, out, ckpt).awaitTermination()
    first = spark.read.parquet(os.path.join(out, "outcomes")).count()
    batch = RC.create_logs(FX.new_logs(spark, SF_SMALL), FX.logs(spark, SF_SMALL), users,
                           F.lit(FX.FIXTURE_NOW).cast("timestamp_ntz")).outcomes
    s = {(r["seq"], r["outcome"].replace("accepted", "created")) for r in
         spark.read.parquet(os.path.join(out, "outcomes")).collect()}
    b = {(r["seq"], r["outcome"]) for r in batch.collect()}
    assert s == b
    # run again from the same checkpoint: the file was consumed, nothing new
    reqs2 = FX.new_logs_from(FX.logs_from_events(JB.events_stream(spark, SF_SMALL)))
    JB.stream_logs(reqs2, users, out, ckpt).awaitTermination()
    assert spark.read.parquet(os.path.join(out, "outcomes")).count() == first


def test_stream_scores_rows(spark):
    df = JB.run_scores_once(spark, SF_SMALL)
    assert df.count() == FX.score_requests(spark, SF_SMALL).count()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_owner_lookup_pushes_filters(spark):
    lg = FX.logs(spark, SF_SMALL).filter(F.col("user_id") == 3)
    plan = _plan(RC.history(lg, ranked=False))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in plan


def test_no_unpartitioned_window(spark):
    from strideframe.operators import changes as CH
    from strideframe.operators import identity as ID

    now = F.lit(FX.FIXTURE_NOW).cast("timestamp_ntz")
    plans = [
        CH.apply_changes(FX.changes(spark, SF_SMALL), FX.logs(spark, SF_SMALL), now,
                         FX.users(spark, SF_SMALL)).table,
        ID.live_requests(FX.requests(spark, SF_SMALL), FX.issues(spark, SF_SMALL)),
        ID.accept_new_users(FX.new_users(spark, SF_SMALL), FX.users(spark, SF_SMALL)),
    ]
    for df in plans:
        p = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in p, p


def _start(spark, sf_dir, table_base, ckpt, users, now):
    chg = FX.changes_from(FX.logs_from_events(JB.events_stream(spark, sf_dir)))
    JB.stream_changes(chg, table_base, ckpt, now, users).awaitTermination()


def _rows(df):
    return sorted(map(tuple, df.select(*S.LOG_COLUMNS).collect()))


def test_stream_changes_replay_new_checkpoint_and_compaction(spark):
    from strideframe.operators import changes as CH

    base = scratch_dir(spark, "test-changes")
    table_base, ckpt = os.path.join(base, "logs"), os.path.join(base, "ckpt")
    TB.write_snapshot(FX.logs(spark, SF_SMALL).select(*S.LOG_COLUMNS), table_base, 0)
    now = F.lit(FX.FIXTURE_NOW).cast("timestamp_ntz")
    users = FX.users(spark, SF_SMALL)
    _start(spark, SF_SMALL, table_base, ckpt, users, now)
    batch = CH.apply_changes(FX.changes(spark, SF_SMALL), FX.logs(spark, SF_SMALL), now, users).table
    assert _rows(TB.read_current(spark, table_base)) == _rows(batch)
    # the snapshot is not rewritten, and a replayed checkpoint adds nothing
    assert TB.latest_snapshot(spark, table_base).endswith("v=000000")
    _start(spark, SF_SMALL, table_base, ckpt, users, now)
    assert len(TB.changes_of(spark, table_base)) == 1
    # a second stream on the same table is applied after the first
    del_ids = [r["id"] for r in batch.select("id").filter("id > 0").orderBy("id").limit(3).collect()]
    owner = {r["id"]: r["user_id"] for r in batch.collect()}
    source = os.path.join(base, "more")
    schema = "seq long, op string, id long, user_id long, body string"
    for i, d in enumerate(del_ids):
        spark.createDataFrame([(i, "delete", d, owner[d], None)], schema).coalesce(1).write.parquet(os.path.join(source, f"n={i}"))
    more = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(source, "*"))
    JB.stream_changes(more, table_base, os.path.join(base, "ckpt2"), now).awaitTermination()
    assert len(TB.changes_of(spark, table_base)) >= 4  # one more for each of three micro-batches at least
    left = _rows(batch.filter(~F.col("id").isin(del_ids)))
    assert _rows(TB.read_current(spark, table_base)) == left
    path = TB.compact(spark, table_base, ["user_id", "id"])
    assert TB.latest_snapshot(spark, table_base) == path and _rows(TB.read_logs(spark, path)) == left
    assert TB.compact(spark, table_base) == path


def test_streams_read_a_folder_of_part_files(spark, tmp_path):
    for t in ("customer", "nation", "region"):
        os.symlink(os.path.join(SF_SMALL, f"{t}.parquet"), tmp_path / f"{t}.parquet")
    spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = JB.run_intake_once(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, JB.run_intake_once(spark, SF_SMALL).collect())) and len(got) == 1000
    a, b = _rows(JB.run_changes_once(spark, str(tmp_path))), _rows(JB.run_changes_once(spark, SF_SMALL))
    assert a == b


def test_versions_are_numbers(spark, tmp_path):
    df = spark.createDataFrame([], S.LOGS)
    for v in (9, 999999, 1000000):
        last = TB.write_snapshot(df, str(tmp_path), v)
    assert TB.latest_snapshot(spark, str(tmp_path)) == last


def test_many_classes_and_many_categories(spark):
    df = spark.range(0, 40000).select(
        F.concat(F.lit("g"), F.col("id") % 20000).alias("goal"), F.col("id").cast("double").alias("x"),
        F.when(F.col("id") < 30000, "a").otherwise("b").alias("c"))
    best = {r["feature"]: r for r in MO.best_split(df, numeric=["x"], categorical=["c"]).collect()}
    assert best["x"]["n_left"] + best["x"]["n_right"] == 40000
    assert (best["c=b"]["n_left"], best["c=b"]["n_right"]) == (30000, 10000)
    cats = spark.range(0, 100000).select(F.concat(F.lit("k"), F.format_string("%06d", "id")).alias("c"), "id")
    hot = FE.one_hot(cats, "c", as_text=False)
    assert hot.filter("c_slot = id and c_width = 100000").count() == 100000


def test_hot_ids_and_emails_are_split(spark):
    """One id (or e-mail) with most requests, broadcasting off: Spark splits the joins."""
    from strideframe.operators import changes as CH
    from strideframe.operators import identity as ID

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 60000
        reqs = spark.range(0, n, 1, 6).select(
            F.col("id").alias("seq"), F.lit("patch").alias("op"), F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id") % 500).cast("long").alias("id"),
            F.lit(1).cast("long").alias("user_id"), F.concat(F.lit('{"duration_min": '), (F.col("id") % 50 + 1).cast("string"), F.lit("}")).alias("body"))
        logs = FX.logs(spark, SF_SMALL).withColumn("user_id", F.lit(1).cast("long"))
        out = CH.apply_changes(reqs, logs, F.lit(FX.FIXTURE_NOW).cast("timestamp_ntz")).outcomes
        assert out.count() == n
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
        batch = spark.range(0, n, 1, 6).select(
            F.col("id").alias("seq"), F.when(F.col("id") % 10 > 0, "hot@example.com").otherwise(F.concat(F.lit("u"), "id", F.lit("@example.com"))).alias("email"),
            F.lit(30).alias("age"), F.lit("goal").alias("goal"), F.lit("none").alias("equipment"))
        dec = ID.accept_new_users(batch, FX.users(spark, SF_SMALL))
        rows = dec.groupBy("outcome").count()
        rows.collect()
        dec.collect()
        assert "skew=true" in dec._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_change_engine_filters_the_log_table_without_shuffling_it(spark):
    from strideframe.operators import changes as CH

    now = F.lit(FX.FIXTURE_NOW).cast("timestamp_ntz")
    table = CH.apply_changes(FX.changes(spark, SF_SMALL), FX.logs(spark, SF_SMALL), now,
                             FX.users(spark, SF_SMALL)).table
    table.collect()
    plan = table._jdf.queryExecution().executedPlan().toString()
    # untouched rows: broadcast anti-join straight over the events scan
    lines = plan.split("\n")
    anti = [i for i, l in enumerate(lines) if "BroadcastHashJoin" in l and "LeftAnti" in l]
    assert anti, plan
    # no exchange sits between that anti-join and its scan
    i = anti[0]
    j = i + 1
    while j < len(lines) and "FileScan" not in lines[j]:
        assert "Exchange" not in lines[j], plan
        j += 1
    assert "events" in lines[j] or "parquet" in lines[j]


@pytest.mark.parametrize("name", ["score_outcomes", "reloaded_scores", "stream_score_outcomes"])
def test_registered_scores_train_trees_of_the_default_depth(spark, monkeypatch, name):
    from strideframe.plans import QUERIES

    class Stop(Exception):
        pass

    def train(df, max_depth=MO.MAX_DEPTH, **_):
        raise Stop(max_depth)

    monkeypatch.setattr(MO, "train", train)
    with pytest.raises(Stop) as got:
        QUERIES[name](spark, SF_SMALL)
    assert got.value.args == (MO.MAX_DEPTH,)
