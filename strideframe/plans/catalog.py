"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the driver's tables through the fixture views, so its work
grows with the scale factor.  Output columns are aliased to the names of the
DuckDB twin in ``oracle.py``; floating results are rounded to 6 decimals.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import display_label, md5_bucket, ordinal, result_line
from ..functions import rules as R
from ..operators import changes as CH
from ..operators import entity as EN
from ..operators import features as FE
from ..operators import identity as ID
from ..operators import model as MO
from ..operators import quality as QA
from ..operators import records as RC
from ..operators import tree as TR
from ..operators.stats import user_progress, user_streaks, user_weekly_stats
from ..sources import fixtures as FX

QueryFn = Callable[[SparkSession, str], DataFrame]


def _now():
    return F.lit(FX.FIXTURE_NOW).cast("timestamp_ntz")


def q_user_lookup_by_id(spark, d):
    req = FX.requests(spark, d).select("request_id", F.col("user_id").alias("id"))
    return RC.users_by_id(FX.users(spark, d), req)


def q_user_lookup_by_email(spark, d):
    return RC.users_by_email(FX.users(spark, d), FX.logins(spark, d).select("attempt_id", "email"))


def q_owner_log_lookup(spark, d):
    req = FX.patches(spark, d).select(F.col("seq").alias("request_id"), "id", "user_id")
    return RC.logs_for_owner(FX.logs(spark, d), req)


def q_user_history(spark, d):
    return RC.user_history(FX.logs(spark, d), FX.users(spark, d))


def q_public_users(spark, d):
    return RC.public_users(FX.users(spark, d))


def q_log_view(spark, d):
    return RC.log_view(FX.logs(spark, d))


def q_ordinal_intensity(spark, d):
    return FX.score_requests(spark, d).select(
        "request_id", "intensity", ordinal("intensity").alias("intensity_numeric"))


def q_result_line(spark, d):
    return FX.training(spark, d).select("id", result_line("workout_type", "equipment", "goal").alias("result"))


def q_display_label(spark, d):
    return FX.training(spark, d).select(
        "id", display_label("workout_type").alias("workout_label"),
        display_label("equipment").alias("equipment_label"), display_label("goal").alias("goal_label"))


def q_scoring_domain_split(spark, d):
    return QA.scoring_domain(FX.score_requests(spark, d)).select("request_id", "accepted", "message")


def q_validate_users(spark, d):
    return QA.validate_users(FX.new_users(spark, d)).select(
        "seq", "email", (F.size("errors") == 0).alias("valid"), F.concat_ws(",", "errors").alias("errors"))


def q_validate_logs(spark, d):
    return QA.validate_logs(FX.new_logs(spark, d)).select(
        "seq", (F.size("errors") == 0).alias("valid"), F.concat_ws(",", "errors").alias("errors"))


def q_orphan_logs(spark, d):
    # the users table without its inactive accounts, as if they were removed
    users = RC.active_users(FX.users(spark, d))
    return RC.orphans(RC.log_view(FX.logs(spark, d)), users).select("id", "user_id", "workout_date")


def q_resolve_principals(spark, d):
    return ID.resolve_principals(FX.requests(spark, d), FX.users(spark, d))


def q_resolve_logins(spark, d):
    return ID.resolve_logins(FX.logins(spark, d), FX.users(spark, d))


def q_register_users(spark, d):
    return ID.register_users(FX.new_users(spark, d), FX.users(spark, d), _now()).outcomes


def q_register_users_table(spark, d):
    return ID.register_users(FX.new_users(spark, d), FX.users(spark, d), _now()).table


def q_training_frame(spark, d):
    return FX.training(spark, d)


def q_training_csv(spark, d):
    """S-1: the feature table written as CSV (scratch folder) and read back."""
    from ..session import scratch_dir
    from ..sources import tables as TB

    path = scratch_dir(spark, "training-csv")
    FX.training(spark, d).select("workout_type", "equipment", "intensity", "duration_min",
                                 "calories_burned", "goal").write.option("header", True).csv(path)
    return TB.read_training(spark, path)


def q_training_csv_by_name(spark, d):
    """S-1: other columns among the needed ones, in another order, with quotes and line breaks in a cell."""
    from ..session import scratch_dir
    from ..sources import tables as TB

    path = scratch_dir(spark, "training-csv-by-name")
    note = F.concat(F.lit('said "'), "goal", F.lit('",\nrow '), F.col("id").cast("string"))
    FX.training(spark, d).select("goal", "id", "calories_burned", note.alias("note"), "intensity", "equipment", "user_id",
                                 "workout_type", "duration_min").write.option("header", True).option("escape", '"').csv(path)
    return TB.read_training(spark, path)


def q_live_requests(spark, d):
    return ID.live_requests(FX.requests(spark, d), FX.issues(spark, d))


def q_create_logs(spark, d):
    return RC.create_logs(FX.new_logs(spark, d), FX.logs(spark, d), FX.users(spark, d), _now()).outcomes


def q_create_logs_table(spark, d):
    return RC.create_logs(FX.new_logs(spark, d), FX.logs(spark, d), FX.users(spark, d), _now()).table


def q_patch_logs(spark, d):
    return CH.patch_logs(FX.patches(spark, d), FX.logs(spark, d), _now()).outcomes


def q_patch_logs_table(spark, d):
    return CH.patch_logs(FX.patches(spark, d), FX.logs(spark, d), _now()).table


def q_delete_logs(spark, d):
    return CH.delete_logs(FX.deletes(spark, d), FX.logs(spark, d)).outcomes


def q_delete_logs_table(spark, d):
    return CH.delete_logs(FX.deletes(spark, d), FX.logs(spark, d)).table


def q_cascade_delete(spark, d):
    ids = FX.users(spark, d).filter(~F.col("is_active")).select("id")
    kept_users, kept_logs = RC.delete_users(ids, FX.users(spark, d), FX.logs(spark, d))
    return kept_logs.select("id", "user_id")


def q_cascade_delete_users(spark, d):
    ids = FX.users(spark, d).filter(~F.col("is_active")).select("id")
    kept_users, _ = RC.delete_users(ids, FX.users(spark, d), FX.logs(spark, d))
    return kept_users.select("id", "email")


def q_read_users(spark, d):
    """S-2, S-4: the users written to a new table and read with the declared schema."""
    from .. import schemas as S
    from ..session import scratch_dir
    from ..sources import tables as TB

    path = scratch_dir(spark, "users")
    TB.ensure_table(spark, path, S.USERS)
    FX.users(spark, d).select(*S.USER_COLUMNS).write.mode("append").parquet(path)
    return TB.read_users(spark, path)


def q_select_features(spark, d):
    return FE.select_features(FX.training(spark, d))


def q_apply_changes(spark, d):
    return CH.apply_changes(FX.changes(spark, d), FX.logs(spark, d), _now(), FX.users(spark, d)).outcomes


def q_apply_changes_table(spark, d):
    return CH.apply_changes(FX.changes(spark, d), FX.logs(spark, d), _now(), FX.users(spark, d)).table


def q_outcome_counts(spark, d):
    out = CH.apply_changes(FX.changes(spark, d), FX.logs(spark, d), _now(), FX.users(spark, d)).outcomes
    return QA.outcome_counts(out, ["op", "outcome"])


def q_md5_split(spark, d):
    t = FX.training(spark, d)
    return FE.split(t, "id").select("id", md5_bucket("id").alias("bucket"), "part")


def q_standardize(spark, d):
    t = FE.with_ordinal(FE.split(FX.training(spark, d), "id"))
    cols = ["duration_min", "calories_burned", "intensity_numeric"]
    out = FE.standardize(t, cols, fit=t.filter(F.col("part") == "train"))
    return out.select("id", "part", *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in cols])


def q_vocabulary(spark, d):
    return FE.vocabulary(FX.training(spark, d), ["workout_type", "equipment", "goal"])


def q_one_hot(spark, d):
    t = FX.training(spark, d)
    out = FE.one_hot(FE.one_hot(t, "workout_type"), "equipment")
    return out.select("id", "workout_type_slot", "workout_type_width", "workout_type_onehot",
                      "equipment_slot", "equipment_width", "equipment_onehot")


def q_best_split(spark, d):
    return MO.best_split(FE.with_ordinal(FX.training(spark, d)))


def q_user_weekly_stats(spark, d):
    return user_weekly_stats(FX.logs(spark, d))


def q_validate_runs(spark, d):
    """R-2: rules of a run's create request."""
    return R.validate(FX.new_runs(spark, d), EN.RUN.rules()).select(
        "seq", (F.size("errors") == 0).alias("valid"), F.concat_ws(",", "errors").alias("errors"))


def _run_changes(spark, d):
    return CH.apply_changes(FX.run_changes(spark, d), FX.runs(spark, d), _now(), FX.users(spark, d), entity=EN.RUN)


def q_run_changes(spark, d):
    """R-2: the change engine on runs, one outcome per request."""
    return _run_changes(spark, d).outcomes


def q_run_changes_table(spark, d):
    return _run_changes(spark, d).table


def q_user_progress(spark, d):
    return user_progress(FX.logs(spark, d))


def q_user_streaks(spark, d):
    return user_streaks(FX.logs(spark, d))


def q_tree_scores(spark, d):
    return MO.tree_scores(FX.training(spark, d)).select("id", "user_id", "part", "goal", "predicted_goal")


def q_model_accuracy(spark, d):
    return MO.split_accuracy(FX.training(spark, d))


def q_score_requests(spark, d):
    t = FE.with_ordinal(FE.split(FX.training(spark, d), "user_id"))
    model = MO.train(t.filter(F.col("part") == "train"))
    return MO.score(FX.score_requests(spark, d), model).select(
        "request_id", "accepted", "message", "predicted_goal", "result")


def q_score_outcomes(spark, d):
    """What is determined of scoring whatever the tree: domain, message, whether there is a prediction."""
    t = FE.with_ordinal(FE.split(FX.training(spark, d), "user_id"))
    model = MO.train(t.filter(F.col("part") == "train"))
    return _determined(MO.score(FX.score_requests(spark, d), model))


def _determined(scored):
    return scored.select("request_id", "accepted", "message", F.col("predicted_goal").isNotNull().alias("has_prediction"),
                         F.col("result").isNotNull().alias("has_result"))


def q_reloaded_scores(spark, d):
    """S-6, S-7: the model saved, loaded and used for scoring."""
    from ..session import scratch_dir
    from ..sources import tables as TB

    t = FE.with_ordinal(FE.split(FX.training(spark, d), "user_id"))
    path = scratch_dir(spark, "model")
    TB.save_model(MO.train(t.filter(F.col("part") == "train")), path)
    return _determined(MO.score(FX.score_requests(spark, d), TB.load_model(spark, path)))


def q_stream_score_outcomes(spark, d):
    from ..streaming.jobs import run_scores_once

    return _determined(run_scores_once(spark, d))


def q_stream_intake(spark, d):
    from ..streaming.jobs import run_intake_once

    return run_intake_once(spark, d)


def q_stream_intake_table(spark, d):
    """T-1 into the log table: accepted rows become logs with new ids."""
    from ..streaming.jobs import run_intake_to_table_once

    return run_intake_to_table_once(spark, d)


def q_cascade_tombstones(spark, d):
    """D-5 on a changing table: one row per deleted user, folded on read."""
    import os

    from .. import schemas as S
    from ..session import scratch_dir
    from ..sources import changelog as CL
    from ..sources import tables as TB

    base = os.path.join(scratch_dir(spark, "tombstones"), "logs")
    TB.write_snapshot(FX.logs(spark, d).select(*S.LOG_COLUMNS), base, 0, cluster_by=["user_id", "id"])
    CL.delete_owners(spark, base, FX.users(spark, d).filter(~F.col("is_active")), "cascade", 0)
    return TB.read_current(spark, base).select("id", "user_id")


def q_stream_scores(spark, d):
    from ..streaming.jobs import run_scores_once

    return run_scores_once(spark, d)


def q_stream_changes(spark, d):
    from ..streaming.jobs import run_changes_once

    return run_changes_once(spark, d)


#: Depth of the exact trees that are checked; the twins spell out each level.
TREE_DEPTH = 3


def _nodes(tree, spark):
    t = tree.table(spark)
    return t.select("node", "feature", F.round("threshold", 6).alias("threshold"), "n", F.round("impurity", 6).alias("impurity"),
                    "label", F.round("mean", 6).alias("mean"))


def _owner_split(spark, d):
    return FE.with_ordinal(FE.split(FX.training(spark, d), "user_id"))


def _goal_tree(spark, d):
    return TR.grow(_owner_split(spark, d).filter(F.col("part") == "train"), TREE_DEPTH)


def q_exact_tree(spark, d):
    """M-5: the nodes of the tree of the training part."""
    return _nodes(_goal_tree(spark, d), spark)


def q_exact_tree_scores(spark, d):
    """M-5..M-7: each log with its part, goal and predicted goal."""
    return _goal_tree(spark, d).transform(_owner_split(spark, d)).select("id", "user_id", "part", "goal", "predicted_goal")


def q_exact_tree_accuracy(spark, d):
    """A-1, M-6: held-out accuracy for a split by log and one by owner."""
    parts = []
    for key in ("id", "user_id"):
        t = FE.with_ordinal(FE.split(FX.training(spark, d), key))
        tree = TR.grow(t.filter(F.col("part") == "train"), TREE_DEPTH)
        parts.append(TR.accuracy(tree.transform(t.filter(F.col("part") == "test"))).select(
            F.lit(key).alias("split_key"), "n_test", "n_correct", F.round("accuracy", 6).alias("accuracy")))
    return parts[0].unionByName(parts[1])


def q_exact_score_requests(spark, d):
    """M-7, S-6, S-7: the tree written as a table, read again and used for scoring."""
    from ..session import scratch_dir

    tree, path = _goal_tree(spark, d), scratch_dir(spark, "tree")
    tree.table(spark).write.parquet(path)
    again = TR.read_tree(spark.read.parquet(path), tree.kind, tree.numeric, tree.categorical)
    return MO.score(FX.score_requests(spark, d), again).select("request_id", "accepted", "message", "predicted_goal", "result")


def q_stream_exact_scores(spark, d):
    """T-2: the request stream scored with the exact tree."""
    from ..streaming.jobs import run_scores_once

    return run_scores_once(spark, d, model=_goal_tree(spark, d))


def _duration_tree(spark, d):
    t = _owner_split(spark, d)
    return t, TR.grow(t.filter(F.col("part") == "train"), TREE_DEPTH, TR.REGRESS, "duration_min",
                      numeric=["calories_burned", "intensity_numeric"], out="predicted_minutes")


def q_duration_tree(spark, d):
    """R-3: the nodes of the regression of a workout's duration."""
    return _nodes(_duration_tree(spark, d)[1], spark)


def q_duration_errors(spark, d):
    """R-3: its errors on both parts."""
    t, tree = _duration_tree(spark, d)
    got = TR.errors(tree.transform(t), "duration_min", "predicted_minutes", ["part"])
    return got.select("part", "n", F.round("mse", 6).alias("mse"), F.round("mae", 6).alias("mae"))


def q_profile_tree_scores(spark, d):
    """R-4: the workout type predicted from the profile alone (goal, equipment)."""
    t = _owner_split(spark, d)
    tree = TR.grow(t.filter(F.col("part") == "train"), TREE_DEPTH, target="workout_type", numeric=[],
                   categorical=["goal", "equipment"], out="predicted_type")
    return tree.transform(t).select("id", "part", "workout_type", "predicted_type")


QUERIES: dict[str, QueryFn] = {
    "user_lookup_by_id": q_user_lookup_by_id,
    "user_lookup_by_email": q_user_lookup_by_email,
    "owner_log_lookup": q_owner_log_lookup,
    "user_history": q_user_history,
    "public_users": q_public_users,
    "log_view": q_log_view,
    "ordinal_intensity": q_ordinal_intensity,
    "result_line": q_result_line,
    "display_label": q_display_label,
    "scoring_domain_split": q_scoring_domain_split,
    "validate_users": q_validate_users,
    "validate_logs": q_validate_logs,
    "orphan_logs": q_orphan_logs,
    "resolve_principals": q_resolve_principals,
    "resolve_logins": q_resolve_logins,
    "register_users": q_register_users,
    "register_users_table": q_register_users_table,
    "training_frame": q_training_frame,
    "training_csv": q_training_csv,
    "training_csv_by_name": q_training_csv_by_name,
    "live_requests": q_live_requests,
    "create_logs": q_create_logs,
    "create_logs_table": q_create_logs_table,
    "patch_logs": q_patch_logs,
    "patch_logs_table": q_patch_logs_table,
    "delete_logs": q_delete_logs,
    "delete_logs_table": q_delete_logs_table,
    "cascade_delete": q_cascade_delete,
    "cascade_delete_users": q_cascade_delete_users,
    "read_users": q_read_users,
    "select_features": q_select_features,
    "apply_changes": q_apply_changes,
    "apply_changes_table": q_apply_changes_table,
    "outcome_counts": q_outcome_counts,
    "md5_split": q_md5_split,
    "standardize": q_standardize,
    "vocabulary": q_vocabulary,
    "one_hot": q_one_hot,
    "best_split": q_best_split,
    "user_weekly_stats": q_user_weekly_stats,
    "validate_runs": q_validate_runs,
    "run_changes": q_run_changes,
    "run_changes_table": q_run_changes_table,
    "user_progress": q_user_progress,
    "user_streaks": q_user_streaks,
    "tree_scores": q_tree_scores,
    "model_accuracy": q_model_accuracy,
    "score_requests": q_score_requests,
    "score_outcomes": q_score_outcomes,
    "reloaded_scores": q_reloaded_scores,
    "exact_tree": q_exact_tree,
    "exact_tree_scores": q_exact_tree_scores,
    "exact_tree_accuracy": q_exact_tree_accuracy,
    "exact_score_requests": q_exact_score_requests,
    "stream_exact_scores": q_stream_exact_scores,
    "duration_tree": q_duration_tree,
    "duration_errors": q_duration_errors,
    "profile_tree_scores": q_profile_tree_scores,
    "stream_intake": q_stream_intake,
    "stream_intake_table": q_stream_intake_table,
    "cascade_tombstones": q_cascade_tombstones,
    "stream_scores": q_stream_scores,
    "stream_score_outcomes": q_stream_score_outcomes,
    "stream_changes": q_stream_changes,
}
