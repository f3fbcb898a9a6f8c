"""Structured Streaming jobs (T-1 intake, T-2 scoring, T-3 changes).

None of them keeps state across micro-batches, so no watermark is needed:
each request is decided in the micro-batch it arrives in, and ``seq`` orders
requests inside one batch.  Sinks are written per ``batchId``, so a replay
after a failure does not duplicate rows.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import rules as R
from ..operators import changes as CH
from ..operators import features as FE
from ..operators import model as MO
from ..operators.records import principal_outcome, stamp
from ..session import scratch_dir
from ..sources import changelog as CL
from ..sources import fixtures as FX
from ..sources import tables as TB


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a file stream: one file or a folder of part files (schema from the table, not inferred)."""
    schema = FX.table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    folder = os.path.join(sf_dir, "events.parquet")
    if TB.is_folder(spark, folder):
        return reader.parquet(folder)
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def intake(requests: DataFrame, users: DataFrame, request_rows: int | None = None) -> DataFrame:
    """T-1 core: create requests -> outcome accepted / invalid / auth outcome.

    On a micro-batch (``request_rows`` counted) the users table is first
    narrowed to the batch's user ids by a size-checked broadcast semi-join,
    so a batch never shuffles or joins the whole users table.
    """
    checked = R.validate(principal_outcome(requests, users, request_rows=request_rows), R.log_rules())
    outcome = (F.when(F.col("auth").isNotNull(), F.col("auth"))
               .when(F.size("errors") > 0, F.lit(S.INVALID))
               .otherwise(F.lit("accepted")))
    return checked.withColumn("outcome", outcome).withColumn("errors", F.concat_ws(",", "errors"))


def _writer(checkpoint: str) -> str:
    """A stream's name in commits and folders: its checkpoint is what makes its batch numbers unique."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def _typed(accepted: DataFrame) -> DataFrame:
    return accepted.select(
        "seq", "user_id", F.try_to_date(F.col("workout_date"), "yyyy-MM-dd").alias("workout_date"),
        "duration_min", "intensity", "workout_type", "calories_burned")


def stream_logs(requests: DataFrame, users: DataFrame, out_dir: str, checkpoint: str,
                available_now: bool = True, table_base: str | None = None, now=None):
    """T-1: split a request stream into accepted rows and per-request outcomes.

    Each micro-batch is decided as a batch (``foreachBatch``): counted, and
    users narrowed to its ids.  Without a table, outcomes and accepted rows are
    written to folders of this stream and batch: a replayed batch overwrites
    its own, another stream or checkpoint writes others.

    With ``table_base`` the accepted rows become logs of that table, stamped
    ``now``, in one commit a batch (see ``sources.changelog``): ids follow the
    highest id ever stored (``last + 1 + seq - min(seq)``; ``seq`` is unique in a
    batch), other writers may commit in between, and a replay adds nothing.  The
    outcomes, with the ids, are ``changelog.outcomes_of``.
    """
    spark, writer = requests.sparkSession, _writer(checkpoint)

    def folder(name: str, batch_id: int) -> str:
        return os.path.join(out_dir, name, f"writer={writer}", f"batch={batch_id}")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        decided = intake(batch, users, request_rows=batch.count()).persist()
        accepted = F.col("outcome") == "accepted"
        if table_base is None:
            decided.select("seq", "user_id", "outcome", "errors").write.mode("overwrite").parquet(folder("outcomes", batch_id))
            _typed(decided.filter(accepted)).write.mode("overwrite").parquet(folder("accepted", batch_id))
        else:
            first = decided.select(F.min("seq")).first()[0]

            def decide(table: DataFrame, state: CL.State) -> CL.Change:
                new_id = (F.lit(state.last_id + 1) + F.col("seq") - F.lit(first)).cast("long")
                made = stamp(_typed(decided.filter(accepted)).withColumn("id", new_id).drop("seq"), now)
                outcomes = decided.select("seq", "user_id", F.when(accepted, new_id).alias("id"), "outcome", "errors")
                return CL.Change(made.withColumn("deleted", F.lit(False)), outcomes)

            CL.commit_change(spark, table_base, decide, writer, batch_id)
            CL.tidy(spark, table_base, ["user_id", "id"])
        decided.unpersist()
        batch.unpersist()

    w = requests.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_intake_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run T-1 over the events file to completion; return the outcomes."""
    base = scratch_dir(spark, "intake")
    reqs = FX.new_logs_from(FX.logs_from_events(events_stream(spark, sf_dir)))
    q = stream_logs(reqs, FX.users(spark, sf_dir), os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out", "outcomes")).select(
        "seq", "user_id", "outcome", "errors")


def run_intake_to_table_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the log table as version 0, run T-1 over the events file into it, return the table."""
    base = scratch_dir(spark, "intake-table")
    table_base = os.path.join(base, "logs")
    TB.write_snapshot(FX.logs(spark, sf_dir).select(*S.LOG_COLUMNS), table_base, 0, cluster_by=["user_id", "id"])
    reqs = FX.new_logs_from(FX.logs_from_events(events_stream(spark, sf_dir)))
    q = stream_logs(reqs, FX.users(spark, sf_dir), os.path.join(base, "out"), os.path.join(base, "ckpt"),
                    table_base=table_base, now=F.lit(FX.FIXTURE_NOW).cast("timestamp_ntz"))
    q.awaitTermination()
    return TB.read_current(spark, table_base)


def stream_scores(requests: DataFrame, model, out_dir: str, checkpoint: str):
    """T-2: score a request stream with a fitted model into a Parquet sink."""
    scored = MO.score(requests, model).select("request_id", "accepted", "message", "predicted_goal", "result")
    return (scored.writeStream.format("parquet").option("path", out_dir)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_scores_once(spark: SparkSession, sf_dir: str, max_depth: int = MO.MAX_DEPTH, model=None) -> DataFrame:
    """Run T-2 over the events file with ``model``, or with one trained on the batch feature table."""
    if model is None:
        t = FE.with_ordinal(FE.split(FX.training(spark, sf_dir), "user_id"))
        model = MO.train(t.filter(F.col("part") == "train"), max_depth=max_depth)
    base = scratch_dir(spark, "scores")
    reqs = FX.score_requests_from(FX.logs_from_events(events_stream(spark, sf_dir)), FX.users(spark, sf_dir))
    q = stream_scores(reqs, model, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination()
    return spark.read.parquet(os.path.join(base, "out"))


def stream_changes(changes: DataFrame, table_base: str, checkpoint: str, now,
                   users: DataFrame | None = None, available_now: bool = True):
    """T-3: apply each micro-batch of changes to the present table and commit what it changed.

    A batch writes its outcomes and the new state of the rows it touched, and
    commits them after all that is there; the snapshot is not rewritten.  If
    another writer commits first, the batch is decided again on the newer
    table (see ``sources.changelog``).  The commit carries this stream's
    checkpoint and the batch id, so a replayed batch is skipped.  Change
    folders are folded by levels, and outgrown snapshots are renewed, so a
    batch does not read more the more batches went before.
    """
    spark, writer = changes.sparkSession, _writer(checkpoint)

    def sink(batch: DataFrame, batch_id: int) -> None:
        def decide(logs: DataFrame, state: CL.State) -> CL.Change:
            result = CH.apply_changes(batch, logs, now, users, materialize=True)
            return CL.Change(result.changed.select(*S.LOG_COLUMNS, "deleted"), result.outcomes)

        CL.commit_change(spark, table_base, decide, writer, batch_id)
        CL.tidy(spark, table_base, ["user_id", "id"])

    w = changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_changes_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the log table as version 0, run T-3 over the events file, return the table as of its last change."""
    base = scratch_dir(spark, "changes")
    table_base = os.path.join(base, "logs")
    TB.write_snapshot(FX.logs(spark, sf_dir).select(*S.LOG_COLUMNS), table_base, 0,
                      cluster_by=["user_id", "id"])
    chg = FX.changes_from(FX.logs_from_events(events_stream(spark, sf_dir)))
    q = stream_changes(chg, table_base, os.path.join(base, "ckpt"),
                       F.lit(FX.FIXTURE_NOW).cast("timestamp_ntz"), FX.users(spark, sf_dir))
    q.awaitTermination()
    return TB.read_current(spark, table_base)
