"""Session settings and lineage cuts.

The library never creates a session behind the caller's back; ``build_session``
is for scripts, tests and the benchmark.  ``checkpoint`` cuts lineage into the
shared folder the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job here relies on.  Timestamps are UTC; AQE re-plans joins
# at runtime (broadcast only when the measured side is under the threshold,
# split skewed partitions, coalesce small ones).
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of frames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "strideframe", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_SETTINGS)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def scale_settings(input_bytes: int, cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Partition sizing for a job reading ``input_bytes`` on ``cores`` cores.

    Scan splits of ``target_partition_bytes``; shuffle partitions so that a
    partition of the largest shuffle (about the input size) is near the same
    size, never fewer than two per core; AQE then coalesces small partitions
    toward the advisory size and splits skewed ones above five times the
    median.  At 100 TB and 256 MB this gives about 400,000 partitions.
    """
    shuffle = max(2 * cores, -(-int(input_bytes) // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_partition_bytes),
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    The cluster's ``spark.checkpoint.dir`` is used as given.  Only when it is
    unset and the master is local (tests) is a fresh scratch folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a folder every executor shares")
    folder = tempfile.mkdtemp(prefix="strideframe-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never machine-local
    on a cluster)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "strideframe-scratch", f"{name}-{uuid.uuid4().hex}")


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably (survives executor loss) and cut lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
