"""Commits of a changing log table: several writers, levelled folding, tombstones of owners (S-5, T-1, T-3, D-5).

A table is its newest snapshot (``v=<number>``) and the change folders
committed after it.  A change folder holds the new state of every row it
touched (``deleted`` rows without one) and, with a null id, owners whose rows
of earlier commits are gone.

*Commits.*  ``_commits/<thousands>/<number>`` is created once and never
changed: it says what the table is after that commit (the live folders, the
last batch of every writer, the highest id).  Who finds the number taken has
lost: it reads the table again, decides again and takes the next number, so
the result is that of one writer after the other.  Only the newest commit has
to be read to know the table.

*Folding.*  Once ``FAN`` folders of one level stand in a row they become one
of the next level, with the last state per id.  So a read meets fewer than
``FAN`` folders a level, and a row is written once a level.  When the live
folders hold more rows than ``SNAPSHOT_RATIO`` of the snapshot, a new snapshot
is due.

The create-if-absent is a hard link on a local disk and a rename that refuses
an existing target elsewhere (HDFS and file systems that keep its contract).
"""

from __future__ import annotations

import json
import os
import uuid
from typing import Callable, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.sizing import split_join
from . import tables as TB

#: Folders of a level that are folded into one of the next.
FAN = 4
#: A snapshot is due when the live folders hold more rows than this share of it, and more than ``SNAPSHOT_LEAST``.
SNAPSHOT_RATIO, SNAPSHOT_LEAST = 1.0, 100_000
#: Times that a writer decides again before it gives up.
ATTEMPTS = 100
_PER_FOLDER = 1000


class Folder(NamedTuple):
    path: str   # below the table's folder
    low: int    # numbers of the commits it holds
    high: int
    level: int
    rows: int
    owners: int  # tombstones of owners


class State(NamedTuple):
    number: int                 # of the last commit or snapshot
    live: list[Folder]          # oldest first
    writers: dict[str, int]     # last batch of each writer
    last_id: int | None         # the highest id ever stored; None: not known yet
    snapshot: str | None
    snapshot_at: int
    snapshot_rows: int | None


class Change(NamedTuple):
    """What a writer decided from a state: rows in ``S.LOG_CHANGES`` without ``change``, and outcomes (or None)."""

    rows: DataFrame
    outcomes: DataFrame | None = None


def _fs(spark: SparkSession, path: str):
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def _names(spark: SparkSession, folder: str) -> list[int]:
    fs, path = _fs(spark, folder)
    names = [st.getPath().getName() for st in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n) for n in names if n.isdigit())


def _commit_path(base: str, number: int) -> str:
    return os.path.join(base, "_commits", f"{number // _PER_FOLDER:09d}", f"{number:012d}")


def _read_json(spark: SparkSession, path: str) -> dict:
    fs, jpath = _fs(spark, path)
    stream = fs.open(jpath)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with its content in one step; False if it is there already."""
    jvm = spark.sparkContext._jvm
    fs, target = _fs(spark, path)
    temp = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(temp)
    out.write(text.encode())
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            made = [jvm.java.nio.file.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                    for p in (target, temp)]
            jvm.java.nio.file.Files.createLink(*made)
        else:
            if fs.exists(target) or not fs.rename(temp, target):
                return False
        return True
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    finally:
        if fs.exists(temp):
            fs.delete(temp, False)


def state_of(spark: SparkSession, base: str) -> State:
    """The table as of its last commit; reads one commit and lists at most two folders of names."""
    found = TB._numbered(spark, base, "v=")
    at, snapshot = found[-1] if found else (0, None)
    folders = _names(spark, os.path.join(base, "_commits"))
    numbers = _names(spark, os.path.join(base, "_commits", f"{folders[-1]:09d}")) if folders else []
    if not numbers:
        return State(at, [], {}, None, snapshot, at, None)
    got = _read_json(spark, _commit_path(base, numbers[-1]))
    live = [Folder(*f) for f in got["live"] if f[2] > at]
    rows = got["snapshot_rows"] if got["snapshot_at"] == at else None
    return State(max(at, numbers[-1]), live, got["writers"], got["last_id"], snapshot, at, rows)


def _commit(spark: SparkSession, base: str, state: State, entry: dict) -> bool:
    """Makes ``state`` the table, if its number is still free."""
    text = json.dumps({"number": state.number, "live": state.live, "writers": state.writers, "last_id": state.last_id,
                       "snapshot_at": state.snapshot_at, "snapshot_rows": state.snapshot_rows, **entry})
    return create_once(spark, _commit_path(base, state.number), text)


def commits_of(spark: SparkSession, base: str) -> list[dict]:
    """All commits, oldest first (each with ``kind``, ``path``, ``outcomes``, ``writer``, ``batch``): for inspection."""
    return [_read_json(spark, _commit_path(base, n)) for f in _names(spark, os.path.join(base, "_commits"))
            for n in _names(spark, os.path.join(base, "_commits", f"{f:09d}"))]


def outcomes_of(spark: SparkSession, base: str) -> DataFrame | None:
    """The outcomes of all committed batches; None if there are none."""
    paths = [os.path.join(base, c["outcomes"]) for c in commits_of(spark, base) if c.get("outcomes")]
    return spark.read.parquet(*paths) if paths else None


def read(spark: SparkSession, base: str, state: State | None = None) -> DataFrame:
    """The log table as of ``state`` (the last commit): the snapshot's rows, replaced and removed by later changes.

    The changes are folded to the last one per id (partial aggregation); only
    their ids meet the snapshot.  Tombstones, one row per owner, meet the rows
    by owner in a join that Spark can split.
    """
    state = state or state_of(spark, base)
    names = [f.name for f in S.LOGS.fields]
    logs = TB.read_logs(spark, state.snapshot) if state.snapshot else spark.createDataFrame([], S.LOGS)
    if not state.live:
        return logs
    rows = _rows(spark, base, state.live).filter(F.col("change") > state.snapshot_at)
    last = _last(rows)
    kept = logs.join(last.select("id"), "id", "left_anti").select(*names, F.lit(state.snapshot_at).cast("long").alias("change"))
    now = kept.unionByName(last.filter(~F.col("deleted")).select(*names, "change"))
    if any(f.owners for f in state.live):
        gone = _owners(rows).select("user_id", F.col("change").alias("gone"))
        now = split_join(now, gone, ["user_id"], "left").filter(F.col("gone").isNull() | (F.col("change") > F.col("gone")))
    return now.select(*names)


def _rows(spark: SparkSession, base: str, folders: list[Folder]) -> DataFrame:
    return spark.read.schema(S.LOG_CHANGES).parquet(*[os.path.join(base, f.path) for f in folders])


def _last(rows: DataFrame) -> DataFrame:
    """The last change of each id."""
    fields = [f.name for f in S.LOG_CHANGES.fields if f.name != "id"]
    got = rows.filter(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(*fields), "change").alias("r"))
    return got.select("id", *[F.col(f"r.{c}").alias(c) for c in fields])


def _owners(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("id").isNull() & F.col("user_id").isNotNull()).groupBy("user_id").agg(F.max("change").alias("change"))


def commit_change(spark: SparkSession, base: str, decide: Callable[[DataFrame, State], Change], writer: str, batch: int) -> int | None:
    """Decides a batch on the present table and commits it; the number, or None if the batch was committed before.

    ``decide(table, state)`` runs again on the newer table whenever another
    writer was first.  A batch of a writer is committed once: batches of a
    writer have rising numbers, and a replay has one that is not above the last.
    """
    for _ in range(ATTEMPTS):
        state = state_of(spark, base)
        if batch <= state.writers.get(writer, -1):
            return None
        number, name = state.number + 1, f"{writer},{batch},{uuid.uuid4().hex}"
        if state.last_id is None:
            table = read(spark, base, state)
            state = state._replace(last_id=table.select(F.coalesce(F.max("id"), F.lit(0))).first()[0])
        change = decide(read(spark, base, state), state)
        outcomes = None
        if change.outcomes is not None:
            outcomes = os.path.join("_outcomes", name)
            change.outcomes.write.parquet(os.path.join(base, outcomes))
        path = os.path.join("_changes", name)
        change.rows.withColumn("change", F.lit(number).cast("long")).write.parquet(os.path.join(base, path))
        made = spark.read.schema(S.LOG_CHANGES).parquet(os.path.join(base, path)).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("id").isNull()).alias("owners"), F.max("id").alias("id")).first()
        live = [*state.live, Folder(path, number, number, 0, made["rows"], made["owners"])] if made["rows"] else state.live
        after = state._replace(number=number, live=live, writers={**state.writers, writer: batch},
                               last_id=max(state.last_id, made["id"] or 0))
        if _commit(spark, base, after, {"kind": "change", "path": path, "outcomes": outcomes, "writer": writer, "batch": batch}):
            return number
    raise RuntimeError(f"{base}: other writers were first {ATTEMPTS} times")


def _due(live: list[Folder]) -> list[Folder] | None:
    """``FAN`` neighbouring folders of one level, the newest ones, if there are any."""
    for k in range(len(live) - FAN, -1, -1):
        group = live[k:k + FAN]
        if len({f.level for f in group}) == 1:
            return group
    return None


def fold(spark: SparkSession, base: str) -> int:
    """Folds whatever is due; returns how many folders were made."""
    made = 0
    while (group := _due(state_of(spark, base).live)) is not None:
        rows = _rows(spark, base, group)
        owners = _owners(rows).withColumn("deleted", F.lit(True))
        path = os.path.join("_changes", f"fold,{group[0].low},{group[-1].high},{uuid.uuid4().hex}")
        _last(rows).unionByName(owners, allowMissingColumns=True).write.parquet(os.path.join(base, path))
        n = spark.read.schema(S.LOG_CHANGES).parquet(os.path.join(base, path)).agg(
            F.count(F.lit(1)).alias("rows"), F.count_if(F.col("id").isNull()).alias("owners")).first()
        folded = Folder(path, group[0].low, group[-1].high, group[0].level + 1, n["rows"], n["owners"])
        while True:
            # the data are right whatever was committed since; only the place of the four must still be theirs
            state = state_of(spark, base)
            at = [k for k in range(len(state.live)) if state.live[k:k + FAN] == group]
            if not at:
                break
            live = [*state.live[:at[0]], folded, *state.live[at[0] + FAN:]]
            if _commit(spark, base, state._replace(number=state.number + 1, live=live), {"kind": "fold", "path": path}):
                made += 1
                break
    return made


def compact(spark: SparkSession, base: str, cluster_by: list[str] | None = None) -> str:
    """Writes the present table as a new snapshot, numbered as the last commit, and returns its path.

    Commits made meanwhile have higher numbers and stay live.
    """
    state = state_of(spark, base)
    if state.snapshot and state.snapshot_at == state.number:
        return state.snapshot
    return TB.write_snapshot(read(spark, base, state), base, state.number, cluster_by=cluster_by, mark=uuid.uuid4().hex)


def tidy(spark: SparkSession, base: str, cluster_by: list[str] | None = None, ratio: float = SNAPSHOT_RATIO,
         least: int = SNAPSHOT_LEAST) -> None:
    """Folds what is due, and writes a snapshot if the live folders have outgrown it.

    The snapshot's rows are counted once and kept in the next commit.
    """
    fold(spark, base)
    state = state_of(spark, base)
    live = sum(f.rows for f in state.live)
    if live <= least:
        return
    rows = state.snapshot_rows
    if rows is None:
        rows = TB.read_logs(spark, state.snapshot).count() if state.snapshot else 0
        _commit(spark, base, state._replace(number=state.number + 1, snapshot_rows=rows), {"kind": "count"})
    if live > ratio * rows:
        compact(spark, base, cluster_by)


def delete_owners(spark: SparkSession, base: str, owners: DataFrame, writer: str, batch: int) -> int | None:
    """D-5 on a changing table: all logs of the users in ``owners.id`` as of now are gone; one row is written per user.

    Logs that a later commit creates stay, also those of the same owner.
    """
    fields = [f.name for f in S.LOG_CHANGES.fields if f.name not in ("change", "user_id", "deleted")]
    types = {f.name: f.dataType for f in S.LOG_CHANGES.fields}

    def decide(table: DataFrame, state: State) -> Change:
        gone = owners.select(F.col("id").alias("user_id")).filter(F.col("user_id").isNotNull()).distinct()
        return Change(gone.select(*[F.lit(None).cast(types[c]).alias(c) for c in fields], "user_id", F.lit(True).alias("deleted")))

    return commit_change(spark, base, decide, writer, batch)
