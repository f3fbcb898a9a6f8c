"""Sources and sinks of the record tables and the model (S-1 .. S-7).

Every read passes an explicit schema.  Writes never overwrite the table being
read: a change set is written as a new version folder and the caller switches
to it (S-5).
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """S-2: all users."""
    return spark.read.schema(S.USERS).parquet(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """S-3: all workout logs (base of every log query)."""
    return spark.read.schema(S.LOGS).parquet(path)


# Reading as pandas does: quotes are doubled inside quotes, nothing is a null or an
# empty value to Spark; the token list decides what is missing.
_CSV = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": "\u0000", "emptyValue": ""}
_RECORD = "_record"


def csv_header(spark: SparkSession, path: str, multiline: bool = True) -> list[str]:
    """The names in the header of a CSV file, or of one file of a folder, as they are written."""
    first = spark.read.options(**_CSV).option("header", False).option("multiLine", multiline).csv(path).head()
    if first is None:
        raise ValueError(f"{path} has no header")
    return [("" if v is None else v).removeprefix("\ufeff") for v in first]


def read_training(spark: SparkSession, path: str, fmt: str = "csv", multiline: bool = True,
                  long_rows: str = "fail") -> DataFrame:
    """S-1: the training table: its six columns, found by name.

    The columns may stand in any order, among others; one that is missing (or
    named twice) raises and is named.  All files of a folder must have the same
    header; Spark compares each file's with the first one's and fails the job on
    another (only if a column without a name, or a name given twice, stands
    among the others is the first header taken for all files).

    CSV cells are read as text, the tokens pandas treats as missing become
    null (``none`` stays a value: it is an equipment name), then the numeric
    columns are cast with ``try_cast`` so a bad cell is null, not a failed job.
    A row with fewer cells than the header has nulls for the rest.  One with
    more (that are not empty) fails the job and is quoted, as in the reference;
    with ``long_rows="leave"`` such rows are left out, and ``long_training_rows``
    returns them.  A missing path raises.

    Line breaks inside quotes belong to the cell.  A file is then read by one
    task.  ``multiline=False`` splits large files over tasks; a quoted line
    break fails the job there, it is never read as two rows.
    """
    if long_rows not in ("fail", "leave"):
        raise ValueError("long_rows is 'fail' or 'leave'")
    if fmt != "csv":
        df = spark.read.format(fmt).load(path)
        _need(df.columns, path)
        return df.select("workout_type", "equipment", "intensity",
                         F.col("duration_min").cast("double").alias("duration_min"),
                         F.col("calories_burned").cast("double").alias("calories_burned"),
                         "goal")
    raw, place, too_long = _training_records(spark, path, multiline)
    fine = ~too_long if long_rows == "leave" else F.when(too_long, F.raise_error(F.concat(
        F.lit(f"{path}: a row has more cells than the header: "), F.col(_RECORD)))).otherwise(F.lit(True))
    raw = raw.filter(fine)
    if not multiline:
        cut = F.coalesce(F.length(_RECORD) - F.length(F.replace(F.col(_RECORD), F.lit('"'))), F.lit(0)) % 2 == 1
        raw = raw.filter(F.when(cut, F.raise_error(F.concat(
            F.lit(f"{path}: a quoted line break; read it with multiline=True: "), F.col(_RECORD)))).otherwise(F.lit(True)))
    tokens = F.array(*[F.lit(t) for t in S.CSV_NULL_TOKENS])

    def cell(name):
        c = F.col(f"`{place[name]}`")
        return F.when(~F.array_contains(tokens, c), c)

    kinds = {"duration_min": "double", "calories_burned": "double"}
    return raw.select(*[(cell(f.name).try_cast(kinds[f.name]) if f.name in kinds else cell(f.name)).alias(f.name)
                        for f in S.TRAINING_TEXT.fields])


def long_training_rows(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """``record``: the rows of the CSV that have more cells than its header, as they are written."""
    raw, _, too_long = _training_records(spark, path, multiline)
    return raw.filter(too_long).select(F.col(_RECORD).alias("record"))


def _need(names: list[str], path: str) -> None:
    for field in S.TRAINING_TEXT.fields:
        n = sum(name == field.name for name in names)
        if n != 1:
            raise ValueError(f"{path}: column '{field.name}' {'is missing' if n == 0 else 'stands in the header more than once'}")


def _training_records(spark: SparkSession, path: str, multiline: bool):
    """(all cells as text with the raw record of malformed rows, column of each needed name, whether a row is too long)."""
    header = csv_header(spark, path, multiline)
    _need(header, path)
    checked = "" not in header and len({n.lower() for n in header}) == len(header) and _RECORD not in header
    names = header if checked else [f"_{k}" for k in range(len(header))]
    record = T.StructField(_RECORD, T.StringType())
    cells = [T.StructField(n, T.StringType()) for n in names]
    raw = (spark.read.schema(T.StructType([*cells, record])).options(**_CSV).option("header", True)
           .option("multiLine", multiline).option("enforceSchema", not checked)
           .option("columnPruning", False)  # else only the asked cells are counted
           .option("columnNameOfCorruptRecord", _RECORD).csv(path))
    # a malformed record once more, with one place after the header's: filled if the row is longer
    wide = T.StructType([*[T.StructField(f"_{k}", T.StringType()) for k in range(len(header) + 1)]])
    again = F.from_csv(F.col(_RECORD), wide.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "),
                       {**_CSV, "multiLine": "true"})
    more = F.when(F.col(_RECORD).isNotNull(), again.getField(f"_{len(header)}"))
    # always true, for a second column: Spark takes no query of the raw record alone
    some = F.coalesce(F.col(f"`{names[0]}`"), F.lit("")) != F.lit("\u0000")
    return raw, dict(zip(header, names)), F.coalesce((more != "") & some, F.lit(False))


def _path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def is_folder(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath) and fs.getFileStatus(jpath).isDirectory())


def ensure_table(spark: SparkSession, path: str, schema) -> bool:
    """S-4: create an empty table of ``schema`` at ``path`` when absent.

    Returns True when it created the table.  An existing table is left as is.
    """
    if _path_exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.mode("errorifexists").parquet(path)
    return True


def write_snapshot(df: DataFrame, base: str, version: int, partition_by: str | None = None,
                   cluster_by: list[str] | None = None, mark: str = "") -> str:
    """S-5: write ``df`` as version ``version`` under ``base`` and return its path.

    The write goes to a fresh folder (``errorifexists``): a failed job leaves
    the previous version whole, and the table being read is never the one
    being written.  ``cluster_by`` range-partitions and sorts the rows (for
    logs: ``user_id, id``), so each file covers a narrow key range and Parquet
    min/max statistics let owner-scoped reads skip files and row groups; the
    composite key cuts one very active owner over several files.  ``mark``
    ends the folder's name, so that an attempt never meets the rest of another.
    """
    path = os.path.join(base, f"v={int(version):06d}" + (f",{mark}" if mark else ""))
    out = df
    if cluster_by:
        out = out.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    w = out.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return path


def _numbered(spark: SparkSession, base: str, prefix: str) -> list[tuple[int, str]]:
    """(number, path) of the complete folders ``<prefix><number>...`` under ``base``, in ascending order."""
    jvm = spark.sparkContext._jvm
    jbase = jvm.org.apache.hadoop.fs.Path(base)
    fs = jbase.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    if fs.exists(jbase):
        for st in fs.listStatus(jbase):
            m = re.match(re.escape(prefix) + r"(\d+)", st.getPath().getName())
            if m and st.isDirectory() and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                found.append((int(m[1]), os.path.join(base, st.getPath().getName())))
    return sorted(found)


def latest_snapshot(spark: SparkSession, base: str) -> str | None:
    """Path of the newest complete version under ``base`` (has ``_SUCCESS``); versions are numbers."""
    found = _numbered(spark, base, "v=")
    return found[-1][1] if found else None


def changes_of(spark: SparkSession, base: str) -> list[tuple[int, str]]:
    """(number, path) of all committed changes of a changing table, oldest first (see ``changelog``)."""
    from . import changelog

    return [(c["number"], os.path.join(base, c["path"])) for c in changelog.commits_of(spark, base) if c["kind"] == "change"]


def read_current(spark: SparkSession, base: str) -> DataFrame:
    """The log table as of its last commit."""
    from . import changelog

    return changelog.read(spark, base)


def compact(spark: SparkSession, base: str, cluster_by: list[str] | None = None) -> str:
    """Writes the present table as a new snapshot, numbered as the last commit, and returns its path."""
    from . import changelog

    return changelog.compact(spark, base, cluster_by)


def save_model(model, path: str) -> None:
    """S-6: save a fitted model: preprocessing, tree and class names as one artefact."""
    getattr(model, "pipeline", model).write().overwrite().save(path)


def load_model(spark: SparkSession, path: str):
    """S-7: load a fitted model for ``predict`` and ``score``; None when the artefact is absent."""
    from pyspark.ml import PipelineModel

    if not _path_exists(spark, path):
        return None
    return PipelineModel.load(path)
