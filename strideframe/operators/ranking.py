"""Running totals per group in a given order, without whole groups in one task.

A window ``partitionBy(group).orderBy(order)`` sends every row of a group to
one task; one hot group (a user with a third of all logs, a feature with
millions of distinct values) then runs on a single core and may not fit its
memory.  ``running_totals`` computes the same result, for every input size in
the same way and with built-in functions only:

1. range-partition on ``(group, order)``.  The range partitioner samples the
   composite key, so a hot group is cut into several partitions of similar
   size.  Each row keeps its partition's number; the result is checkpointed
   to the shared checkpoint folder, so the numbers hold when a task is retried
   on another executor.
2. a window per (partition number, group) gives the totals inside the
   partition; its largest input is one range partition.
3. a group that continues from earlier partitions can only be the *first*
   group of a partition, so at most one offset row exists per partition.
   Offsets are a sum over earlier partitions of the group's totals; the table
   has at most ``num_partitions`` rows and is broadcast on that bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint

PID = "_rt_pid"
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def running_totals(df: DataFrame, group: list[str], order: list[Column | str],
                   values: list[str], outs: list[str] | None = None,
                   num_partitions: int | None = None) -> DataFrame:
    """Add inclusive running sums of ``values`` per ``group`` in ``order``.

    ``values`` must be numeric column names (nulls count as 0); ``outs`` are
    the output names (default ``cum_<value>``).  Output types are long for
    integral inputs (exact), double otherwise.  A null group key is a group
    like any other.  Rows that tie in ``order`` follow each other in any order.
    """
    outs = outs or [f"cum_{v}" for v in values]
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    sort_cols = [F.col(g) for g in group] + order_cols
    kinds = ["long" if isinstance(df.schema[v].dataType, _INTEGRAL) else "double" for v in values]
    addends = [F.coalesce(F.col(v).cast(k), F.lit(0).cast(k)) for v, k in zip(values, kinds)]

    ranged = checkpoint(df.repartitionByRange(n, *sort_cols).withColumn(PID, F.spark_partition_id()))
    within = Window.partitionBy(PID, *group).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(a).over(within).alias(o) for a, o in zip(addends, outs)])

    # The first group of each partition is the only one that can continue
    # from earlier partitions; each partition holds at most two such groups
    # (its first and its last), so every table below has O(num_partitions) rows.
    key = [f"_g{i}" for i in range(len(group))]
    first = ranged.groupBy(PID).agg(F.min(F.struct(*group)).alias("_first")).select(
        F.col(PID).alias("_pid"), *[F.col(f"_first.{g}").alias(k) for g, k in zip(group, key)])

    def same_group() -> Column:
        return reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, key)])

    totals = (ranged.join(F.broadcast(first.select(*key).distinct()), same_group(), "left_semi")
              .groupBy(PID, *group).agg(*[F.sum(a).alias(f"_off{i}") for i, a in enumerate(addends)]))
    earlier = Window.partitionBy(*group).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(PID, *group, *[F.sum(f"_off{i}").over(earlier).alias(f"_off{i}") for i in range(len(values))])
    offsets = before.join(F.broadcast(first), (F.col(PID) == F.col("_pid")) & same_group()).select(
        "_pid", *key, *[f"_off{i}" for i in range(len(values))])
    joined = local.join(F.broadcast(offsets), (F.col(PID) == F.col("_pid")) & same_group(), "left")
    return joined.select(
        *df.columns,
        *[(F.col(o) + F.coalesce(F.col(f"_off{i}"), F.lit(0).cast(k))).alias(o)
          for i, (o, k) in enumerate(zip(outs, kinds))])
