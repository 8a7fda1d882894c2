"""Ordered running sums within a group, without a window over the whole group.

A running sum over a site's pages in reading order would put the whole site
in one window task. Instead the rows are range-partitioned on (group, order):
Spark splits a large group over many partitions by its order keys. Each
partition computes local running sums; the per-(partition, group) totals --
at most one row per partition a group spans -- give every partition its
starting offset. The range-partitioned data is checkpointed so the partition
ids are stable and an executor loss recomputes from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _ranged(df: DataFrame, group: str, order: list[str], n_partitions: int | None) -> DataFrame:
    """``df`` range-partitioned and written, with its partition ids. Without a
    number the session's shuffle width holds, which AQE narrows by size."""
    dealt = df.repartitionByRange(n_partitions, group, *order) if n_partitions else df.repartitionByRange(group, *order)
    return cut_lineage(dealt.withColumn("_pid", F.spark_partition_id()))


def exclusive_running_sum(df: DataFrame, group: str, order: list[str], value: str, out: str,
                          n_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = sum of ``value`` over earlier rows of the same ``group``
    in ``order`` (ties must not occur in ``order``)."""
    ranged = _ranged(df, group, order, n_partitions)
    totals = ranged.groupBy("_pid", group).agg(F.sum(value).alias("_tot"))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", group, F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_base"))
    local = Window.partitionBy("_pid", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    with_local = ranged.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
    return with_local.join(offsets, ["_pid", group]).withColumn(
        out, (F.col("_base") + F.col("_local")).cast("long")).drop("_pid", "_local", "_base")


def neighbor_value(df: DataFrame, group: str, order: list[str], value: str, out: str,
                   direction: str = "prev", n_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = ``value`` of the previous (``prev``) or next (``next``)
    row of the same ``group`` in ``order`` -- ``lag``/``lead`` without a
    window over the whole group.

    Local lag/lead runs per (range partition, group); the first (last) row of
    each piece takes the carried value of the nearest earlier (later)
    partition holding the group: one row per partition a group spans.
    """
    ranged = _ranged(df, group, order, n_partitions)
    key = F.struct(*order)
    if direction == "prev":
        local = Window.partitionBy("_pid", group).orderBy(*order)
        edge = ranged.groupBy("_pid", group).agg(F.max_by(value, key).alias("_edge"))
        carry = edge.select("_pid", group, F.lag("_edge").over(Window.partitionBy(group).orderBy("_pid")).alias("_carry"))
        step = F.lag(value).over(local)
    elif direction == "next":
        local = Window.partitionBy("_pid", group).orderBy(*[F.col(c).desc() for c in order])
        edge = ranged.groupBy("_pid", group).agg(F.min_by(value, key).alias("_edge"))
        carry = edge.select("_pid", group, F.lead("_edge").over(Window.partitionBy(group).orderBy("_pid")).alias("_carry"))
        step = F.lag(value).over(local)
    else:
        raise ValueError(direction)
    marked = ranged.withColumn("_step", step).withColumn("_rn", F.row_number().over(local))
    return (marked.join(carry, ["_pid", group])
            .withColumn(out, F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_step")))
            .drop("_pid", "_step", "_rn", "_carry"))


def dense_number(df: DataFrame, order: list, out: str, group: str | None = None, start: int = 0) -> DataFrame:
    """Add ``out``: each row's place (from ``start``, without gaps) by ``order``
    in its ``group``, or in the whole table.

    ``order`` are column names or sort expressions (``F.desc("time")``); equal
    rows are told apart arbitrarily. Rows are range-partitioned by the order
    and written with their partition; a partition numbers its own rows, and the
    counts of the partitions before it, one row per partition and group, are
    carried over. No window holds more than a partition's share."""
    keys = [*([group] if group else []), *order]
    tied = df.withColumn("_row", F.monotonically_increasing_id())
    ranged = cut_lineage(tied.repartitionByRange(*keys, "_row").withColumn("_pid", F.spark_partition_id()))
    own = ["_pid", *([group] if group else [])]
    counts = ranged.groupBy(*own).agg(F.count("*").alias("_n"))
    before = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row a partition (and group): the only rows that meet in one place.
    bases = counts.select(F.col("_pid").alias("_p"), *([F.col(group).alias("_g")] if group else []), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy(*own).orderBy(*order, "_row"))
    on = ranged["_pid"] == bases["_p"]
    if group:
        on = on & ranged[group].eqNullSafe(bases["_g"])
    numbered = ranged.withColumn("_local", local).join(bases, on)
    return numbered.withColumn(out, (F.col("_base") + F.col("_local") + (start - 1)).cast("long")).drop("_row", "_pid", "_p", "_g", "_local", "_base")
