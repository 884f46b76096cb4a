"""Ordered scans without a single-task window.

Each scan works in two steps: a window inside blocks of bounded width, plus the
same scan over one summary row per block. The summaries shrink by the block width
at every level, so only the last level is handled by one task.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_partitions
from .columns import int_div

BLOCK = 1 << 16


def running_total(df: DataFrame, key, value, out, levels=2, width=BLOCK) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller unique integer ``key``."""
    if levels == 0:
        before = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("bigint"))
    block, total, offset, within = (f"_{n}{levels}" for n in ("block", "total", "offset", "within"))
    blocked = df.withColumn(block, int_div(key, width))
    totals = blocked.groupBy(block).agg(F.sum(value).alias(total))
    offsets = running_total(totals, block, total, offset, levels - 1, width).select(block, offset)
    inside = Window.partitionBy(block).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (blocked.withColumn(within, F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(offsets, block)
            .withColumn(out, (F.col(offset) + F.col(within)).cast("bigint"))
            .drop(block, offset, within))


def previous_value(df: DataFrame, key, value, out, levels=2, width=BLOCK) -> DataFrame:
    """``value`` of the row with the next smaller unique integer ``key``."""
    if levels == 0:
        return df.withColumn(out, F.lag(value).over(Window.orderBy(key)))
    block, last, carried, within, head = (
        f"_{n}{levels}" for n in ("block", "last", "carried", "within", "head"))
    blocked = df.withColumn(block, int_div(key, width))
    lasts = blocked.groupBy(block).agg(F.max_by(value, key).alias(last))
    carry = previous_value(lasts, block, last, carried, levels - 1, width).select(block, carried)
    inside = Window.partitionBy(block).orderBy(key)
    return (blocked.withColumn(within, F.lag(value).over(inside))
            .withColumn(head, F.row_number().over(inside) == 1)
            .join(carry, block)
            .withColumn(out, F.when(F.col(head), F.col(carried)).otherwise(F.col(within)))
            .drop(block, carried, within, head))


def slot_numbers(df: DataFrame, group, key, out, width=BLOCK) -> DataFrame:
    """0-based position of each row inside its group, ordered by an integer key that
    is unique in the group. A hot group is spread over its key blocks."""
    group = [group] if isinstance(group, str) else list(group)
    blocked = df.withColumn("_block", int_div(key, width))
    counts = blocked.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy(*group).orderBy("_block")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*group, "_block",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_block").orderBy(key)
    return (blocked.withColumn("_inside", F.row_number().over(inside) - 1)
            .join(offsets, [*group, "_block"])
            .withColumn(out, (F.col("_offset") + F.col("_inside")).cast("bigint"))
            .drop("_block", "_offset", "_inside"))


def ranked(df: DataFrame, order, out, weight=None) -> DataFrame:
    """Global 0-based rank (or exclusive running sum of ``weight``) in ``order``.

    Rows are range partitioned once and written to the checkpoint folder, so the
    partition numbers seen by the two readers agree. ``order`` should end in a
    tie-breaker: then a value that fills a third of the rows is split as well.
    """
    parts = shuffle_partitions(df.sparkSession)
    placed = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .withColumn("_mid", F.monotonically_increasing_id()))
    placed = cut_lineage(placed)
    pid = F.shiftright("_mid", 33)
    if weight is None:
        local = F.col("_mid").bitwiseAND((1 << 33) - 1)
        totals = placed.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
        placed = placed.withColumn("_pid", pid).withColumn("_inside", local)
    else:
        placed = placed.withColumn("_pid", pid)
        inside = (Window.partitionBy("_pid").orderBy("_mid")
                  .rowsBetween(Window.unboundedPreceding, -1))
        totals = placed.groupBy("_pid").agg(F.sum(weight).alias("_n"))
        placed = placed.withColumn("_inside", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    # one row per range partition: the count is fixed by the session setting above
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return (placed.join(F.broadcast(offsets), "_pid")
            .withColumn(out, (F.col("_offset") + F.col("_inside")).cast("bigint"))
            .drop("_mid", "_pid", "_offset", "_inside"))
