"""Confidence of mean speedups by a paired bootstrap with Poisson weights.

Each replicate gives every configuration a weight from Poisson(1), drawn by a hash of the
configuration and the replicate's number; both times of a configuration share it, so pairs stay
pairs. Weights depend on nothing but the two numbers: the result is the same on any partitioning and
any engine. Replicates are made next to the rows and summed before they are shuffled: one grouped
pass, one row per implementation and replicate leaves a task.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import MIX_PRIME, mix
from ..session import shuffle_partitions
from .bench import CONFIG, speedups

REPLICATES = 200
#: mix() values below the k-th limit draw a weight of at most k: the distribution function of Poisson(1).
LIMITS = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * MIX_PRIME) for k in range(9)]
STEP = 1_000_003


def configuration_number(*columns) -> Column:
    """A number from a configuration's text, below 2^32."""
    text = F.concat_ws("/", *[F.col(c).cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def poisson_weight(number: Column, replicate: Column) -> Column:
    drawn = mix(number + replicate * STEP)
    return sum((F.when(drawn >= limit, 1).otherwise(0) for limit in LIMITS), F.lit(0)).cast("long")


def speedup_bounds(runs: DataFrame, replicates: int = REPLICATES, tail: int = 25, digits: int = 6) -> DataFrame:
    """impl, configurations, mean, low, high: mean speedup and its bounds (`tail` per mille on each side).

    Replicates in which an implementation has no weight at all are left out of its bounds. The mean
    is a ratio of whole numbers (speedups in units of 10^-digits), so sums don't depend on their order.
    """
    rows = speedups(runs).select(
        "impl", F.round(F.col("speedup") * 10 ** digits).cast("long").alias("s"), configuration_number(*CONFIG).alias("number"))
    # rows are few and short, so their partitions would be merged into one or two before each is repeated
    rows = rows.repartition(shuffle_partitions(runs.sparkSession))
    each = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    # replicate 0 is the plain sample
    weight = F.when(F.col("replicate") == 0, F.lit(1).cast("long")).otherwise(poisson_weight(F.col("number"), F.col("replicate")))
    sums = each.withColumn("w", weight).groupBy("impl", "replicate").agg(
        F.sum(F.col("s") * F.col("w")).alias("t"), F.sum("w").alias("w"))
    means = sums.where("w > 0").select(
        "impl", "replicate", "w", F.expr("t div w").alias("m"))
    order = Window.partitionBy("impl").orderBy("m", "replicate")
    drawn = means.where("replicate > 0").withColumn("at", F.row_number().over(order))
    ends = drawn.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("impl"))).groupBy("impl").agg(
        F.min(F.when(F.col("at") >= F.expr(f"(n * {tail} + 999) div 1000"), F.col("m"))).alias("low"),
        F.min(F.when(F.col("at") >= F.expr(f"(n * {1000 - tail} + 999) div 1000"), F.col("m"))).alias("high"))
    unit = 10.0 ** digits
    return means.where("replicate = 0").join(ends, "impl").select(
        "impl", F.col("w").alias("configurations"), (F.col("m") / unit).alias("mean"), (F.col("low") / unit).alias("low"),
        (F.col("high") / unit).alias("high"))
