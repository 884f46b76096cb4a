"""Equi join that spreads hot keys."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import partitions_for, spread


def salted_join(left: DataFrame, right: DataFrame, keys, salt_by, key_sizes=None, rows=0, merged=False) -> DataFrame:
    """Inner join on ``keys`` where keys that hold more than an even share of ``left``
    are split by a hash of ``salt_by`` and their ``right`` rows repeated per split.

    At most ``parts`` keys can exceed a 1/parts share, which bounds the broadcast list.
    ``key_sizes`` is a table whose rows per key stand for ``left``'s where ``left`` is
    costly to compute twice; it only steers the split, never the result. ``rows``, about
    ``left``'s, makes more parts than the session's where they are many. ``merged`` sorts
    and merges the sides whatever Spark takes their size for: it leaves out the rows that
    explode() adds, and would send a side to every task, through the driver, that is many
    times the size allowed for that.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    spark = left.sparkSession
    parts = partitions_for(spark, rows)
    counts = (left if key_sizes is None else key_sizes).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # one pass finds both the total and the keys above an even share, at most ``parts`` of them
    seen = Observation()
    top = counts.observe(seen, F.sum("_n").alias("total")).orderBy(F.desc("_n")).limit(parts).collect()
    total = seen.get["total"] or 0
    hot_rows = [(*[r[k] for k in keys], min(parts, r["_n"] * parts // total + 1)) for r in top if r["_n"] * parts > total]
    if not hot_rows:
        if merged:  # dealt out as well: a grouping by the keys would keep its own few parts, for both sides
            right = spread(right, rows, *keys).hint("merge")
        return spread(left, rows, *keys).join(right, keys)
    schema = T.StructType([counts.schema[k] for k in keys] + [T.StructField("_splits", T.LongType())])
    hot = F.broadcast(spark.createDataFrame(hot_rows, schema))
    splits = F.coalesce("_splits", F.lit(1))
    salted = (left.join(hot, keys, "left")
              .withColumn("_salt", F.pmod(F.xxhash64(*salt_by), splits).cast("int"))
              .drop("_splits"))
    repeated = (right.join(hot, keys, "left")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), (splits - 1).cast("int"))))
              .drop("_splits"))
    return spread(salted, rows, *keys, "_salt").join(
        repeated.hint("merge") if merged else repeated, [*keys, "_salt"]).drop("_salt")
