"""Points in intervals by equality on bins, never by comparing all with all.

An interval belongs to the level whose bins are at least as long as it is, so it touches at most two
bins there; a point has one bin on every level that has intervals (at most about 60). Intervals'
lengths may thus differ by any factor. Bins that hold more than their share are split by the salted join.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import salted_join


def interval_join(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, finest: int = 0) -> DataFrame:
    """All columns of both sides where low <= at <= high; whole numbers; NULLs and empty intervals match nothing.

    Columns of the two sides must have different names. Bins of the finest level are 2^finest long.
    """
    length = F.col(high) - F.col(low) + 1
    level = F.greatest(F.length(F.regexp_replace(F.bin(length - 1), "^0+", "")), F.lit(finest))
    placed = intervals.where(F.col(low) <= F.col(high)).withColumn("_level", level)
    first, last = (F.call_function("shiftright", F.col(c), F.col("_level")) for c in (low, high))
    placed = placed.withColumn("_bin", F.explode(F.array_distinct(F.array(first, last))))
    # a handful of numbers: lengths have at most 63 bits
    levels = sorted(r[0] for r in intervals.where(F.col(low) <= F.col(high)).select(level.alias("l")).distinct().collect())
    if not levels:
        return points.join(intervals, F.lit(False))
    spread = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)))).withColumn(
        "_bin", F.call_function("shiftright", F.col(at).cast("long"), F.col("_level")))
    return salted_join(spread, placed, ["_level", "_bin"], [at]).where(
        F.col(at).between(F.col(low), F.col(high))).drop("_level", "_bin")


#: How totals of points and totals of parts are formed.
TOTALS = {"count": (F.count, F.sum), "sum": (F.sum, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def interval_totals(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, by: list, totals: dict) -> DataFrame:
    """The columns `by` of the intervals with totals of the points inside, where there are any.

    `totals` names each total: (one of TOTALS, column of the points). Points and intervals never meet: bins of length
    1, 2, 4, ... hold totals of their points, and an interval is cut into the fewest bins, two of each length
    at most. Rows thus grow with points plus intervals times the logarithm of the longest, not with the pairs.
    """
    kept = intervals.where(F.col(low) <= F.col(high))
    length = F.col(high).cast("long") - F.col(low) + 1
    # at its two ends together an interval has about one bin of each length
    longest, about = kept.agg(F.coalesce(F.max(length), F.lit(1)), F.coalesce(F.sum(F.log2(length) + 1), F.lit(0)).cast("long")).first()
    levels = F.explode(F.sequence(F.lit(0), F.lit(longest.bit_length() - 1)))
    own = points.where(F.col(at).isNotNull()).groupBy(F.col(at).cast("long").alias("_bin")).agg(
        *[TOTALS[kind][0](F.col(c)).alias(name) for name, (kind, c) in totals.items()])
    merged = [TOTALS[kind][1](name).alias(name) for name, (kind, _) in totals.items()]
    bins = own.withColumn("_level", levels).withColumn("_bin", F.call_function("shiftright", F.col("_bin"), F.col("_level"))).groupBy(
        "_level", "_bin").agg(*merged)
    # bins [first, stop) of a level lie inside; an odd one at either end is no half of a longer one inside
    whole = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_level"))
    cut = kept.select(*by, F.col(low).cast("long").alias("_low"), F.col(high).cast("long").alias("_high"), levels.alias("_level")).select(
        *by, "_level", F.call_function("shiftright", F.col("_low") + whole - 1, F.col("_level")).alias("_first"),
        F.call_function("shiftright", F.col("_high") + 1, F.col("_level")).alias("_stop")).where("_first < _stop")
    pieces = cut.select(*by, "_level", F.explode(F.array(
        F.when(F.col("_first").bitwiseAND(1) == 1, F.col("_first")),
        F.when(F.col("_stop").bitwiseAND(1) == 1, F.col("_stop") - 1))).alias("_bin")).where("_bin IS NOT NULL")
    # either side has many rows for one of its table's, which estimates of its size leave out
    return salted_join(pieces, bins, ["_level", "_bin"], by, rows=about, merged=True).groupBy(*by).agg(*merged)
