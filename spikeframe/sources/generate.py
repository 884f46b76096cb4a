"""Synthetic workloads: integer sequences in six distributions, and the demo matrix."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import int_div, mix, uniform_int
from ..operators.chains import follow
from ..operators.sort import counting_sort
from ..session import cut_lineage

# Distribution labels used in benchmark names.
RANDOM, SORTED, REVERSE_SORTED = "Random", "Sorted", "Reverse"
NEARLY_SORTED, FEW_UNIQUE, UNIFORM = "NearlySorted", "FewUnique", "Uniform"
DISTRIBUTIONS = (RANDOM, SORTED, REVERSE_SORTED, NEARLY_SORTED, FEW_UNIQUE, UNIFORM)

FEISTEL_ROUNDS = 4


def _draws(spark, size, max_value, dist, seed):
    rows = spark.range(size).withColumnRenamed("id", "pos")
    if dist == UNIFORM:
        value = uniform_int(F.lit(0), max_value, seed)
    elif dist == FEW_UNIQUE:
        # the pool is a function of the slot number, so no row looks it up
        pool = max(2, max_value // 10)
        slot = mix("pos", seed) % pool
        value = uniform_int(slot, max_value, seed + 1) % max(max_value, 1)
    else:
        value = uniform_int("pos", max_value, seed)
    return rows.select("pos", value.alias("value"))


def swap_partner(pos, size, seed):
    """Mirror position around a seeded centre: an involution without fixed order, so
    chosen pairs are disjoint and every row finds its partner by itself."""
    centre = F.lit(seed).cast("bigint") * 7919 + int_div(F.lit(size), 3)
    return F.pmod(centre - F.col(pos), F.lit(size).cast("bigint"))


def generate(spark: SparkSession, size: int, max_value: int, dist=RANDOM, seed=42) -> DataFrame:
    """(pos, value): ``size`` integers in [0, max_value]."""
    if dist not in DISTRIBUTIONS:
        raise ValueError(f"unknown distribution {dist!r}")
    draws = _draws(spark, size, max_value, dist, seed)
    if dist in (RANDOM, UNIFORM, FEW_UNIQUE):
        return draws
    ordered = counting_sort(draws, "value")
    if dist == REVERSE_SORTED:
        return ordered.select((F.lit(size - 1) - F.col("pos")).alias("pos"), "value")
    if dist == NEARLY_SORTED:
        # size/2 mirror pairs, one in five swapped: size/10 swaps on average
        partner = swap_partner("pos", size, seed)
        swapped = mix(F.least(F.col("pos"), partner), seed + 2) % 5 == 0
        return ordered.select(F.when(swapped, partner).otherwise(F.col("pos")).alias("pos"), "value")
    return ordered


def permuted(pos, size, seed) -> Column:
    """A keyed permutation of 0..size-1: a Feistel network over rows and columns of a near square.

    The rectangle has fewer than sqrt(size)+1 places too many. A position that falls on one of them
    walks on along its cycle, which after at most that many steps is back inside.
    """
    size = F.lit(size).cast("bigint") if isinstance(size, int) else size
    high = F.greatest(F.ceil(F.sqrt(size.cast("double"))).cast("bigint"), F.lit(1).cast("bigint"))
    wide = F.greatest(int_div(size + high - 1, high), F.lit(1).cast("bigint"))

    def step(x):
        def turn(p, k):
            """Rows move by a hash of the column, then columns by a hash of the row."""
            row, column = (p["r"] + mix(p["c"], k + seed)) % high, (p["c"] + mix(p["r"], k + seed)) % wide
            return F.when(k % 2 == 0, F.struct(row.alias("r"), p["c"].alias("c"))).otherwise(
                F.struct(p["r"].alias("r"), column.alias("c")))

        return F.aggregate(F.sequence(F.lit(0), F.lit(2 * FEISTEL_ROUNDS - 1)), F.struct(
            int_div(x, wide).alias("r"), (x % wide).alias("c")), turn, lambda p: p["r"] * wide + p["c"])

    def inside(x):
        return F.when(x < size, x)

    def walk(x):
        return F.aggregate(F.sequence(F.lit(1).cast("bigint"), high), x, lambda y, _: F.when(y < size, y).otherwise(step(y)))

    first = F.transform(F.array(step(F.col(pos) if isinstance(pos, str) else pos)), lambda x: F.coalesce(inside(x), walk(x)))
    return F.element_at(first, 1)


def swapped_positions(swaps: DataFrame) -> DataFrame:
    """pos, to: where sequential swaps (step, x, y) leave what stood at pos; untouched positions are absent.

    What leaves a step at a position enters the next step that touches it and leaves that at the
    other position: a chain of steps, followed to its end by pointer jumping.
    """
    swaps = swaps.where("x <> y")
    touched = swaps.select("step", F.col("x").alias("pos"), F.col("y").alias("other")).union(
        swaps.select("step", F.col("y").alias("pos"), F.col("x").alias("other")))
    order = Window.partitionBy("pos").orderBy("step")
    # visit: entering `step` at `pos`; leaving it at `other`
    visits = touched.withColumn("first", F.row_number().over(order) == 1)
    following = touched.select("pos", "step", F.lead("step").over(order).alias("later"))
    node = F.col("step") * 2
    leaving = touched.select("step", F.col("pos").alias("entered"), F.col("other").alias("pos")).join(
        following, ["pos", "step"]).select(
        (node + (F.col("entered") > F.col("pos")).cast("int")).alias("node"), "pos", "later")
    sides = touched.select(F.col("step").alias("later"), "pos", (node + (F.col("pos") > F.col("other")).cast("int")).alias("next"))
    links = cut_lineage(leaving.join(sides, ["pos", "later"], "left").select("node", "pos", "next"))
    ends = follow(links.select("node", "next")).join(links.select(F.col("node").alias("last"), F.col("pos").alias("to")), "last")
    start = visits.where("first").select("pos", (node + (F.col("pos") > F.col("other")).cast("int")).alias("node"))
    return start.join(ends.select("node", "to"), "node").select("pos", "to")


def arrange(values: DataFrame, dist=RANDOM, pool=100, seed=42) -> DataFrame:
    """(pos, value): a table's own values, at positions 0..n-1, in one of the arrangements.

    Random order is a keyed permutation of the positions; nearly sorted is the sorted order after
    n/10 swaps of random positions, one after the other.
    """
    if dist not in DISTRIBUTIONS:
        raise ValueError(f"unknown distribution {dist!r}")
    size = values.agg(F.count(F.lit(1))).scalar()
    if dist == RANDOM:
        return values.withColumn("_n", size).select(permuted("pos", F.col("_n"), seed).alias("pos"), "value")
    if dist == FEW_UNIQUE:
        return values.select("pos", (F.col("value") % pool).alias("value"))
    if dist == UNIFORM:
        return values.select("pos", values.agg(F.min_by("value", "pos")).scalar().alias("value"))
    ordered = counting_sort(values, "value")
    if dist == REVERSE_SORTED:
        return ordered.select((size - 1 - F.col("pos")).alias("pos"), "value")
    if dist == NEARLY_SORTED:
        # every tenth position numbers a swap
        swaps = values.where("pos % 10 = 9").select(int_div("pos", 10).alias("step")).withColumn("_n", size).select(
            "step", (mix("step", seed + 2) % F.col("_n")).alias("x"), (mix("step", seed + 3) % F.col("_n")).alias("y"))
        moved = swapped_positions(swaps)
        return ordered.join(moved, "pos", "left").select(F.coalesce("to", "pos").alias("pos"), "value")
    return ordered


def demo_rows(ids: DataFrame, columns: int) -> DataFrame:
    """The demo rule for given row numbers ``i``."""
    return ids.select(F.col("i").cast("bigint").alias("i"), F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.lit(columns - 1).cast("bigint"))).alias("j")).select(
        "i", "j", (((F.col("i") * columns + F.col("j")) % 10) * F.lit(0.1)).alias("v"))


def demo_matrix(spark: SparkSession, rows: int, columns: int) -> DataFrame:
    """(i, j, v) with v = (row-major index % 10) * 0.1."""
    index = F.col("id")
    return spark.range(rows * columns).select(
        int_div(index, columns).alias("i"), (index % columns).alias("j"),
        ((index % 10) * F.lit(0.1)).alias("v"))
