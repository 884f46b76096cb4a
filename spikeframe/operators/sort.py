"""Integer sorting: by counting, by window, by range partitioning, and by spiking network.

The network sorts because at tick t its sorters receive cnt(t) = #{x >= t} spikes and
only the sorter tuned to that count fires, so output o gains a spike in every tick with
cnt(t) >= N - o. Summed over t this is the value of rank o, which the counting strategy
gets from a histogram without walking through the ticks.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import int_div
from ..functions.scans import previous_value, ranked
from ..functions.skew import salted_join
from .network import Network
from .simulate import Simulator
from .tick import SEQUENTIAL

EXPAND_BLOCK = 1 << 16
GROUP_LIMIT = 1 << 16
SETTLE_TICKS = 3


def sort_native(df: DataFrame, value, tie_breaker) -> DataFrame:
    """Ascending sort of whole rows with their global position."""
    return ranked(df, [value, tie_breaker], "pos")


def _expand(starts: DataFrame, keep) -> DataFrame:
    """One row per counted element. Large counts are cut into blocks that are dealt out
    before they are expanded, so a hot value is not written by one task."""
    blocks = starts.select(
        *keep, "start", "cnt", F.explode(F.sequence(
            F.lit(0), int_div(F.col("cnt") - 1, EXPAND_BLOCK))).alias("block"))
    first = F.col("start") + F.col("block") * EXPAND_BLOCK
    last = F.least(first + EXPAND_BLOCK, F.col("start") + F.col("cnt")) - 1
    return (blocks.repartition("start", "block")
            .select(F.explode(F.sequence(first, last)).alias("pos"), *keep))


def counting_sort(df: DataFrame, value) -> DataFrame:
    """(pos, value) in ascending order; equal values cost one histogram row."""
    histogram = df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    return _expand(ranked(histogram, ["value"], "start", weight="cnt"), ["value"])


def counting_sort_groups(df: DataFrame, key, value) -> DataFrame:
    """(key, pos, value) ascending inside each group, NULLs first, from one global scan of
    the per-group histograms. A NULL key is a group. The lookup of a group's first place
    is salted, so a hot group with many values is spread like any other rows."""
    histogram = df.groupBy(F.struct(key).alias("_group"), F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("cnt"))
    placed = ranked(histogram, ["_group", "value"], "at", weight="cnt")
    heads = placed.groupBy("_group").agg(F.min("at").alias("head"))
    inside = salted_join(placed, heads, "_group", ["value"]).select(
        "_group", "value", "cnt", F.col("at").alias("start"), "head")
    return _expand(inside, ["_group", "value", "head"]).select(
        f"_group.{key}", (F.col("pos") - F.col("head")).alias("pos"), "value")


def is_sorted(df: DataFrame, position, value) -> DataFrame:
    """One row: number of elements, number of descents, verdict."""
    seen = previous_value(df.select(position, value), position, value, "_previous")
    return seen.agg(F.count(F.lit(1)).alias("n"),
                    F.count_if(F.col(value) < F.col("_previous")).alias("descents")).select(
        "n", "descents", (F.col("descents") == 0).alias("is_sorted"))


def sorting_network(values: DataFrame, n: int) -> Network:
    """Network that sorts ``values(pos, value)``, pos = 0..n-1, values not negative.
    Its synapse table has n*n + n*(n+1)/2 rows by definition."""
    inputs = values.select(F.col("pos").cast("bigint").alias("nid"), F.col("value").alias("initial_spikes"))
    index = inputs.select("nid")
    rest = index.select(F.explode(F.array(F.col("nid") + n, F.col("nid") + 2 * n)).alias("nid"))
    neurons = inputs.unionByName(rest.withColumn("initial_spikes", F.lit(0).cast("bigint"))).withColumn(
        "is_output", F.col("nid") >= 2 * n)
    relay = index.selectExpr("nid", "0 as rule_idx", "1 as threshold", "1 as consumed",
                             "1 as produced", "0 as delay")
    sorters = index.selectExpr("nid as s", f"explode(sequence({n}, 1, -1)) as k").selectExpr(
        f"s + {n} as nid", f"cast({n} - k as int) as rule_idx", "k as threshold", "k as consumed",
        f"if(k = {n} - s, 1, 0) as produced", "0 as delay")
    into = index.selectExpr("nid as source_id", f"explode(sequence({n}L, {2 * n - 1}L)) as dest_id")
    out = index.selectExpr(f"nid + {n} as source_id",
                           f"explode(sequence(nid + {2 * n}, {3 * n - 1}L)) as dest_id")
    return Network(neurons, relay.unionByName(sorters),
                   into.unionByName(out).withColumn("weight", F.lit(1)))


class NetworkSort:
    """Sort by simulation; loading and executing are separate so that runs can be timed."""

    def __init__(self, policy=SEQUENTIAL):
        self.simulator = Simulator(policy)
        self.n = self.offset = self.top = 0

    def load(self, values: DataFrame, value="value", position="pos"):
        """``position`` numbers the rows 0..n-1."""
        low, high, self.n = values.agg(F.min(value), F.max(value), F.count(F.lit(1))).first()
        if self.n == 0:
            return self
        self.offset = max(0, -low)
        self.top = high + self.offset
        shifted = values.select(F.col(position).alias("pos"),
                                (F.col(value) + self.offset).cast("bigint").alias("value"))
        self.simulator.load_system(sorting_network(shifted, self.n), validate=False)
        self.source = values.select(F.col(position).cast("bigint").alias("pos"),
                                    F.col(value).cast("bigint").alias("value"))
        return self

    def execute(self) -> DataFrame:
        if self.n == 0:
            return None
        self.simulator.step(self.top + SETTLE_TICKS)
        state = self.simulator.state.where(F.col("nid") >= 2 * self.n)
        return state.select((F.col("nid") - 2 * self.n).alias("pos"),
                            (F.col("spikes") - self.offset).alias("value"))

    def sort(self, values: DataFrame, value="value", position="pos") -> DataFrame:
        result = self.load(values, value, position).execute()
        return values.select(position, value) if result is None else result

    def performance_report(self):
        return self.simulator.performance_report()


def network_sizes(df: DataFrame, key, value) -> DataFrame:
    """Shape of the sorting network of each group: neurons, rules, synapses, ticks, shift."""
    bounds = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    n, offset = F.col("n"), F.greatest(F.lit(0), -F.col("lo")).cast("bigint")
    return bounds.select(
        key, (3 * n).cast("int").alias("neurons"), (n + n * n).cast("int").alias("rules"),
        (n * n + int_div(n * (n + 1), 2)).cast("int").alias("synapses"),
        (F.col("hi") + offset + SETTLE_TICKS).cast("int").alias("ticks"), offset.alias("offset"))


def sort_groups(df: DataFrame, key, value, group_limit=GROUP_LIMIT) -> DataFrame:
    """(key, pos, value) per group, NULLs first; a NULL key is a group.

    Groups up to the limit are numbered by a window, larger ones by counting; both give
    the same rows, the limit only bounds what one task sorts.
    """
    rows = df.select(F.struct(key).alias("_group"), key, F.col(value).cast("bigint").alias("value"))
    large = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") > group_limit).select("_group")
    inside = Window.partitionBy("_group").orderBy(F.col("value").asc_nulls_first())
    small = rows.join(large, "_group", "left_anti").select(
        key, (F.row_number().over(inside) - 1).cast("bigint").alias("pos"), "value")
    return small.unionByName(counting_sort_groups(rows.join(large, "_group", "left_semi"), key, "value"))
