"""Spiking networks as DataFrames, and their compiled per-neuron form."""

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import int_div
from ..session import cut_lineage, partitions_for, spread

PAGE_SIZE = 4096
SMALL_NETWORK = 100_000

# element that carries a neuron's own state through the delivery: it has no weights
OWN_RECORD = ("named_struct('dest', nid, 'gain', cast(null as bigint), "
              "'net', cast(null as bigint))")


@dataclass(frozen=True)
class Network:
    """Neurons, prioritised rules and weighted synapses.

    ``scope`` names leading key columns when the tables hold many independent
    systems, e.g. ``("system_id",)``; synapses never leave their scope. ``size`` is about the number
    of synapses where it is known: it makes more partitions of large networks, never other results.
    """
    neurons: DataFrame
    rules: DataFrame
    synapses: DataFrame
    scope: tuple = ()
    size: int = 0

    @property
    def keys(self):
        return [*self.scope, "nid"]

    def rule_count(self) -> DataFrame:
        return self.rules.agg(F.count(F.lit(1)).alias("total_rules"))

    def problems(self) -> DataFrame:
        """One row per kind of defect with the number of offending rows."""
        ids = self.neurons.select(*self.keys)
        scope = list(self.scope)

        def strays(table, column):
            ends = table.select(*scope, F.col(column).alias("nid"))
            return ends.join(ids, self.keys, "left_anti")

        def nulls(table, columns):
            return table.where(" or ".join(f"{c} is null" for c in columns))

        checks = {
            "null neuron field": nulls(self.neurons, [*self.keys, "initial_spikes"]),
            "null rule field": nulls(self.rules, [*self.keys, "rule_idx", "threshold", "consumed",
                                                  "produced", "delay"]),
            "null synapse field": nulls(self.synapses, [*scope, "source_id", "dest_id", "weight"]),
            "duplicate neuron": ids.groupBy(*self.keys).count().where("count > 1"),
            "duplicate rule position": self.rules.groupBy(*self.keys, "rule_idx").count()
                                                 .where("count > 1"),
            "negative production": self.rules.where("produced < 0"),
            "negative delay": self.rules.where("delay < 0"),
            "rule of unknown neuron": strays(self.rules, "nid"),
            "synapse from unknown neuron": strays(self.synapses, "source_id"),
            "synapse to unknown neuron": strays(self.synapses, "dest_id"),
        }
        found = None
        for name, bad in checks.items():
            row = bad.agg(F.lit(name).alias("problem"), F.count(F.lit(1)).alias("n"))
            found = row if found is None else found.unionAll(row)
        return found

    def validate(self):
        """Raise on defects; at most one row per check reaches the driver."""
        bad = self.problems().where("n > 0").collect()
        if bad:
            raise ValueError("; ".join(f"{r.problem}: {r.n}" for r in bad))
        return self


@dataclass(frozen=True)
class CompiledNetwork:
    """Static side of a tick, hash partitioned by neuron and cached in that layout.

    ``static`` has one row per neuron. Its lists are inlined while every neuron fits
    one page; beyond that it only holds page counts, and the lists live in
    ``rule_pages`` / ``out_pages`` keyed by (neuron, page), so a hub's lists are
    spread over many tasks. Paged rules imply paged synapses.
    """
    static: DataFrame
    rule_pages: DataFrame | None = None
    out_pages: DataFrame | None = None
    scope: tuple = ()
    keys: list = field(default_factory=lambda: ["nid"])

    def release(self):
        for table in (self.static, self.rule_pages, self.out_pages):
            if table is not None:
                table.unpersist()

    def initial_state(self) -> DataFrame:
        return self.static.select(
            *self.keys, F.col("initial_spikes").cast("bigint").alias("spikes"),
            F.lit(0).alias("timer"), F.lit(True).alias("is_open"), F.lit(0).alias("pending"))


def combined_synapses(network: Network) -> DataFrame:
    """Parallel synapses folded into one row: production is never negative, so the sum
    of the positive weights and the sum of all weights carry everything a tick needs."""
    ends = [*network.scope, "source_id", "dest_id"]
    return (spread(network.synapses, network.size, *ends).groupBy(*ends)
            .agg(F.sum(F.greatest("weight", F.lit(0))).cast("bigint").alias("gain"),
                 F.sum("weight").cast("bigint").alias("net")))


def _out_lists(network, edges, page_size, paged, parts=None):
    """Synapse lists per source, cut into pages for hubs. Hub pages hash the destination,
    and the hub list is joined under Spark's own size check and skew handling.
    With ``parts`` the unpaged lists are built in that many hash partitions."""
    source = [*network.scope, "source_id"]
    item = F.struct(F.col("dest_id").alias("dest"), "gain", "net")
    if not paged:
        placed = edges.repartition(parts, *source) if parts else edges
        lists = placed.groupBy(*source).agg(F.collect_list(item).alias("outs"))
        return lists.withColumnRenamed("source_id", "nid")
    degree = edges.groupBy(*source).agg(F.count(F.lit(1)).alias("_deg"))
    hubs = (degree.where(F.col("_deg") > page_size)
            .select(*source, (int_div("_deg", page_size) + 1).alias("_pages")))
    pages = F.coalesce("_pages", F.lit(1))
    return (edges.join(hubs, source, "left")
            .withColumn("page", F.pmod(F.xxhash64("dest_id"), pages).cast("int"))
            .groupBy(*source, "page").agg(F.collect_list(item).alias("outs"))
            .withColumnRenamed("source_id", "nid"))


def _rule_lists(network, page_size, paged):
    rule = F.struct("rule_idx", "threshold", "consumed", "produced", "delay")
    page = [int_div("rule_idx", page_size).cast("int").alias("page")] if paged else []
    rules = network.rules if paged else spread(network.rules, network.size, *network.keys)
    return (rules.groupBy(*network.keys, *page)
            .agg(F.array_sort(F.collect_list(rule)).alias("rules")))


def _resident(df, keys):
    """Cache a static table in its join layout; a lost block is rebuilt from its sources.
    Filling the cache here lets the planner see the layout when ticks are planned."""
    cached = df.sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)
    cached.count()
    return cached


def _measure(network, edges):
    """Longest synapse and rule list of a neuron, and the size of the network (one row)."""
    degrees = edges.groupBy(*network.scope, "source_id").agg(F.count(F.lit(1)).alias("n"))
    sizes = degrees.agg(F.coalesce(F.max("n"), F.lit(0)).alias("out"),
                        F.coalesce(F.sum("n"), F.lit(0)).alias("synapses"))
    rules = network.rules.agg(F.coalesce(F.max("rule_idx") + 1, F.lit(0)))
    neurons = network.neurons.agg(F.count(F.lit(1)))
    return sizes.select("out", "synapses", rules.scalar().alias("rules"),
                        neurons.scalar().alias("neurons")).first()


def compile_network(network: Network, page_size=PAGE_SIZE) -> CompiledNetwork:
    keys = network.keys
    edges = cut_lineage(combined_synapses(network))
    size = _measure(network, edges)
    parts = partitions_for(network.neurons.sparkSession, size.synapses)
    paged_rules = size.rules > page_size
    paged_outs = paged_rules or size.out > page_size
    small = size.neurons + size.synapses <= SMALL_NETWORK
    sides = []
    for name, lists, paged in (("rules", _rule_lists(network, page_size, paged_rules), paged_rules),
                               ("outs", _out_lists(network, edges, page_size, paged_outs,
                                                   None if small else parts), paged_outs)):
        pages = None
        if paged:
            by_page = [*keys, "page"]
            pages = _resident(lists.repartition(parts, *by_page), by_page)
            lists = pages.groupBy(*keys).agg((F.max("page") + 1).alias(f"n_{name}"))
        sides.append((lists, pages))
    (rules, rule_pages), (outs, out_pages) = sides
    if not small:
        rules, outs = rules.hint("merge"), outs.hint("merge")
    static = (network.neurons.select(*keys, "initial_spikes")
              .join(rules, keys, "left").join(outs, keys, "left")
              .selectExpr(*keys, "initial_spikes",
                          "coalesce(n_rules, 0) as n_rules" if paged_rules else "rules",
                          "coalesce(n_outs, 0) as n_outs" if paged_outs else
                          f"concat(array({OWN_RECORD}), coalesce(outs, array())) as outs"))
    # Large tables keep the partition count of the state's shuffle, so that their join needs
    # none. Unpaged lists were already placed that way, and the merge joins above keep their
    # layout; a small network may be merged and is then broadcast under Spark's size check.
    if paged_outs and not small:
        static = static.repartition(parts, *keys)
    return CompiledNetwork(static=_resident(static, keys),
                           rule_pages=rule_pages, out_pages=out_pages, scope=network.scope, keys=keys)
