"""The clock loop and the simulator object."""

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .network import PAGE_SIZE, Network, compile_network
from .tick import SEQUENTIAL, deliver, fire, tick

CUT_EVERY = 8


def advance(state, net, ticks, policy=SEQUENTIAL, cut_every=CUT_EVERY) -> DataFrame:
    """State after ``ticks`` more ticks. Plans stay lazy up to ``cut_every`` ticks."""
    for k in range(ticks):
        state = tick(state, net, policy)
        if (k + 1) % cut_every == 0 and k + 1 < ticks:
            state = cut_lineage(state)
    return state


def trace(state, net, ticks, policy=SEQUENTIAL) -> DataFrame:
    """All states C(0)..C(ticks) with the tick number ``k``; every tick is
    materialised once and read by the next one and by the result."""
    frames = [state.withColumn("k", F.lit(0))]
    for k in range(1, ticks + 1):
        state = cut_lineage(tick(state, net, policy))
        frames.append(state.withColumn("k", F.lit(k)))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def spiking_vector(state, net, policy=SEQUENTIAL) -> DataFrame:
    """Index of the rule each neuron would fire in the next tick, -1 for none."""
    return fire(state, net, policy).select(
        *net.keys, F.coalesce("rule_idx", F.lit(-1)).alias("rule_idx"))


def is_quiet(state, net, policy=SEQUENTIAL) -> bool:
    """True when no rule applies and no delay is running."""
    busy = fire(state, net, policy).where(
        F.col("rule_idx").isNotNull() | (F.col("timer") > 0) | (F.col("delayed") > 0))
    return busy.isEmpty()


class Simulator:
    """Load a network once, then step, read, reset and report."""

    def __init__(self, policy=SEQUENTIAL, page_size=PAGE_SIZE, cut_every=CUT_EVERY):
        self.policy, self.page_size, self.cut_every = policy, page_size, cut_every
        self.network = self.net = self.state = None
        self._clear_metrics()

    def _clear_metrics(self):
        self.steps, self.compute_ms = 0, 0.0

    def load_system(self, network: Network, validate=True) -> bool:
        self.network = network.validate() if validate else network
        if self.net is not None:
            self.net.release()
        self.net = compile_network(network, self.page_size)
        self.reset()
        return True

    def step(self, steps=1):
        """Run ticks now; the new state is written before the call returns."""
        if steps <= 0:
            return self
        started = time.perf_counter()
        self.state = cut_lineage(
            advance(self.state, self.net, steps, self.policy, self.cut_every))
        self.compute_ms += (time.perf_counter() - started) * 1000.0
        self.steps += steps
        return self

    def run_until_quiet(self, limit):
        """Step until no rule applies and no delay runs, at most ``limit`` ticks. The
        check runs once per lineage cut; ticks after the system went quiet change nothing."""
        while self.steps < limit and not is_quiet(self.state, self.net, self.policy):
            self.step(min(self.cut_every, limit - self.steps))
        return self

    def global_state(self) -> DataFrame:
        return self.state.select(*self.net.keys, "spikes").orderBy(*self.net.keys)

    def outputs(self) -> DataFrame:
        marked = self.network.neurons.where("is_output").select(*self.net.keys)
        return self.state.select(*self.net.keys, "spikes").join(marked, self.net.keys)

    def set_spikes(self, changes: DataFrame):
        """Overwrite spike counts with rows (nid, spikes)."""
        new = changes.select(*self.net.keys, F.col("spikes").cast("bigint").alias("_new"))
        self.state = cut_lineage(self.state.join(new, self.net.keys, "left").select(
            *self.net.keys, F.coalesce("_new", "spikes").alias("spikes"),
            "timer", "is_open", "pending"))
        return self

    def reset(self):
        self.state = self.net.initial_state()
        self._clear_metrics()
        return self

    def performance(self) -> DataFrame:
        """One row of metrics; sizes come from the loaded network."""
        spark = self.net.static.sparkSession
        average = self.compute_ms / self.steps if self.steps else None
        timing = spark.createDataFrame(
            [(self.steps, self.compute_ms, average)],
            "total_steps long, total_compute_ms double, avg_step_ms double")
        n = self.network
        degree = n.synapses.groupBy(*n.scope, "source_id").count()
        return timing.select(
            "*",
            n.neurons.agg(F.count(F.lit(1))).scalar().alias("neurons"),
            n.rules.agg(F.count(F.lit(1))).scalar().alias("rules"),
            n.synapses.agg(F.count(F.lit(1))).scalar().alias("synapses"),
            degree.agg(F.coalesce(F.max("count"), F.lit(0))).scalar().alias("max_out_degree"))

    def performance_report(self) -> str:
        lines = ["=== Spark simulator report ===",
                 f"Total Steps: {self.steps}",
                 f"Total Compute Time: {self.compute_ms:.3f} ms"]
        if self.steps:
            lines.append(f"Average Time per Step: {self.compute_ms / self.steps:.3f} ms")
        return "\n".join(lines) + "\n"
