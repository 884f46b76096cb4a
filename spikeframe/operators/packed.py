"""Many small independent systems: one row per system, all ticks inside one task.

A system that fits a row needs no shuffle between its ticks. Whole Arrow batches of
systems are advanced together, and systems above the size limit take the distributed
tick instead, so no group of unknown size is ever collected.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .network import Network, compile_network
from .simulate import advance
from .tick import SEQUENTIAL

SIZE_LIMIT = 8192
STATE_SCHEMA = "nid bigint, spikes bigint, timer int, is_open boolean, pending bigint"


def _advance_flat(spikes, ticks, rules, synapses, policy):
    """Advance disjoint systems laid out as flat arrays with global neuron numbers.
    ``rules`` are sorted by neuron and priority; ``ticks`` is per neuron."""
    owner, threshold, consumed, produced, wait = rules
    source, dest, weight = synapses
    now = weight if policy.immediate_inhibition else np.maximum(weight, 0)
    later = weight if policy.delayed_inhibition else np.maximum(weight, 0)
    n = len(spikes)
    timer, pending = np.zeros(n, np.int64), np.zeros(n, np.int64)
    is_open = np.ones(n, bool)
    for k in range(int(ticks.max(initial=0))):
        live = ticks > k
        reopened = live & (timer == 1)
        is_open = is_open | reopened
        timer = np.where(live, np.maximum(timer - 1, 0), timer)
        able = np.flatnonzero((live & is_open)[owner] & (threshold <= spikes[owner]))
        neuron, first = np.unique(owner[able], return_index=True)
        rule = able[first]
        spikes[neuron] -= consumed[rule]
        waits = wait[rule] > 0
        delayed = np.where(reopened, pending, 0) if policy.emit_on_reopen else None
        if policy.emit_on_reopen:
            pending = np.where(reopened, 0, pending)
        pending[neuron[waits]] = produced[rule[waits]]
        timer[neuron[waits]] = wait[rule[waits]]
        is_open[neuron[waits]] = False
        immediate = np.zeros(n, np.int64)
        immediate[neuron[~waits]] = produced[rule[~waits]]
        if delayed is None:
            delayed = np.where(live & is_open, pending, 0)
            pending = np.where(live & is_open, 0, pending)
        used = np.flatnonzero(((immediate > 0) | (delayed > 0))[source] & is_open[dest])
        sent = immediate[source[used]] * now[used] + delayed[source[used]] * later[used]
        np.add.at(spikes, dest[used], sent)
    return spikes, timer, is_open, pending


def _flatten(column, fields):
    """Struct list column -> owning row of each element, and one array per field."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten()
    arrays = [values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]
    return np.repeat(np.arange(len(column)), lengths), arrays


def _kernel(scope, policy):
    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            start = batch.column("spikes")
            counts = np.diff(start.offsets.to_numpy())
            base = np.concatenate([[0], np.cumsum(counts)[:-1]])
            row = np.repeat(np.arange(batch.num_rows), counts)
            at, (nid, *rule) = _flatten(batch.column("rules"), ("nid", "threshold", "consumed",
                                                                "produced", "delay"))
            on, (source, dest, weight) = _flatten(batch.column("synapses"), ("source", "dest", "weight"))
            spikes, timer, is_open, pending = _advance_flat(
                start.flatten().to_numpy().copy(), batch.column("ticks").to_numpy().astype(np.int64)[row],
                (base[at] + nid, *rule), (base[on] + source, base[on] + dest, weight), policy)
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).take(taken) for c in scope]
                + [pa.array(np.arange(len(row)) - base[row]), pa.array(spikes),
                   pa.array(timer.astype(np.int32)), pa.array(is_open), pa.array(pending)],
                names=[*scope, "nid", "spikes", "timer", "is_open", "pending"])
    return run


def simulate_packed(packed: DataFrame, scope, policy=SEQUENTIAL) -> DataFrame:
    """``packed`` rows: scope columns, ticks, spikes ARRAY<BIGINT> by neuron number, rules
    ARRAY<STRUCT> in neuron and priority order, synapses ARRAY<STRUCT>."""
    rows = packed.select(*scope, "ticks", "spikes", "rules", "synapses")
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in scope), STATE_SCHEMA])
    return rows.mapInArrow(_kernel(list(scope), policy), schema)


def pack(network: Network, ticks) -> DataFrame:
    """One row per system. Neuron numbers must be 0..q-1 inside each system."""
    scope = list(network.scope)
    spikes = network.neurons.groupBy(*scope).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("nid", F.col("initial_spikes").cast("bigint").alias("s")))),
        lambda x: x["s"]).alias("spikes"))
    rules = network.rules.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct(
        "nid", "rule_idx", "threshold", "consumed", "produced", "delay"))).alias("rules"))
    synapses = network.synapses.groupBy(*scope).agg(F.collect_list(F.struct(
        F.col("source_id").alias("source"), F.col("dest_id").alias("dest"), "weight")).alias("synapses"))
    return (spikes.join(rules, scope, "left").join(synapses, scope, "left")
            .selectExpr(*scope, f"{ticks} as ticks", "spikes",
                        "coalesce(rules, array()) as rules", "coalesce(synapses, array()) as synapses"))


def _restrict(network, systems, how):
    scope = list(network.scope)
    return Network(*[t.join(systems, scope, how) for t in
                     (network.neurons, network.rules, network.synapses)], network.scope)


def simulate_many(network: Network, ticks: int, policy=SEQUENTIAL, size_limit=SIZE_LIMIT) -> DataFrame:
    """Final state of every system after ``ticks`` ticks."""
    scope = list(network.scope)
    rows = [t.select(*scope) for t in (network.neurons, network.rules, network.synapses)]
    sizes = rows[0].unionAll(rows[1]).unionAll(rows[2]).groupBy(*scope).count()
    large = sizes.where(F.col("count") > size_limit).select(*scope)
    if large.isEmpty():
        return simulate_packed(pack(network, ticks), scope, policy)
    small = simulate_packed(pack(_restrict(network, large, "left_anti"), ticks), scope, policy)
    net = compile_network(_restrict(network, large, "left_semi"))
    spread = advance(net.initial_state(), net, ticks, policy)
    return small.unionByName(spread.withColumn("pending", F.col("pending").cast("bigint")))
