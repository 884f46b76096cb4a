"""One clock tick: rule selection as a projection, delivery as one grouped sum.

The state is referenced exactly once, so k composed ticks give a plan of size O(k)
with one shuffle each. Expressions are SQL text to keep the driver-side cost of
composing many ticks low.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .network import OWN_RECORD, CompiledNetwork


@dataclass(frozen=True)
class TickPolicy:
    """Corner cases on which deterministic spiking simulators differ.

    emit_on_reopen: a delayed emission leaves when its neuron reopens, even if the
        neuron closes again in that tick (otherwise it is overwritten and lost).
    immediate_inhibition / delayed_inhibition: whether negative weights act on
        immediate and on delayed emissions.
    """
    emit_on_reopen: bool = False
    immediate_inhibition: bool = False
    delayed_inhibition: bool = True


SEQUENTIAL = TickPolicy()
INHIBITORY = TickPolicy(immediate_inhibition=True)
REOPEN = TickPolicy(emit_on_reopen=True, immediate_inhibition=True)
EXCITATORY = TickPolicy(delayed_inhibition=False)

OPEN_NOW = "(is_open or timer = 1)"
FIRST_MATCH = "get(filter(rules, r -> r.threshold <= spikes), 0)"
WAITS = "coalesce(fired.delay > 0, false)"


def _outs_column(net):
    return "outs" if net.out_pages is None else "n_outs"


def _with_fired(state: DataFrame, net: CompiledNetwork) -> DataFrame:
    """State after the clock moved (T1), with the fired rule or NULL."""
    joined = state.join(net.static.drop("initial_spikes"), net.keys, "left")
    clock = ["spikes", "greatest(timer - 1, 0) as timer", f"{OPEN_NOW} as is_open",
             "timer = 1 as reopened", "pending"]
    if net.rule_pages is None:
        return joined.selectExpr(*net.keys, *clock, _outs_column(net),
                                 f"case when {OPEN_NOW} then {FIRST_MATCH} end as fired")
    # only an open neuron looks at more than one page of its rules
    probed = joined.selectExpr(
        *net.keys, *clock, "n_outs",
        f"explode(case when {OPEN_NOW} and n_rules > 1 then sequence(0, n_rules - 1) "
        "else array(0) end) as page").join(net.rule_pages, [*net.keys, "page"], "left")
    carried = ("spikes", "timer", "is_open", "reopened", "pending", "n_outs")
    found = probed.selectExpr(*net.keys, *carried, f"case when is_open then {FIRST_MATCH} end as fired")
    return found.groupBy(*net.keys).agg(*[F.max(c).alias(c) for c in carried],
                                        F.min("fired").alias("fired"))


def fire(state: DataFrame, net: CompiledNetwork, policy: TickPolicy = SEQUENTIAL) -> DataFrame:
    """Consumption and the delay branch (T4-T6), plus what each neuron sends through its
    synapses in this tick: ``immediate`` and ``delayed`` spike counts."""
    if policy.emit_on_reopen:
        pending = f"case when {WAITS} then fired.produced when reopened then 0 else pending end"
        delayed = "case when reopened then pending else 0 end"
    else:
        pending = f"case when {WAITS} then fired.produced else pending end"
        delayed = f"case when is_open and not {WAITS} then pending else 0 end"
    return _with_fired(state, net).selectExpr(
        *net.keys,
        "spikes - coalesce(fired.consumed, 0) as spikes",
        f"case when {WAITS} then fired.delay else timer end as timer",
        f"is_open and not {WAITS} as is_open",
        f"{pending} as pending",
        f"case when {WAITS} then 0 else coalesce(fired.produced, 0) end as immediate",
        f"{delayed} as delayed",
        "fired.rule_idx as rule_idx",
        _outs_column(net))


def deliver(fired: DataFrame, net: CompiledNetwork, policy: TickPolicy = SEQUENTIAL) -> DataFrame:
    """Send along synapses and sum at open destinations."""
    sends = "immediate > 0 or delayed > 0"
    state = ["spikes", "timer", "is_open", "pending"]
    if net.out_pages is not None:
        # page -1 is the neuron's own record, which meets no synapse page
        fired = fired.selectExpr(
            *net.keys, *state, "immediate", "delayed",
            f"explode(case when {sends} then sequence(-1, n_outs - 1) else array(-1) end) as page"
        ).join(net.out_pages, [*net.keys, "page"], "left")
        outs = f"case when page < 0 then array({OWN_RECORD}) else outs end"
    else:
        # silent sources never touch their synapses
        outs = f"case when {sends} then outs else array({OWN_RECORD}) end"
    now = "net" if policy.immediate_inhibition else "gain"
    later = "net" if policy.delayed_inhibition else "gain"
    rows = fired.selectExpr(*net.keys, *state, "immediate", "delayed", f"explode({outs}) as out").selectExpr(
        *net.scope, "out.dest as nid",
        *[f"case when out.gain is null then {c} end as {c}" for c in state],
        f"immediate * out.{now} + delayed * out.{later} as arriving")
    landed = rows.groupBy(*net.keys).agg(*[F.max(c).alias(c) for c in state],
                                      F.sum("arriving").alias("arriving"))
    # a closed destination loses what arrives, and only an open one lets go of its pending spikes
    return landed.where("spikes is not null").selectExpr(
        *net.keys,
        "case when is_open then spikes + coalesce(arriving, 0) else spikes end as spikes",
        "timer", "is_open",
        "pending" if policy.emit_on_reopen else "case when is_open then 0 else pending end as pending")


def tick(state: DataFrame, net: CompiledNetwork, policy: TickPolicy = SEQUENTIAL) -> DataFrame:
    return deliver(fire(state, net, policy), net, policy)
