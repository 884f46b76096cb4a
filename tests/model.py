"""Plain Python model of the sequential tick, used as an independent oracle."""

from dataclasses import dataclass


@dataclass
class System:
    spikes: list
    rules: dict       # neuron -> [(threshold, consumed, produced, delay)]
    synapses: list    # (source, dest, weight)


def run(system, ticks, reopen=False, inhibit_now=False, inhibit_later=True):
    """States after 0..ticks ticks as lists of (spikes, timer, is_open, pending)."""
    n = len(system.spikes)
    s, timer, opened, pending = list(system.spikes), [0] * n, [True] * n, [0] * n
    history = [list(zip(s, timer, opened, pending))]
    for _ in range(ticks):
        now, later = [0] * n, [0] * n
        for a in range(n):
            came_back = timer[a] == 1
            timer[a] = max(timer[a] - 1, 0)
            opened[a] = opened[a] or came_back
            if reopen and came_back:
                later[a], pending[a] = pending[a], 0
            rule = next((r for r in system.rules.get(a, []) if opened[a] and s[a] >= r[0]), None)
            if rule is None:
                continue
            s[a] -= rule[1]
            if rule[3] > 0:
                opened[a], timer[a], pending[a] = False, rule[3], rule[2]
            else:
                now[a] = rule[2]
        if not reopen:
            for a in range(n):
                if opened[a]:
                    later[a], pending[a] = pending[a], 0
        for source, dest, weight in system.synapses:
            if opened[dest]:
                s[dest] += now[source] * (weight if inhibit_now else max(weight, 0))
                s[dest] += later[source] * (weight if inhibit_later else max(weight, 0))
        history.append(list(zip(s, timer, opened, pending)))
    return history


def to_network(spark, systems):
    """Named systems as one scoped network."""
    from spikeframe import Network
    neurons = [(name, i, v, False) for name, s in systems.items() for i, v in enumerate(s.spikes)]
    rules = [(name, i, j, *r) for name, s in systems.items()
             for i, listed in s.rules.items() for j, r in enumerate(listed)]
    edges = [(name, *e) for name, s in systems.items() for e in s.synapses]
    return Network(
        spark.createDataFrame(neurons, "sys string, nid long, initial_spikes long, is_output boolean"),
        spark.createDataFrame(rules, "sys string, nid long, rule_idx int, threshold int, consumed int, "
                                     "produced int, delay int"),
        spark.createDataFrame(edges, "sys string, source_id long, dest_id long, weight int"),
        ("sys",))
