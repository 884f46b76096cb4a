import random

import pytest
from model import System, run, to_network

from spikeframe import Network, Simulator, TickPolicy, compile_network
from spikeframe.operators.packed import pack, simulate_many, simulate_packed
from spikeframe.operators.simulate import advance, is_quiet, spiking_vector, trace
from spikeframe.operators.tick import EXCITATORY, INHIBITORY, REOPEN, SEQUENTIAL
from spikeframe.sources.builder import NetworkBuilder, network_from_definitions

# name -> (system, spikes per tick)
CASES = {
    "chain": (System([1, 0, 0, 0], {i: [(1, 1, 1, 0)] for i in range(4)}, [(0, 1, 1), (1, 2, 1), (2, 3, 1)]),
              [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]),
    "remainder": (System([5, 0], {0: [(3, 2, 1, 0)]}, [(0, 1, 1)]), [[5, 0], [3, 1]]),
    "delay": (System([1, 0], {0: [(1, 1, 1, 2)]}, [(0, 1, 1)]), [[1, 0], [0, 0], [0, 0], [0, 1]]),
    "weight": (System([1, 0], {0: [(1, 1, 1, 0)]}, [(0, 1, 10)]), [[1, 0], [0, 10]]),
    "refire at reopen": (System([2, 0], {0: [(1, 1, 1, 1)]}, [(0, 1, 1)]),
                         [[2, 0], [1, 0], [0, 0], [0, 1], [0, 1]]),
    "delayed arrival": (System([1, 0, 0], {0: [(1, 1, 1, 1)], 1: [(1, 1, 1, 0)]}, [(0, 1, 1), (1, 2, 1)]),
                        [[1, 0, 0], [0, 0, 0], [0, 1, 0], [0, 0, 1], [0, 0, 1]]),
    "negative now": (System([1, 5], {0: [(1, 1, 1, 0)]}, [(0, 1, -2)]), [[1, 5], [0, 5], [0, 5]]),
    "negative later": (System([1, 5], {0: [(1, 1, 1, 1)]}, [(0, 1, -2)]), [[1, 5], [0, 5], [0, 3], [0, 3]]),
    "closes in the same tick": (System([1, 1], {0: [(1, 1, 1, 0)], 1: [(1, 1, 1, 2)]}, [(0, 1, 1)]),
                                [[1, 1], [0, 0], [0, 0]]),
    "consumes below zero": (System([1, 0], {0: [(1, 3, 1, 0)]}, [(0, 1, 1)]), [[1, 0], [-2, 1], [-2, 1]]),
    "fan": (System([1, 0, 0, 0], {0: [(3, 3, 9, 0), (1, 1, 1, 0)]}, [(0, 1, 1), (0, 2, 2), (0, 3, 3)]),
            [[1, 0, 0, 0], [0, 1, 2, 3]]),
    "parallel and self": (System([2, 0], {0: [(1, 1, 1, 0)]}, [(0, 1, 2), (0, 1, 3), (0, 1, -4), (0, 0, 1)]),
                          [[2, 0], [2, 5], [2, 10]]),
}
POLICIES = {"sequential": SEQUENTIAL, "inhibitory": INHIBITORY, "reopen": REOPEN, "excitatory": EXCITATORY}


def expected(systems, k, policy=SEQUENTIAL):
    return {(name, i): cell for name, s in systems.items() for i, cell in enumerate(
        run(s, k, policy.emit_on_reopen, policy.immediate_inhibition, policy.delayed_inhibition)[k])}


def found(df):
    return {(r.sys, r.nid): (r.spikes, r.timer, r.is_open, r.pending) for r in df.collect()}


def random_systems(seed, count, n):
    rng = random.Random(seed)
    return {f"r{i}": System(
        [rng.randrange(6) for _ in range(n)],
        {a: [(rng.randrange(5), rng.randrange(4), rng.randrange(3), rng.choice([0, 0, 1, 2]))
             for _ in range(rng.randrange(4))] for a in range(n)},
        [(rng.randrange(n), rng.randrange(n), rng.randrange(-2, 4)) for _ in range(3 * n)])
        for i in range(count)}


@pytest.fixture(scope="module")
def case_network(spark):
    return to_network(spark, {name: s for name, (s, _) in CASES.items()})


def test_model_agrees_with_known_states():
    for name, (system, states) in CASES.items():
        got = [[c[0] for c in state] for state in run(system, len(states) - 1)]
        assert got == states, name


@pytest.mark.parametrize("page_size", [4096, 2, 1])
def test_known_states(case_network, page_size):
    net = compile_network(case_network, page_size)
    inline = {4096: (True, True), 2: (True, False), 1: (False, False)}[page_size]
    assert (net.rule_pages is None, net.out_pages is None) == inline
    rows = trace(net.initial_state(), net, 4).collect()
    spikes = {(r.sys, r.k, r.nid): r.spikes for r in rows}
    for name, (_, states) in CASES.items():
        for k, state in enumerate(states):
            assert [spikes[name, k, i] for i in range(len(state))] == state, (name, k)


@pytest.mark.parametrize("policy", POLICIES)
def test_random_systems_against_model(spark, policy):
    systems, policy = random_systems(7, 6, 12), POLICIES[policy]
    network = to_network(spark, systems)
    net = compile_network(network)
    assert found(advance(net.initial_state(), net, 6, policy)) == expected(systems, 6, policy)
    assert found(simulate_packed(pack(network, 6), ["sys"], policy)) == expected(systems, 6, policy)


def test_paged_hubs_and_long_rule_lists(spark):
    """One neuron holds a third of all synapses and most of the rules."""
    n = 60
    rng = random.Random(3)
    hub_rules = [(k, k // 2, 1 + k % 2, k % 3) for k in range(40, 0, -1)]
    system = System([50] + [rng.randrange(4) for _ in range(n - 1)],
                    {0: hub_rules, **{i: [(2, 1, 1, i % 2), (1, 1, 1, 0)] for i in range(1, n)}},
                    [(0, d, 1 + d % 3) for d in range(n)] + [(i, 0, 1) for i in range(1, n)]
                    + [(i, (i * 7) % n, 2) for i in range(1, n)])
    network = to_network(spark, {"hub": system})
    net = compile_network(network, page_size=5)
    assert net.out_pages.where("nid = 0").count() > 5
    assert net.rule_pages.where("nid = 0").count() == 8
    assert found(advance(net.initial_state(), net, 5)) == expected({"hub": system}, 5)


def test_large_systems_take_the_distributed_tick(spark):
    systems = {**random_systems(1, 3, 4), "big": random_systems(2, 1, 40)["r0"]}
    assert found(simulate_many(to_network(spark, systems), 4, size_limit=60)) == expected(systems, 4)


def test_tick_plan_is_one_shuffle_per_tick(spark):
    big = spark.range(200000).selectExpr("id as nid", "1L as initial_spikes", "false as is_output")
    rules = big.selectExpr("nid", "0 as rule_idx", "1 as threshold", "1 as consumed", "1 as produced", "0 as delay")
    edges = big.selectExpr("nid as source_id", "(nid + 1) % 200000 as dest_id", "1 as weight")
    net = compile_network(Network(big, rules, edges))
    plan = advance(net.initial_state(), net, 3)._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    # the cached table's own plan is printed below each of its scans, further to the right

    def depth(line):
        return len(line) - len(line.lstrip(" :+-*()0123456789"))

    own, hidden = [], None
    for line in lines:
        if hidden is not None and depth(line) > hidden:
            continue
        hidden = depth(line) if "InMemoryRelation" in line else None
        own.append(line)
    assert sum("Exchange hashpartitioning" in line for line in own) == 3
    assert "PythonUDF" not in plan and "CartesianProduct" not in plan


def test_simulator_object(spark):
    network = (NetworkBuilder().add_neuron(0, 2).add_neuron(1).add_rule(0, 1, 1, 1, 0)
               .add_synapse(0, 1, 3).mark_output(1).build(spark))
    sim = Simulator()
    assert sim.load_system(network)
    sim.step(0).step(-1)
    assert sim.steps == 0
    assert [r.rule_idx for r in spiking_vector(sim.state, sim.net).orderBy("nid").collect()] == [0, -1]
    assert not is_quiet(sim.state, sim.net)
    sim.step().step(2)
    assert [tuple(r) for r in sim.global_state().collect()] == [(0, 0), (1, 6)]
    assert [tuple(r) for r in sim.outputs().collect()] == [(1, 6)]
    assert is_quiet(sim.state, sim.net)
    report = sim.performance().first()
    assert (report.total_steps, report.neurons, report.rules, report.synapses, report.max_out_degree) == (3, 2, 1, 1, 1)
    assert report.total_compute_ms > 0 and "Total Steps: 3" in sim.performance_report()
    sim.set_spikes(spark.createDataFrame([(0, 5)], "nid long, spikes long"))
    assert [r.spikes for r in sim.global_state().collect()] == [5, 6]
    sim.reset().run_until_quiet(20)
    assert [r.spikes for r in sim.global_state().collect()] == [0, 6] and sim.steps <= 8
    sim.reset()
    assert [r.spikes for r in sim.global_state().collect()] == [2, 0] and sim.steps == 0
    assert sim.performance().first().avg_step_ms is None


def test_validation_names_each_defect(spark):
    network = Network(
        spark.createDataFrame([(0, 1, False), (0, 2, False)], "nid long, initial_spikes long, is_output boolean"),
        spark.createDataFrame([(0, 0, 1, 1, -1, 0), (9, 0, 1, 1, 1, -2)],
                              "nid long, rule_idx int, threshold int, consumed int, produced int, delay int"),
        spark.createDataFrame([(0, 4, 1), (5, 0, 1)], "source_id long, dest_id long, weight int"))
    with pytest.raises(ValueError) as error:
        network.validate()
    for text in ("duplicate neuron: 1", "negative production: 1", "negative delay: 1",
                 "rule of unknown neuron: 1", "synapse from unknown neuron: 1", "synapse to unknown neuron: 1"):
        assert text in str(error.value)


def test_builder_semantics(spark):
    b = NetworkBuilder().add_neuron(2, 7).add_rule(4, 1, 1, 1).add_rule(2, 3, 2, 1).add_neuron(2, 9)
    network = b.add_rule(2, 5, 5, 0, 1).chain_neurons([0, 2, 4]).chain_neurons([]).build(spark)
    assert [tuple(r)[:2] for r in network.neurons.orderBy("nid").collect()] == [(0, 0), (1, 0), (2, 9), (3, 0), (4, 0)]
    assert [tuple(r) for r in network.rules.orderBy("nid").collect()] == [(2, 0, 5, 5, 0, 1), (4, 0, 1, 1, 1, 0)]
    assert [tuple(r) for r in network.synapses.collect()] == [(0, 2, 1), (2, 4, 1)]
    assert network.rule_count().first()[0] == 2

    logged = network_from_definitions(
        spark.createDataFrame([(1, 2, 7), (4, 2, 9)], "seq long, nid long, initial_spikes long"),
        spark.createDataFrame([(2, 4, 1, 1, 1, 0), (3, 2, 3, 2, 1, 0), (5, 2, 5, 5, 0, 1)],
                              "seq long, nid long, threshold int, consumed int, produced int, delay int"),
        network.synapses)
    assert sorted(map(tuple, logged.neurons.collect())) == sorted(map(tuple, network.neurons.collect()))
    assert sorted(map(tuple, logged.rules.collect())) == sorted(map(tuple, network.rules.collect()))


def test_policy_defaults():
    assert TickPolicy() == SEQUENTIAL
