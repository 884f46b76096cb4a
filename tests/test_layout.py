import random

from spikeframe.functions.scans import previous_value, ranked, running_total, slot_numbers
from spikeframe.functions.skew import salted_join
from spikeframe.operators import layout
from spikeframe.sources.tables import chain

# Partition example with 12 neurons on 3 ranks.
LINKS = [(0, 1), (1, 2), (2, 3), (0, 4), (1, 5), (2, 6), (3, 7), (4, 5), (5, 6), (6, 7), (4, 8), (5, 9),
         (6, 10), (7, 11)]


def synapses(spark):
    return spark.createDataFrame([(*e, 1) for e in LINKS], "source_id long, dest_id long, weight int")


def test_classes_and_slots(spark):
    classes = {(r.source_rank, r.dest_rank, r.kind): r.n for r in layout.synapse_classes(synapses(spark), 12, 3).collect()}
    assert classes == {(0, 0, "local"): 3, (1, 1, "local"): 3, (0, 1, "export"): 4, (1, 2, "export"): 4}
    slots = {(r.source_rank, r.dest_id): r.slot for r in layout.export_slots(synapses(spark), 12, 3).collect()}
    assert slots == {(0, 4): 0, (0, 5): 1, (0, 6): 2, (0, 7): 3, (1, 8): 0, (1, 9): 1, (1, 10): 2, (1, 11): 3}


def test_sender_side_combining(spark):
    edges = spark.createDataFrame([(0, 5, 2), (1, 5, 3), (2, 5, -1), (3, 0, 1)], "source_id long, dest_id long, weight int")
    made = spark.createDataFrame([(0, 1), (1, 2), (2, 4), (3, 0)], "nid long, produced int")
    rows = layout.combined_exports(made, edges, 6, 2).collect()
    assert [(r.source_rank, r.dest_rank, r.dest_id, r.spikes) for r in rows] == [(0, 1, 5, 8)]
    volume = layout.exchange_volume(edges, 6, 2).where("source_rank = 0").first()
    assert (volume.synapses, volume.values_sent) == (3, 1)


def test_blocks_cover_every_position(spark):
    for n, parts in [(12, 3), (10, 4), (3, 5), (7, 1)]:
        blocks = layout.row_blocks(spark, n, parts).orderBy("rank").collect()
        want = [n // parts + (r < n % parts) for r in range(parts)]
        assert [b.rows for b in blocks] == want
        owner = layout.owners(spark.range(n).withColumnRenamed("id", "nid"), n, parts)
        got = {r.nid: r.rank for r in owner.collect()}
        assert got == {p: b.rank for b in blocks for p in range(b.first, b.first + b.rows)}


def test_sizes_follow_the_formulas(spark):
    """Sort network with n = 20: q = 3n, m = n + n*n, z = n."""
    from spikeframe.operators.sort import sorting_network
    n = 20
    network = sorting_network(spark.range(n).selectExpr("id as pos", "id as value"), n)
    row = layout.storage_sizes(network.neurons, network.rules, network.synapses).first()
    q, m, z = 3 * n, n + n * n, n
    assert tuple(row) == (q, m, z, m * q + 3 * m + 2 * q + 1, m * (2 * z + 5) + 2 * q + 1, q * (z + 3) + 4 * m + 1)
    pad = layout.padding(network.neurons, network.synapses).first()
    assert pad.filled == network.synapses.count() and pad.padded == q * z - pad.filled
    index = layout.rule_index(network.neurons, network.rules).orderBy("nid").collect()
    assert [r.rule_start for r in index[:n + 2]] == [*range(n), n, 2 * n]


def test_scans_in_tiny_blocks(spark):
    rng = random.Random(1)
    keys = sorted(rng.sample(range(500), 120))
    rows = [(k, rng.randrange(9)) for k in keys]
    df = spark.createDataFrame(rows, "k long, v long")
    total = {r.k: r.t for r in running_total(df, "k", "v", "t", width=7).collect()}
    before = {r.k: r.p for r in previous_value(df, "k", "v", "p", width=7).collect()}
    acc, last = 0, None
    for k, v in rows:
        assert total[k] == acc and before[k] == last
        acc, last = acc + v, v
    grouped = df.selectExpr("k", "if(k < 200, 0, k % 3) as g")
    slots = {(r.g, r.k): r.s for r in slot_numbers(grouped, "g", "k", "s", width=7).collect()}
    for g in range(3):
        members = [k for k in keys if (0 if k < 200 else k % 3) == g]
        assert [slots[g, k] for k in members] == list(range(len(members)))
    weighted = {r.k: r.at for r in ranked(df, ["k"], "at", weight="v").collect()}
    assert weighted == total


def test_chain_links_neighbours(spark):
    ids = spark.createDataFrame([(0, 7), (3, 2), (4, 9)], "pos long, nid long")
    assert sorted((r.source_id, r.dest_id, r.weight) for r in chain(ids).collect()) == [(2, 9, 1), (7, 2, 1)]


def test_salted_join_splits_only_hot_keys(spark):
    left = spark.createDataFrame([("hot" if i % 3 == 0 else f"k{i % 40}", i) for i in range(900)], "k string, x long")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), *[(f"k{i}", i) for i in range(30)]], "k string, y long")
    got = sorted(map(tuple, salted_join(left, right, "k", ["x"]).select("k", "x", "y").collect()))
    assert got == sorted(map(tuple, left.join(right, "k").select("k", "x", "y").collect()))
