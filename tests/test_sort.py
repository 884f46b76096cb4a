import random

import pytest
from pyspark.sql import functions as F

from spikeframe.operators import sort
from spikeframe.operators.harness import Case, case_name, run_suite
from spikeframe.sources import generate as gen

# The inputs that any sort of this kind is expected to handle.
CASES = {
    "single": [42], "two": [5, 3], "sorted": [1, 2, 3, 4, 5], "reverse": [5, 4, 3, 2, 1],
    "duplicates": [3, 1, 4, 1, 5, 9, 2, 6, 5, 3], "random": [7, 2, 9, 1, 5, 3], "same": [5] * 5,
    "zeros": [3, 0, 2, 0, 1], "negatives": [-3, 0, 2, -1],
    **{f"down {n}": list(range(n, 0, -1)) for n in range(20, 101, 20)},
}


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "pos long, value long")


def in_order(df):
    return [r.value for r in df.orderBy("pos").collect()]


@pytest.fixture(scope="module")
def grouped(spark):
    return spark.createDataFrame([(k, v) for k, vs in CASES.items() for v in vs], "k string, value long")


def by_group(df):
    out = {}
    for r in df.orderBy("k", "pos").collect():
        out.setdefault(r.k, []).append(r.value)
    return out


def test_groups_by_network(grouped):
    assert by_group(sort.sort_groups(grouped, "k", "value", group_limit=100)) == {
        k: sorted(v) for k, v in CASES.items()}


def test_groups_by_counting(grouped):
    assert by_group(sort.counting_sort_groups(grouped, "k", "value")) == {k: sorted(v) for k, v in CASES.items()}


def test_groups_above_the_limit_are_whole(grouped):
    assert by_group(sort.sort_groups(grouped, "k", "value", group_limit=5)) == {
        k: sorted(v) for k, v in CASES.items()}


@pytest.mark.parametrize("name", ["duplicates", "negatives"])
def test_distributed_network(spark, name):
    sorter = sort.NetworkSort().load(frame(spark, CASES[name]))
    n = len(CASES[name])
    network = sorter.simulator.network
    assert network.neurons.count() == 3 * n and network.rules.count() == n + n * n
    assert network.synapses.count() == n * n + n * (n + 1) // 2
    assert network.neurons.where("is_output").count() == n
    assert in_order(sorter.execute()) == sorted(CASES[name])
    assert in_order(sorter.execute()) == sorted(CASES[name])  # quiet: more ticks change nothing


def test_empty_input(spark):
    assert sort.NetworkSort().sort(frame(spark, [1]).limit(0)).count() == 0
    assert sort.counting_sort(frame(spark, [1]).limit(0), "value").count() == 0


def test_hot_value(spark, monkeypatch):
    """A third of the rows share one value; blocks of the expansion stay small."""
    monkeypatch.setattr(sort, "EXPAND_BLOCK", 100)
    rng = random.Random(5)
    values = [7] * 3000 + [rng.randrange(-500, 500) for _ in range(6000)]
    rng.shuffle(values)
    df = frame(spark, values)
    assert in_order(sort.counting_sort(df, "value")) == sorted(values)
    native = sort.sort_native(df.withColumnRenamed("pos", "key"), "value", "key")
    assert in_order(native) == sorted(values)
    grouped = df.select(F.when(F.col("pos") < 6000, "hot").otherwise((F.col("pos") % 50).cast("string")).alias("k"), "value")
    want = {}
    for i, v in enumerate(values):
        want.setdefault("hot" if i < 6000 else str(i % 50), []).append(v)
    assert by_group(sort.sort_groups(grouped, "k", "value")) == {k: sorted(v) for k, v in want.items()}


def test_is_sorted(spark):
    assert tuple(sort.is_sorted(frame(spark, [1, 1, 2, 9]), "pos", "value").first()) == (4, 0, True)
    assert tuple(sort.is_sorted(frame(spark, [1, 3, 2, 2, 0]), "pos", "value").first()) == (5, 2, False)


def test_distributions(spark):
    n, top = 500, 200
    values = {d: in_order(gen.generate(spark, n, top, d)) for d in gen.DISTRIBUTIONS}
    drawn = values[gen.RANDOM]
    assert all(len(v) == n and min(v) >= 0 and max(v) <= top for v in values.values())
    assert len(set(drawn)) > 100
    assert values[gen.SORTED] == sorted(drawn)
    assert values[gen.REVERSE_SORTED] == sorted(drawn, reverse=True)
    nearly = values[gen.NEARLY_SORTED]
    moved = sum(a != b for a, b in zip(nearly, sorted(drawn)))
    assert sorted(nearly) == sorted(drawn) and 0 < moved < n // 2
    assert len(set(values[gen.FEW_UNIQUE])) <= 20 and len(set(values[gen.UNIFORM])) == 1
    assert in_order(gen.generate(spark, n, top, gen.RANDOM)) == drawn
    assert in_order(gen.generate(spark, n, top, gen.RANDOM, seed=43)) != drawn
    assert set(in_order(gen.generate(spark, 20, 0, gen.FEW_UNIQUE))) == {0}
    with pytest.raises(ValueError):
        gen.generate(spark, 1, 1, "Zigzag")


def test_harness_rows_feed_the_analytics(spark):
    from spikeframe.operators import bench
    case = Case(30, 20, gen.RANDOM, 1)
    results = run_suite(spark, [case], ["Counting", "Network"])
    assert case_name("Network", case) == "Network/Random/30/20/iterations:1"
    runs = bench.runs_from(results.withColumn("seq", F.lit(1)))
    assert {(r.impl, r.size, r.max_value) for r in runs.collect()} == {("Counting", 30, 20), ("Network", 30, 20)}
    assert bench.speedups(runs, "Network").first().speedup > 0


def test_groups_keep_nulls_on_both_sides_of_the_limit(spark):
    rows = [("a", 3), ("a", None), ("a", 1), ("a", 3), (None, 2), (None, None), (None, 2), ("n", None), ("n", None)]
    df = spark.createDataFrame(rows, "k string, value long")
    want = {}
    for k, v in rows:
        want.setdefault(k, []).append(v)
    want = sorted(((k, p, v) for k, vs in want.items()
                   for p, v in enumerate(sorted(vs, key=lambda x: (x is not None, x or 0)))), key=repr)
    for limit in (100, 2, 0):
        got = sort.sort_groups(df, "k", "value", group_limit=limit)
        assert sorted(map(tuple, got.collect()), key=repr) == want
    assert sorted(map(tuple, sort.counting_sort_groups(df, "k", "value").collect()), key=repr) == want
    assert sort.sort_groups(df.limit(0), "k", "value").count() == 0


def keyed_order(values, seed):
    """The keyed permutation, step by step."""
    prime = 2147483647

    def mixed(x, k):
        a = (x % prime * 48271 + k * 69621 + 1) % prime
        a = (a * a + 69621) % prime
        return (a * a + 48271) % prime

    n = len(values)
    high = next(k for k in range(1, n + 1) if k * k >= n)
    wide, out = -(-n // high), [None] * n
    for pos, value in enumerate(values):
        while True:
            row, column = divmod(pos, wide)
            for k in range(0, 2 * gen.FEISTEL_ROUNDS, 2):
                row = (row + mixed(column, seed + k)) % high
                column = (column + mixed(row, seed + k + 1)) % wide
            pos = row * wide + column
            if pos < n:
                break
        out[pos] = value
    return out


def test_arrangements_use_the_tables_values(spark):
    values = frame(spark, [9, 4, 130, 4, 77])
    got = {d: in_order(gen.arrange(values, d, pool=100)) for d in gen.DISTRIBUTIONS}
    assert got[gen.RANDOM] == keyed_order([9, 4, 130, 4, 77], 42) and got[gen.SORTED] == [4, 4, 9, 77, 130]
    assert got[gen.REVERSE_SORTED] == [130, 77, 9, 4, 4] and got[gen.FEW_UNIQUE] == [9, 4, 30, 4, 77]
    assert got[gen.UNIFORM] == [9] * 5 and sorted(got[gen.NEARLY_SORTED]) == [4, 4, 9, 77, 130]
