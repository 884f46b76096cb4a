"""Pointer jumping, keyed permutations, sequential swaps, interval joins, product checks, the name function."""

import random
import re

import pytest
from pyspark.sql import functions as F

from spikeframe import session
from spikeframe.operators import chains, intervals, matrix
from spikeframe.sources import generate, names


def test_follow_chains_cycles_and_trees(spark):
    links = [(k, k + 1 if k < 36 else None) for k in range(37)]  # a chain
    links += [(100, 101), (101, 102), (102, 100), (103, 101)]  # a cycle and a way into it
    links += [(200, None), (201, 200), (202, 200), (203, 202)]  # a tree
    got = {r.node: (r.last, r.steps) for r in chains.follow(spark.createDataFrame(links, "node long, next long")).collect()}
    want = {k: (36, 36 - k) for k in range(37)} | dict.fromkeys((100, 101, 102, 103), (None, None))
    assert got == want | {200: (200, 0), 201: (200, 1), 202: (200, 1), 203: (200, 2)}
    assert chains.follow(spark.createDataFrame([], "node long, next long")).count() == 0


def test_following_keeps_estimates_of_the_size_of_the_rows(spark):
    links = spark.createDataFrame([(k, k + 1 if k < 299 else None) for k in range(300)], "node long, next long")
    found = chains.follow(links)
    assert float(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 1e12
    assert {(r.node, r.last, r.steps) for r in found.collect()} == {(k, 299, 299 - k) for k in range(300)}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 1001])
def test_permutation(spark, n):
    for seed in (1, 2):
        got = [r.p for r in spark.range(n).select(generate.permuted("id", n, seed).alias("p")).collect()]
        assert sorted(got) == list(range(n)) and (n < 10 or got != list(range(n)))


def test_sequential_swaps(spark):
    rnd = random.Random(8)
    n, rows = 40, [(k, rnd.randrange(40), rnd.randrange(40)) for k in range(60)] + [(60, 5, 5)]
    at = list(range(n))  # at[p]: what stands at p
    for _, x, y in rows:
        at[x], at[y] = at[y], at[x]
    want = {start: p for p, start in enumerate(at)}
    got = {r.pos: r.to for r in generate.swapped_positions(spark.createDataFrame(rows, "step long, x long, y long")).collect()}
    assert all(got.get(p, p) == want[p] for p in range(n))


def test_nearly_sorted_is_nearly_sorted(spark):
    values = spark.range(500).select(F.col("id").alias("pos"), ((F.col("id") * 7919) % 1000).alias("value"))
    got = sorted(map(tuple, generate.arrange(values, generate.NEARLY_SORTED).collect()))
    assert [p for p, _ in got] == list(range(500))
    ordered = sorted(v for _, v in got)
    moved = sum(a != b for a, (_, b) in zip(ordered, got))
    assert 20 < moved <= 100
    mixed = sorted(map(tuple, generate.arrange(values, generate.RANDOM).collect()))
    assert [p for p, _ in mixed] == list(range(500)) and sorted(v for _, v in mixed) == ordered
    assert [v for _, v in mixed] != [(k * 7919) % 1000 for k in range(500)]


def test_interval_join(spark):
    rnd = random.Random(3)
    points = [(k, rnd.choice([500, 500, rnd.randrange(-2000, 2000)])) for k in range(300)] + [(300, None)]
    windows = []
    for k in range(200):
        low = rnd.randrange(-2000, 2000)
        windows.append((k, low, low + rnd.choice([-5, 0, 1, 3, 100, 5000])))
    windows += [(200, None, 5), (201, 5, None), (202, -10 ** 12, 10 ** 12)]
    left = spark.createDataFrame(points, "p long, at long")
    right = spark.createDataFrame(windows, "w long, low long, high long")
    found = intervals.interval_join(left, "at", right, "low", "high")
    got = sorted((r.p, r.w) for r in found.collect())
    assert got == sorted((p, w) for p, at in points for w, low, high in windows
                         if None not in (at, low, high) and low <= at <= high)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert intervals.interval_join(left, "at", right.limit(0), "low", "high").count() == 0


def test_interval_totals(spark):
    rnd = random.Random(5)
    points = [(k, rnd.choice([500, rnd.randrange(-2000, 2000)])) for k in range(300)] + [(300, None)]
    windows = [(k, low, low + rnd.choice([-5, 0, 1, 3, 100, 5000])) for k in range(200) for low in [rnd.randrange(-2000, 2000)]]
    windows += [(200, None, 5), (201, 5, None), (202, -10 ** 12, 10 ** 12), (203, 7, 7), (3, -50, 900)]
    left = spark.createDataFrame(points, "p long, at long")
    right = spark.createDataFrame(windows, "w long, low long, high long")
    totals = {"n": ("count", "p"), "first": ("min", "p"), "last": ("max", "at"), "sum": ("sum", "p")}
    found = intervals.interval_totals(left, "at", right, "low", "high", ["w"], totals)
    want = {}
    for p, at in points:
        for w, low, high in windows:
            if None not in (at, low, high) and low <= at <= high:
                want.setdefault(w, []).append((p, at))
    assert {r.w: (r.n, r.first, r.last, r["sum"]) for r in found.collect()} == {
        w: (len(x), min(p for p, _ in x), max(at for _, at in x), sum(p for p, _ in x)) for w, x in want.items()}
    assert intervals.interval_totals(left, "at", right.limit(0), "low", "high", ["w"], totals).count() == 0
    # many points and windows alike: their pairs are never formed
    crowd = spark.range(20000).select(F.col("id").alias("p"), (F.col("id") % 50).alias("at"))
    wide = spark.range(20000).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("low"), F.lit(49).cast("long").alias("high"))
    assert intervals.interval_totals(crowd, "at", wide, "low", "high", ["w"], totals).where("n = 20000").count() == 20000


def test_interval_totals_send_no_bins_or_pieces_through_the_driver(spark, tmp_path):
    """Files are small, what is made of them is not: neither side may be taken for small by its files' size."""
    spark.range(3000).selectExpr("id p", "id * 7 % 5000 at").write.parquet(str(tmp_path / "points"))
    spark.range(3000).selectExpr("id w", "id * 11 % 5000 low", "id * 11 % 5000 + id % 60 high").write.parquet(str(tmp_path / "even"))
    # windows that all begin and end alike, so that their bins are split
    spark.range(3000).selectExpr("id w", "64L low", "127 + id % 2 high").write.parquet(str(tmp_path / "crowd"))
    points = [k * 7 % 5000 for k in range(3000)]
    for name, want in (("even", lambda w: (w * 11 % 5000, w * 11 % 5000 + w % 60)), ("crowd", lambda w: (64, 127 + w % 2))):
        found = intervals.interval_totals(spark.read.parquet(str(tmp_path / "points")), "at",
                                          spark.read.parquet(str(tmp_path / name)), "low", "high", ["w"], {"n": ("count", "p")})
        inside = {w: sum(low <= at <= high for at in points) for w in range(3000) for low, high in [want(w)]}
        assert {r.w: r.n for r in found.collect()} == {w: n for w, n in inside.items() if n}
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")
        # as planned and as run, bins and pieces are merged; only the few keys that are split may be broadcast
        assert len(plan) == 2 and all("SortMergeJoin [_level" in p for p in plan)
        assert all(("BroadcastHashJoin" in p) == ("_salt" in p) == (name == "crowd") for p in plan)


def test_interval_totals_deal_out_many_pieces(spark, monkeypatch):
    """Where pieces are more than one task's rows, both sides of their join get more tasks than the session's."""
    points = spark.range(2000).selectExpr("id p", "id * 7 % 5000 at")
    windows = spark.range(500).selectExpr("id w", "id * 11 % 5000 low", "id * 11 % 5000 + id % 60 high")

    def run():
        return intervals.interval_totals(points, "at", windows, "low", "high", ["w"], {"n": ("count", "p"), "last": ("max", "at")})

    want = sorted(map(tuple, run().collect()))
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    found = run()
    parts = re.findall(r"hashpartitioning\(_level#\d+, _bin#\w+, (\d+)\), REPARTITION_BY_NUM", found._jdf.queryExecution().executedPlan().toString())
    assert len(parts) == 2 and parts[0] == parts[1] and 20 <= int(parts[0]) <= 40  # 500 windows of about 6 pieces
    assert sorted(map(tuple, found.collect())) == want


def test_product_check(spark):
    rnd = random.Random(4)
    a, b = ([(i, j, float(rnd.randint(-3, 3))) for i in range(12) for j in range(12) if rnd.random() < .5] for _ in range(2))
    cells = {}
    for i, k, x in a:
        for k2, j, y in b:
            if k == k2:
                cells[i, j] = cells.get((i, j), 0.0) + x * y
    frame = lambda rows: spark.createDataFrame(rows, "i long, j long, v double")
    product = [(i, j, v) for (i, j), v in cells.items()]
    holds = matrix.product_holds(frame(a), frame(b), frame(product)).collect()
    assert len(holds) == 8 and all(r.wrong_rows == 0 for r in holds)
    caught = 0
    for t in range(6):
        wrong = list(product)
        k = rnd.randrange(len(wrong))
        wrong[k] = (*wrong[k][:2], wrong[k][2] + 1) if t else wrong[k]
        if t == 1:
            wrong.append((99, 99, 2.0))
        caught += sum(r.wrong_rows for r in matrix.product_holds(frame(a), frame(b), frame(wrong)).collect()) > 0
    assert caught == 5


def test_name_function(spark):
    names.register(spark)
    rows = [(1, "Cpu/Random/100/200/iterations:5"), (2, "broken"), (3, None), (4, "a/b/x/2"), (5, "a/b/1/2")]
    spark.createDataFrame(rows, "k int, name string").createOrReplaceTempView("names_to_parse")
    got = spark.sql("SELECT * FROM parse_names(TABLE(names_to_parse), 'name') ORDER BY k").collect()
    assert [tuple(r)[2:] for r in got] == [("Cpu", "Random", 100, 200), (None,) * 4, (None,) * 4, (None,) * 4, ("a", "b", 1, 2)]
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM parse_names(TABLE(names_to_parse), 'title')").collect()
    spark.catalog.dropTempView("names_to_parse")


@pytest.mark.parametrize("hops", [0, 1, 2, 3, 5])
def test_ways_within_hops(spark, hops):
    from spikeframe.operators import semiring

    rnd = random.Random(11)
    edges = [(rnd.randrange(40) * 7, rnd.randrange(40) * 7, float(rnd.randint(1, 9))) for _ in range(70)] + [(0, 7, 5.0), (0, 7, 2.0)]
    best = {(n, n): 0.0 for e in edges for n in e[:2]}
    for _ in range(hops):
        step = dict(best)
        for (i, k), v in best.items():
            for a, j, x in edges:
                if a == k:
                    step[i, j] = min(step.get((i, j), v + x), v + x)
        best = step
    df = spark.createDataFrame(edges, "i long, j long, v double")
    got = {(r.i, r.j): r.v for r in semiring.within_hops(df, hops, "min_plus", size=16).collect()}
    assert got == best
    assert {(r.i, r.j) for r in semiring.within_hops(df, hops, "or_and", size=16).collect()} == set(best)


def test_ways_in_a_sparse_network(spark):
    from spikeframe.operators import semiring

    # nodes far apart: every edge lies in a block of its own, and a hub joins all
    edges = [(k * 1000, k * 1000 + 1, 2.0) for k in range(3000)] + [(k * 1000 + 1, -5, 1.0) for k in range(3000)]
    df = spark.createDataFrame(edges + [(0, 1, 7.0), (-5, -9, 0.0)], "i long, j long, v double")
    costs = {(r.i, r.j): r.v for r in semiring.within_hops(df, 3, "min_plus").collect()}
    assert len(costs) == 6002 + 6001 + 6000 + 3000
    assert costs[7000, -9] == 3.0 and costs[0, -5] == 3.0 and costs[1, 1] == 0.0 and (-5, 0) not in costs
    assert "mapInArrow" not in semiring.within_hops(df, 2, "or_and")._jdf.queryExecution().toString()
    # a cell of zero is no way over (or, and)
    assert {(r.i, r.j) for r in semiring.within_hops(df, 3, "or_and").collect()} == {c for c in costs if c[0] == c[1] or c[1] != -9}
