"""Selection by counting passes and inversions against brute force."""

import collections
import random

import numpy as np
import pytest

from spikeframe.operators import inversions, quantiles


@pytest.mark.parametrize("n", [0, 1, 2, 3, 64, 65, 1000])
def test_earlier_greater(n):
    ranks = np.random.default_rng(n).permutation(n)
    want = [(ranks[:k] > ranks[k]).sum() for k in range(n)]
    assert inversions.earlier_greater(ranks).tolist() == want


def test_inversions_per_group(spark):
    rnd = random.Random(1)
    rows, place = [], 0
    for group, size in (("hot", 700), ("b", 40), (None, 30), ("one", 1), ("ties", 50), ("up", 60)):
        for k in range(size):
            place += 1
            value = {"ties": 5.0, "up": float(k)}.get(group, float(rnd.randrange(40)))
            rows.append((group, place, None if k == 3 and group == "b" else value))
    df = spark.createDataFrame(rows, "g string, p long, v double").repartition(5)
    got = {r.g: (r.n, r.inversions) for r in inversions.inversions(df, "g", "p", "v").collect()}
    groups = collections.defaultdict(list)
    for g, _, v in rows:
        if v is not None:
            groups[g].append(v)
    assert got == {g: (len(x), sum(a > b for k, b in enumerate(x) for a in x[:k])) for g, x in groups.items()}
    assert got["hot"][1] > 0 and got["ties"][1] == got["up"][1] == 0
    assert inversions.inversions(df.limit(0), "g", "p", "v").count() == 0


@pytest.mark.parametrize("spread", [0, 1, 1000, 10 ** 12])
def test_selection(spark, spread):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "b", None]), rnd.randint(-spread, spread) if k % 11 else None) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = {(r.g, r.permille): (r.k, r.value) for r in quantiles.kth_values(df, "g", "v", [1, 500, 999, 1000]).collect()}
    want = {}
    for g in ("a", "b", None):
        own = sorted(v for k, v in rows if k == g and v is not None)
        for p in (1, 500, 999, 1000):
            k = max(1, -(-p * len(own) // 1000))
            want[g, p] = (k, own[k - 1])
    assert got == want
    assert quantiles.kth_values(df.limit(0), "g", "v", [500]).count() == 0
