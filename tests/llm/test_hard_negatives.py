"""Hard negatives by vertical scans against brute force."""

import math

import numpy as np
import pytest

from spikeframe.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, v string, windows int"


def brute(rows):
    own = []
    for vec_id, vector, label, *_ in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        moved = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        own.append((vec_id, moved, [math.floor(256 * float(np.float32(x))) for x in vector]))
    order = lambda found: sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    out = []
    for k, (anchor, label, a) in enumerate(own):
        if anchor is None or anchor % 50:
            continue
        scores = [(sum(x * y for x, y in zip(a, v)), i, other) for j, (i, other, v) in enumerate(own) if j != k]
        near = order([(s, i) for s, i, other in scores if other == label])[:5]
        for positive, positive_id in near:
            far = order([(s, i) for s, i, other in scores if other != label and 50 * positive <= 100 * s <= 95 * positive])[:3]
            out += [(anchor, positive_id, n + 1, i, positive, s) for n, (s, i) in enumerate(far)]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def got(df, **options):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, hard_negatives.hard_negatives(df, **options).select(*columns).collect()), key=key)


@pytest.mark.parametrize("spread, dims", [(1.0, 16), (900.0, 8), (60000.0, 5)])
def test_random_vectors(spark, spread, dims):
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(4, dims))
    rows = []
    for k in range(700):
        label = int(rng.integers(4))
        vector = (centres[label] * 0.8 + rng.normal(size=dims)) * spread
        rows.append((k, [float(np.float32(x)) for x in vector], label, "x", 1))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted(brute(rows), key=key)
    assert len(want) > 50 and got(df) == want
    assert got(df, block_rows=150, zone_rows=32) == want


def test_ties_and_odd_rows(spark):
    one = [0.5, -0.25, 1.0]
    rows = [(50 * (k % 3), one, k % 2, "x", 1) for k in range(6)]  # repeated ids and vectors
    rows += [(k, one, k % 3, "x", 1) for k in range(1, 40)] + [(None, one, 1, "x", 1), (None, [0.4, -0.2, 0.9], 2, None, None)]
    rows += [(k, [0.4, -0.25, 0.9], 1 + k % 2, "x", 1) for k in range(60, 80)]
    rows += [(100, None, 1, "x", 1), (150, one, None, "x", 1), (200, [None, 1.0, 1.0], 1, "x", 1), (250, [float("nan"), 1.0, 1.0], 1, "x", 1),
             (300, [float("inf"), 1.0, 1.0], 1, "x", 1), (350, [], 1, "x", 1), (400, [0.9], 2, "x", 1), (450, [0.1, 0.2, 0.3, 0.4], 2, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    want = sorted(brute(rows), key=key)
    assert want and got(df) == want and got(df, block_rows=20, zone_rows=7) == want
    assert got(df.limit(0)) == []


def test_candidates_leave_early():
    rng = np.random.default_rng(1)
    vectors = rng.integers(-100, 100, (4000, 32))
    vectors[:, 0] = np.where(np.arange(4000) < 40, 30000, -30000)  # one column decides
    n = len(vectors)
    rows = hard_negatives.Rows(np.arange(n), np.arange(n), np.zeros(n, bool), np.zeros(n, np.int64))
    zone, seen = hard_negatives.Zone(rows, vectors), []

    def possible(least, most):
        seen.append(len(least))
        return most >= np.partition(least, len(least) - 5)[len(least) - 5]

    index, score = zone.scan(vectors[0], np.arange(n), possible)
    assert seen[0] == n and seen[1] <= 40 and (score == vectors[index] @ vectors[0]).all()
    assert set(np.argsort(-(vectors @ vectors[0]))[:5]) <= set(index)
