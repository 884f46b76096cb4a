import numpy as np
import pytest

from spikeframe.operators import matrix
from spikeframe.sources.generate import demo_matrix


def cells(spark, a):
    a = np.asarray(a, float)
    return spark.createDataFrame([(i, j, float(a[i, j])) for i in range(a.shape[0]) for j in range(a.shape[1])],
                                 "i long, j long, v double")


def dense(df, m, n):
    out = np.full((m, n), np.nan)
    for r in df.collect():
        assert np.isnan(out[r.i, r.j])
        out[r.i, r.j] = r.v
    return out


def filled(m, n, f):
    return np.array([[f(i * n + j) for j in range(n)] for i in range(m)], float)


PRODUCTS = {
    "small": ([[1, 2, 3], [4, 5, 6]], [[7, 8], [9, 10], [11, 12]]),
    "identity": (filled(4, 4, lambda x: x + 1), np.eye(4)),
    "digits": (filled(8, 8, lambda x: x % 10), filled(8, 8, lambda x: x % 10)),
    "one": ([[3.5]], [[2.0]]),
    "zeros": ([[0, 0], [1, 0]], [[0, 2], [0, 0]]),
}


@pytest.mark.parametrize("strategy", matrix.STRATEGIES)
def test_multiply(spark, strategy):
    assert matrix.strategy_name(strategy) and matrix.strategy_name("abacus") is None
    for name, (a, b) in PRODUCTS.items():
        a, b = np.asarray(a, float), np.asarray(b, float)
        (m, k), n = a.shape, b.shape[1]
        got = dense(matrix.multiply(cells(spark, a), cells(spark, b), m, n, k, strategy), m, n)
        np.testing.assert_allclose(got, a @ b, atol=1e-5, err_msg=name)


def test_unknown_names(spark):
    one = cells(spark, [[1]])
    with pytest.raises(ValueError):
        matrix.multiply(one, one, 1, 1, 1, "abacus")
    with pytest.raises(ValueError):
        matrix.elementwise(one, one, "divide")


def test_blocks_across_a_grid(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-3, 4, (23, 9)).astype(float), rng.integers(-3, 4, (9, 17)).astype(float)
    got = matrix.densify(matrix.multiply_block(cells(spark, a), cells(spark, b), 23, 17, 9, size=4), 23, 17)
    np.testing.assert_array_equal(dense(got, 23, 17), a @ b)


def test_wide_operands_fall_back_to_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 5, (12, 6)).astype(float), rng.integers(0, 5, (6, 7)).astype(float)
    product = matrix.multiply_rows(matrix.to_rows(cells(spark, a), 6), cells(spark, b), 6, 7, small_cells=10)
    np.testing.assert_array_equal(dense(matrix.to_cells(product), 12, 7), a @ b)
    monkeypatch.setattr(matrix, "SMALL_CELLS", 4)
    outer = matrix.multiply_outer(matrix.to_rows(cells(spark, a), 6), None, 6, 6)
    np.testing.assert_array_equal(dense(matrix.densify(outer, 6, 6), 6, 6), a.T @ a)


def test_hot_key_join(spark):
    """Column 0 of the sparse left side holds a third of its cells."""
    left = {(i, 0): 1.0 for i in range(300)} | {(i, 1 + i % 90): 2.0 for i in range(600)}
    right = {(k, j): float(k + j) for k in range(91) for j in range(3)}
    a = spark.createDataFrame([(*c, v) for c, v in left.items()], "i long, j long, v double")
    b = spark.createDataFrame([(*c, v) for c, v in right.items()], "i long, j long, v double")
    want = np.zeros((600, 3))
    for (i, k), x in left.items():
        for j in range(3):
            want[i, j] += x * right[k, j]
    np.testing.assert_array_equal(dense(matrix.multiply_join(a, b), 600, 3), want)


def test_elementwise(spark):
    count = filled(2, 3, lambda x: x + 1)
    np.testing.assert_allclose(dense(matrix.hadamard(cells(spark, count), cells(spark, np.full((2, 3), 2))), 2, 3),
                               count * 2)
    square = filled(4, 4, lambda x: x + 1)
    np.testing.assert_allclose(dense(matrix.hadamard(cells(spark, square), cells(spark, np.zeros((4, 4)))), 4, 4), 0)
    tall = filled(16, 8, lambda x: x)
    np.testing.assert_allclose(
        dense(matrix.add(cells(spark, tall * 1.5), cells(spark, tall * 0.5)), 16, 8), tall * 2)
    minus = filled(2, 2, lambda x: -x - 1)
    np.testing.assert_allclose(dense(matrix.add(cells(spark, minus), cells(spark, -minus)), 2, 2), 0)
    a, b = cells(spark, square), cells(spark, square[::-1])
    assert matrix.approx_equal(matrix.add(a, b), matrix.add(b, a)).first().is_equal
    sparse = matrix.add(cells(spark, [[1.0]]), spark.createDataFrame([(1, 1, 4.0)], "i long, j long, v double"))
    assert sorted(map(tuple, sparse.collect())) == [(0, 0, 1.0), (1, 1, 4.0)]
    rows = matrix.elementwise_rows(matrix.to_rows(a, 4), matrix.to_rows(b, 4), "add")
    np.testing.assert_allclose(dense(matrix.to_cells(rows), 4, 4), square + square[::-1])


def test_approx_equal(spark):
    a = cells(spark, [[1.0, 2.0]])
    near = cells(spark, [[1.0, 2.0001]])
    assert matrix.approx_equal(a, near, 1e-3).first().is_equal
    assert not matrix.approx_equal(a, near).first().is_equal
    fewer = matrix.approx_equal(a, a.where("j = 0")).first()
    assert (fewer.unmatched, fewer.is_equal) == (1, False)


def test_demo_and_corner(spark):
    demo = demo_matrix(spark, 7, 9)
    want = filled(7, 9, lambda x: (x % 10) * 0.1)
    np.testing.assert_allclose(dense(demo, 7, 9), want)
    shown = {(r.i, r.j): r.shown for r in matrix.corner(demo).collect()}
    assert len(shown) == 25 and shown[1, 2] == f"{want[1, 2]:.2f}"


def test_pushdown_reaches_the_scan(spark):
    from spikeframe.plans.algebra import _shipments
    plan = _shipments(spark, "/root/testdata/sf0.001", "l_returnflag = 'R'")._jdf.queryExecution().toString()
    assert "EqualTo(l_returnflag,R)" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_quantity:double,l_returnflag:string>" in plan


def whole(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_row_products_agree_on_both_sides_of_the_limit(spark):
    """Zero rows, repeated and sparse row numbers: the same rows below and above the limit."""
    a = spark.createDataFrame([(0, [1.0, 2.0]), (7, [0.0, 0.0]), (7, [3.0, 0.0]), (10**10, [0.0, 5.0])],
                              "i long, row array<double>")
    b = spark.createDataFrame([(0, 0, 2.0), (0, 0, 1.0), (1, 2, 4.0)], "i long, j long, v double")
    want = [(0, [3.0, 0.0, 8.0]), (7, [0.0, 0.0, 0.0]), (7, [9.0, 0.0, 0.0]), (10**10, [0.0, 0.0, 20.0])]
    for limit in (1 << 20, 1):
        assert whole(matrix.multiply_rows(a, b, 2, 3, small_cells=limit)) == sorted(want, key=repr)
        assert matrix.multiply_rows(a.limit(0), b, 2, 3, small_cells=limit).count() == 0
    outside = b.union(spark.createDataFrame([(2, 0, 1.0)], b.schema))
    for limit in (1 << 20, 1):
        with pytest.raises(Exception, match="lies outside"):
            matrix.multiply_rows(a, outside, 2, 3, small_cells=limit).collect()


def test_outer_products_agree_on_both_sides_of_the_limit(spark):
    a = spark.createDataFrame([(0, [1.0, 0.0]), (5, [0.0, 0.0]), (5, [2.0, 0.0])], "i long, row array<double>")
    b = spark.createDataFrame([(0, [1.0, 0.0, 3.0]), (5, [4.0, 0.0, 0.0])], "i long, row array<double>")
    own = [(0, 0, 5.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 0.0)]
    both = [(0, 0, 9.0), (0, 1, 0.0), (0, 2, 3.0), (1, 0, 0.0), (1, 1, 0.0), (1, 2, 0.0)]
    for limit in (1 << 20, 1):
        assert whole(matrix.multiply_outer(a, None, 2, 2, small_cells=limit)) == own
        assert whole(matrix.multiply_outer(a, b, 2, 3, small_cells=limit)) == both


def test_filled_rows_keep_their_numbers(spark):
    seen = spark.createDataFrame([(14, 1, 2.0)], "i long, j long, v double")
    ids = spark.createDataFrame([(7,), (14,), (14,)], "i long")
    assert whole(matrix.fill_rows(seen, ids, 2)) == [(14, 0, 0.0), (14, 1, 2.0), (7, 0, 0.0), (7, 1, 0.0)]


def test_float_elements(spark):
    """Single precision, with the tolerance its callers use."""
    a = np.array([[(8 * i + j) % 10 for j in range(8)] for i in range(8)]) * 0.1
    for strategy in ("join", "rows"):
        got = matrix.multiply(cells(spark, a), cells(spark, a), 8, 8, 8, strategy, element="float")
        assert got.schema["v"].dataType.simpleString() == "float"
        assert np.abs(dense(got, 8, 8) - a @ a).max() < 1e-4
    assert np.abs(dense(matrix.add(cells(spark, a), cells(spark, a), element="float"), 8, 8) - 2 * a).max() < 1e-5
    with pytest.raises(ValueError):
        matrix.add(cells(spark, a), cells(spark, a), element="int")
