"""Dense and sparse matrix algebra on DataFrames.

Two forms: coordinates ``(i, j, v)`` and row arrays ``(i, row ARRAY<DOUBLE>)``.
``multiply`` has one strategy per shape of the operands:

* ``rows``  - many rows times a small matrix: the small side is sent to the tasks
  after its cell count was checked; no shuffle of the large side.
* ``outer`` - transpose-multiply of two tall row tables with the same row numbers:
  every task sums its own small product, and one grouped sum merges them.
* ``join``  - sparse coordinates: salted join on k, then a grouped sum.
* ``block`` - two large dense operands: square blocks on a replicated grid.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import int_div, mix, two_decimals
from ..functions.skew import salted_join
from ..session import cut_lineage, shuffle_partitions

STRATEGIES = {
    "rows": "row arrays times a small matrix",
    "outer": "per-task products of tall tables",
    "join": "salted coordinate join",
    "block": "dense blocks on a grid",
}
SMALL_CELLS = 1 << 20
BLOCK = 128


def strategy_name(strategy):
    return STRATEGIES.get(strategy)


def to_rows(cells: DataFrame, n: int) -> DataFrame:
    """Coordinates to dense row arrays of ``n`` columns; absent cells are 0."""
    listed = cells.groupBy("i").agg(F.map_from_entries(
        F.collect_list(F.struct(F.col("j").cast("int"), "v"))).alias("cells"))
    return listed.select("i", F.expr(
        f"transform(sequence(0, {n - 1}), j -> coalesce(try_element_at(cells, j), 0D))").alias("row"))


def to_cells(rows: DataFrame) -> DataFrame:
    return rows.select("i", F.posexplode("row").alias("j", "v")).select(
        "i", F.col("j").cast("bigint").alias("j"), "v")


def transpose(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def densify(cells: DataFrame, m: int, n: int) -> DataFrame:
    """All m*n cells; absent ones are 0. The grid is one range, not a cross join."""
    grid = cells.sparkSession.range(m * n).select(
        int_div("id", n).alias("i"), (F.col("id") % n).alias("j"))
    return grid.join(cells, ["i", "j"], "left").select(
        "i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def fill_rows(cells: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """All n cells of the given rows ``i``, whatever their numbers; absent ones are 0."""
    grid = rows.select("i").distinct().select(F.col("i").cast("bigint").alias("i"), F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("j"))
    return grid.join(cells, ["i", "j"], "left").select(
        "i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def multiply_join(a: DataFrame, b: DataFrame, key_sizes=None) -> DataFrame:
    """Sparse product of coordinate matrices; cells that no pair reaches are absent.
    ``key_sizes(k)`` may stand for the cells per column of ``a``, see ``salted_join``."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return (salted_join(left, right, "k", ["i"], key_sizes)
            .groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v")))


def _within(cells: DataFrame, m: int, n: int) -> DataFrame:
    """The cells; one outside m x n is an error, whichever way the product is made."""
    fits = F.col("i").between(0, m - 1) & F.col("j").between(0, n - 1)
    return cells.select("i", "j", F.when(fits, F.col("v")).otherwise(F.raise_error(F.format_string(
        f"cell (%d, %d) lies outside {m} x {n}", F.col("i").cast("long"), F.col("j").cast("long"))).cast("double")).alias("v"))


def multiply_rows(a: DataFrame, b: DataFrame, k: int, n: int, small_cells=SMALL_CELLS) -> DataFrame:
    """Row arrays ``a`` times coordinates ``b`` (k x n): one row for every row of ``a``,
    repeated row numbers included. The product k*n bounds what is sent to the tasks;
    above the limit the block strategy takes over, with the same rows."""
    cells = _within(b, k, n).groupBy("i", "j").agg(F.sum("v").alias("v"))
    if k * n > small_cells:
        # rows get numbers of their own, fixed by the checkpoint, so that equal ones stay apart
        placed = cut_lineage(a.select("i", F.col("row").cast("array<double>").alias("row")).withColumn(
            "_id", F.monotonically_increasing_id()))
        left = to_cells(placed.select(F.col("_id").alias("i"), "row"))
        product = to_rows(multiply_block(left, cells, 1 << 33, n, k), n).select(
            F.col("i").alias("_id"), F.col("row").alias("_product"))
        zeros = F.array_repeat(F.lit(0.0), n)
        return placed.join(product, "_id", "left").select("i", F.coalesce("_product", zeros).alias("row"))
    listed = cells.toPandas()  # at most k*n rows
    dense = np.zeros((k, n))
    dense[listed["i"].to_numpy(int), listed["j"].to_numpy(int)] = listed["v"].to_numpy(float)
    shared = a.sparkSession.sparkContext.broadcast(dense)

    def run(batches):
        for batch in batches:
            rows = batch.column("row").flatten().to_numpy(zero_copy_only=False)
            product = rows.reshape(batch.num_rows, k) @ shared.value
            offsets = pa.array(np.arange(0, product.size + 1, n, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("i"), pa.ListArray.from_arrays(offsets, pa.array(product.ravel()))],
                names=["i", "row"])

    return a.select("i", F.col("row").cast("array<double>")).mapInArrow(run, "i bigint, row array<double>")


def multiply_outer(a: DataFrame, b: DataFrame | None, m: int, n: int, small_cells=None) -> DataFrame:
    """Transpose of ``a`` (rows of m values) times ``b`` (rows of n values), both keyed by
    the same row number; ``b`` None means ``a`` itself, row by row. Returns m*n coordinates.
    Every task holds and emits m*n cells, so wide operands take the block strategy, with
    the same cells."""
    if m * n > (SMALL_CELLS if small_cells is None else small_cells):
        if b is None:
            a = b = cut_lineage(a.select(F.monotonically_increasing_id().alias("i"), "row"))
        left, right = to_cells(a), to_cells(b)
        return densify(multiply_block(transpose(left), right, m, n, 1 << 33), m, n)
    if b is None:
        pairs = a.select(F.col("row").cast("array<double>").alias("x")).withColumn("y", F.col("x"))
    else:
        pairs = a.select("i", F.col("row").cast("array<double>").alias("x")).join(
            b.select("i", F.col("row").cast("array<double>").alias("y")), "i").select("x", "y")

    def run(batches):
        total = np.zeros((m, n))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
            y = batch.column("y").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            total += x.T @ y
        i, j = np.indices((m, n))
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    partial = pairs.mapInArrow(run, "i bigint, j bigint, v double")
    return partial.groupBy("i", "j").agg(F.sum("v").alias("v"))


def _blocks(cells, row, column, size):
    """Dense size*size blocks; a block collects at most size*size cells."""
    return (cells.groupBy(int_div(row, size).alias("bi"), int_div(column, size).alias("bj"))
            .agg(F.collect_list(F.struct(
                ((F.col(row) % size) * size + F.col(column) % size).cast("int").alias("at"), "v")).alias("cells")))


def _block_products(size, flush=64):
    def dense(column, r):
        block = np.zeros(size * size)
        cells = column[r].values
        np.add.at(block, cells.field("at").to_numpy(), cells.field("v").to_numpy())
        return block.reshape(size, size)

    def emit(sums):
        keys = list(sums)
        at = np.concatenate([np.flatnonzero(sums[k]) for k in keys])
        lengths = [np.count_nonzero(sums[k]) for k in keys]
        v = np.concatenate([sums[k].ravel()[np.flatnonzero(sums[k])] for k in keys])
        bi = np.repeat([k[0] for k in keys], lengths)
        bj = np.repeat([k[1] for k in keys], lengths)
        return pa.RecordBatch.from_arrays(
            [pa.array(bi * size + at // size), pa.array(bj * size + at % size), pa.array(v)],
            names=["i", "j", "v"])

    def run(batches):
        sums = {}
        for batch in batches:
            for r in range(batch.num_rows):
                key = (batch.column("bi")[r].as_py(), batch.column("bj")[r].as_py())
                product = dense(batch.column("a"), r) @ dense(batch.column("b"), r)
                sums[key] = sums[key] + product if key in sums else product
                if len(sums) >= flush:
                    yield emit(sums)
                    sums = {}
        if sums:
            yield emit(sums)
    return run


def multiply_block(a: DataFrame, b: DataFrame, m: int, n: int, k: int, size=BLOCK) -> DataFrame:
    """Dense product of coordinate matrices a (m x k) and b (k x n).

    Blocks meet on (k block, row bucket, column bucket). The bucket grid is chosen so
    that a short k still fills the cluster; each a block is sent once per column bucket
    and each b block once per row bucket. Zero cells of the product are dropped; use
    ``densify`` for the full grid.
    """
    parts = shuffle_partitions(a.sparkSession)
    steps = max(1, math.ceil(k / size))
    side = max(1, math.ceil(math.sqrt(parts / steps)))
    down, across = min(side, math.ceil(m / size)), min(side, math.ceil(n / size))
    left = (_blocks(a, "i", "j", size).withColumnRenamed("bj", "bk").withColumnRenamed("cells", "a")
            .withColumn("gi", F.col("bi") % down)
            .withColumn("gj", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(across - 1).cast("bigint")))))
    right = (_blocks(b, "i", "j", size).withColumnRenamed("bi", "bk").withColumnRenamed("cells", "b")
             .withColumn("gj", F.col("bj") % across)
             .withColumn("gi", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(down - 1).cast("bigint")))))
    pairs = left.join(right, ["bk", "gi", "gj"]).select("bi", "bj", "a", "b")
    partial = pairs.mapInArrow(_block_products(size), "i bigint, j bigint, v double")
    return partial.groupBy("i", "j").agg(F.sum("v").alias("v"))


def _typed(cells: DataFrame, element) -> DataFrame:
    """Cells rounded to the element type; ``float`` halves what is stored and shipped."""
    if element not in ("double", "float"):
        raise ValueError(f"unknown element type {element!r}")
    return cells if element == "double" else cells.select("i", "j", F.col("v").cast("float").alias("v"))


def multiply(a: DataFrame, b: DataFrame, m: int, n: int, k: int, strategy="join", element="double") -> DataFrame:
    """C = A * B on coordinates, all m*n cells present. With ``float`` elements the inputs
    and the result are rounded; sums are still formed in double."""
    if element != "double":
        a, b = (_typed(x, element).select("i", "j", F.col("v").cast("double").alias("v")) for x in (a, b))
        return _typed(multiply(a, b, m, n, k, strategy), element)
    if strategy == "join":
        product = multiply_join(a, b)
    elif strategy == "block":
        product = multiply_block(a, b, m, n, k)
    elif strategy == "rows":
        product = to_cells(multiply_rows(to_rows(a, k), b, k, n))
    elif strategy == "outer":
        product = multiply_outer(to_rows(transpose(a), m), to_rows(b, n), m, n)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return densify(product, m, n)


def elementwise(a: DataFrame, b: DataFrame, op, element="double") -> DataFrame:
    """``hadamard`` or ``add`` on coordinates with unique cells, absent ones being 0.
    Both sides are merged by one grouped pass instead of an outer join."""
    if element != "double":
        return _typed(elementwise(_typed(a, element), _typed(b, element), op), element)
    both = (a.select("i", "j", F.col("v").alias("x"), F.lit(None).cast("double").alias("y"))
            .unionAll(b.select("i", "j", F.lit(None).cast("double"), "v"))
            .groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("y").alias("y")))
    if op == "hadamard":
        return both.where("x is not null and y is not null").select(
            "i", "j", (F.col("x") * F.col("y")).alias("v"))
    if op == "add":
        return both.select("i", "j", (F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0))).alias("v"))
    raise ValueError(f"unknown operation {op!r}")


def hadamard(a, b, element="double"):
    return elementwise(a, b, "hadamard", element)


def add(a, b, element="double"):
    return elementwise(a, b, "add", element)


def elementwise_rows(a: DataFrame, b: DataFrame, op) -> DataFrame:
    """The same operations on row arrays of equal width."""
    combine = {"hadamard": lambda x, y: x * y, "add": lambda x, y: x + y}[op]
    return (a.join(b.select("i", F.col("row").alias("_other")), "i")
            .select("i", F.zip_with("row", "_other", combine).alias("row")))


def approx_equal(a: DataFrame, b: DataFrame, tolerance=1e-5) -> DataFrame:
    """One row: cells seen, cells only one side has, largest difference, verdict."""
    both = (a.select("i", "j", F.col("v").alias("x"), F.lit(None).cast("double").alias("y"))
            .unionAll(b.select("i", "j", F.lit(None).cast("double"), "v"))
            .groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("y").alias("y")))
    found = both.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unmatched"),
        F.coalesce(F.max(F.abs(F.col("x") - F.col("y"))), F.lit(0.0)).alias("max_diff"))
    return found.select("*", ((F.col("unmatched") == 0) & (F.col("max_diff") <= tolerance)).alias("is_equal"))


def _signed_sums(cells: DataFrame, by, vectors) -> DataFrame:
    """Cells times the sign vectors from the right: one row of sums x0, x1, ... for each value of `by`."""
    def sign(k):
        return F.when(mix(F.col("j") * vectors + k, seed=k + 1) % 2 == 0, 1).otherwise(-1)

    return cells.groupBy(by).agg(*[F.sum(F.col("v") * sign(k)).alias(f"x{k}") for k in range(vectors)])


def signed_product(a: DataFrame, b: DataFrame, vectors=8) -> DataFrame:
    """a times b times the sign vectors of `product_holds`, without the product: i, x0, x1, ..."""
    inner = _signed_sums(b, F.col("i").alias("j"), vectors)
    return salted_join(a, inner, "j", ["i"]).groupBy("i").agg(
        *[F.sum(F.col("v") * F.col(f"x{k}")).alias(f"x{k}") for k in range(vectors)])


def product_holds(a: DataFrame, b: DataFrame, c: DataFrame, vectors=8, tolerance=1e-6, through=None) -> DataFrame:
    """vector, wrong_rows: Freivalds' check of a times b against c by random sign vectors.

    Multiplying by a vector from the right takes one grouped pass over each matrix, so the check
    costs as much as reading the three, whatever the product costs. An equal product never has wrong
    rows; a product with a wrong cell passes one vector with probability one half at most, and all of
    them with probability 2^-vectors. Signs are drawn by a hash of column and vector number. ``through``
    may be `signed_product` of a and b, made once for the checks of several products.
    """
    if through is None:
        through = signed_product(a, b, vectors)
    direct = _signed_sums(c, "i", vectors)
    both = through.select("i", *[F.col(f"x{k}") for k in range(vectors)]).unionByName(
        direct.select("i", *[(-F.col(f"x{k}")).alias(f"x{k}") for k in range(vectors)])).groupBy("i").agg(
        *[F.sum(f"x{k}").alias(f"x{k}") for k in range(vectors)])
    wrong = both.agg(*[F.count_if(F.abs(f"x{k}") > tolerance).alias(f"x{k}") for k in range(vectors)])
    return wrong.select(F.posexplode(F.array(*[f"x{k}" for k in range(vectors)])).alias("vector", "wrong_rows"))


def corner(cells: DataFrame, limit=5) -> DataFrame:
    """Top-left corner as display text with two decimals."""
    return (cells.where((F.col("i") < limit) & (F.col("j") < limit))
            .select("i", "j", two_decimals("v").alias("shown")))
