"""Matrix products over other semirings, cell by cell or in dense blocks, and paths by repeated squaring.

`min_plus`: sums are minima, products are sums: costs of cheapest ways; an absent cell is no way.
`or_and`: whether there is a way at all; an absent cell is none.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import salted_join
from ..session import cut_lineage, shuffle_partitions
from .matrix import _blocks

BLOCK = 128


def _min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full((len(a), b.shape[1]), np.inf)
    for k in np.flatnonzero(np.isfinite(a).any(axis=0) & np.isfinite(b).any(axis=1)):
        np.minimum(out, a[:, k:k + 1] + b[k], out=out)
    return out


def _or_and(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a > 0).astype(np.float32) @ (b > 0).astype(np.float32) > 0).astype(float)


#: Absent value, neutral value of the product, block product, sum of blocks, sum of cells.
SEMIRINGS = {"min_plus": (np.inf, 0.0, _min_plus, np.minimum, F.min), "or_and": (0.0, 1.0, _or_and, np.maximum, F.max)}


def _block_products(size: int, kind: str, flush: int = 64):
    absent, _, product, add, _ = SEMIRINGS[kind]

    def dense(column, r):
        block = np.full(size * size, absent)
        cells = column[r].values
        block[cells.field("at").to_numpy()] = cells.field("v").to_numpy()  # one cell a place
        return block.reshape(size, size)

    def emit(sums):
        rows, columns, values = [], [], []
        for (bi, bj), block in sums.items():
            i, j = np.nonzero(block != absent)
            rows.append(bi * size + i)
            columns.append(bj * size + j)
            values.append(block[i, j])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x)) for x in (rows, columns, values)], names=["i", "j", "v"])

    def run(batches):
        sums = {}
        for batch in batches:
            for r in range(batch.num_rows):
                key = (batch.column("bi")[r].as_py(), batch.column("bj")[r].as_py())
                own = product(dense(batch.column("a"), r), dense(batch.column("b"), r))
                sums[key] = add(sums[key], own) if key in sums else own
                if len(sums) >= flush:
                    yield emit(sums)
                    sums = {}
        if sums:
            yield emit(sums)
    return run


def multiply(a: DataFrame, b: DataFrame, kind: str, size: int = BLOCK) -> DataFrame:
    """Product of coordinate matrices (i, j, v); repeated cells are added first, numbers are not negative.

    Blocks meet on (middle block, row bucket, column bucket), so a short middle dimension still fills
    the cluster; what leaves a task is already added up inside it.
    """
    total = SEMIRINGS[kind][4]
    side = max(1, math.isqrt(shuffle_partitions(a.sparkSession)))
    one = [m.groupBy("i", "j").agg(total("v").alias("v")) for m in (a, b)]
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(side - 1).cast("bigint")))
    left = (_blocks(one[0], "i", "j", size).withColumnRenamed("bj", "bk").withColumnRenamed("cells", "a")
            .withColumn("gi", F.col("bi") % side).withColumn("gj", every))
    right = (_blocks(one[1], "i", "j", size).withColumnRenamed("bi", "bk").withColumnRenamed("cells", "b")
             .withColumn("gj", F.col("bj") % side).withColumn("gi", every))
    pairs = left.join(right, ["bk", "gi", "gj"]).select("bi", "bj", "a", "b")
    partial = pairs.mapInArrow(_block_products(size, kind), "i bigint, j bigint, v double")
    return partial.groupBy("i", "j").agg(total("v").alias("v"))


def present(cells: DataFrame, kind: str) -> DataFrame:
    """Repeated cells added, absent ones left out."""
    found = cells.where("v < double('inf')") if kind == "min_plus" else cells.where("v > 0").withColumn("v", F.lit(1.0))
    return found.groupBy("i", "j").agg(SEMIRINGS[kind][4]("v").alias("v"))


def multiply_cells(a: DataFrame, b: DataFrame, kind: str) -> DataFrame:
    """The same product of cells as `present` gives them, joined on the middle: for sparse networks, where
    a block would hold a few cells only. Middles with many cells are salted."""
    left = a.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    way = F.col("x") + F.col("y") if kind == "min_plus" else F.least("x", "y")
    return salted_join(left, right, "k", ["i"]).groupBy("i", "j").agg(SEMIRINGS[kind][4](way).alias("v"))


def within_hops(edges: DataFrame, hops: int, kind: str, size: int | None = None) -> DataFrame:
    """(i, j, v) over ways of at most `hops` edges, none included; about 2 * log2(hops) products, each written.

    Products join cells; with a `size` they are made of dense blocks, which suits networks whose cells are mostly filled.
    """
    def times(a, b):
        return cut_lineage(multiply(a, b, kind, size) if size else multiply_cells(a, b, kind))

    neutral = F.lit(SEMIRINGS[kind][1])
    nodes = edges.select("i").union(edges.select(F.col("j").alias("i"))).distinct()
    loops = nodes.select("i", F.col("i").alias("j"), neutral.alias("v"))
    if not hops:
        return loops
    steps = edges.select("i", "j", F.col("v").cast("double").alias("v"))
    power = cut_lineage(present(steps.unionByName(loops), kind))
    found = None
    while hops:
        if hops & 1:
            found = power if found is None else times(found, power)
        hops >>= 1
        if hops:
            power = times(power, power)
    return found
