"""Number of pairs that stand in the wrong order, per group, without forming a pair.

Rows are range partitioned twice, by place and by value. Two rows in the wrong order lie in one
block of places (counted inside it), or in two, and then in one block of values (counted there, less
the pairs that share both blocks) or in two (counted from the blocks' histogram). Blocks are bounded
by the range partitioning, whatever a group or a value holds: equal values are ordered by place,
which adds no inversion and lets a hot value be split.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffle_partitions


def earlier_greater(ranks: np.ndarray) -> np.ndarray:
    """For each element of a permutation of 0..n-1, how many elements before it are greater.

    Bit by bit from the top: among elements that agree so far, one with bit 0 has all those with
    bit 1 before it above it; then both halves are taken apart, order kept.
    """
    n = len(ranks)
    found = np.zeros(n, np.int64)  # by rank
    own = ranks.astype(np.int64)
    for bit in range(max(n - 1, 0).bit_length() - 1, -1, -1):
        one = (own >> bit) & 1
        node = own >> (bit + 1)
        start = np.flatnonzero(np.diff(node, prepend=-1))
        ones = np.cumsum(one) - one
        size = np.diff(np.append(start, n))
        before = ones - np.repeat(ones[start], size)
        zero = one == 0
        found[own[zero]] += before[zero]
        inside = np.arange(n) - np.repeat(start, size)
        zeros = np.repeat(size - (np.append(ones[start[1:]], ones[-1] + one[-1]) - ones[start]), size)
        place = np.repeat(start, size) + np.where(zero, inside - before, zeros + before)
        moved = np.empty_like(own)
        moved[place] = own
        own = moved
    return found[ranks]


def _counted(frame: pd.DataFrame, inside: list[str]) -> np.ndarray:
    """earlier_greater of rows in order of (inside, place), counted inside equal `inside` only."""
    order = frame.sort_values([*inside, "value", "place"], kind="stable").index
    ranks = np.empty(len(frame), np.int64)
    ranks[order] = np.arange(len(frame))
    return earlier_greater(ranks)


def _numbered(df: DataFrame, keys, out) -> DataFrame:
    """Block numbers of a range partitioning, fixed by a checkpoint."""
    return cut_lineage(df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).withColumn(
        out, F.spark_partition_id()))


def inversions(df: DataFrame, group: str, place: str, value: str) -> DataFrame:
    """group, n, inversions. Places are whole numbers, unique in a group; rows with NULL values are left out."""
    kind = df.schema[group].dataType.simpleString()
    rows = df.where(F.col(value).isNotNull()).select(
        F.col(group).alias("g"), F.col(place).cast("long").alias("place"), F.col(value).cast("double").alias("value"))
    rows = _numbered(_numbered(rows, ["g", "place"], "pb"), ["g", "value", "place"], "vb")

    def in_blocks(block, other):
        """Inversions inside each block, and of these the ones inside the other partitioning's blocks, too."""
        def kernel(keys, frame):
            frame = frame.sort_values(["gid", "place"], kind="stable").reset_index(drop=True)
            frame["inversions"] = _counted(frame, ["gid"])
            if other:
                frame["inversions"] -= _counted(frame, ["gid", other])
            return frame.groupby("g", dropna=False, sort=False)["inversions"].sum().reset_index()

        # groups lie in the block in their own order; dense numbers stand for them
        dealt = rows.select("g", "place", "value", block, *([other] if other else []))
        return dealt.groupBy(block).applyInPandas(lambda keys, frame: kernel(keys, frame.assign(
            gid=frame["g"].factorize(use_na_sentinel=False)[0])), f"g {kind}, inversions long")

    cells = rows.groupBy("g", "pb", "vb").agg(F.count(F.lit(1)).alias("n"))
    wide = rows.groupBy("g").agg(F.min("pb").alias("a"), F.max("pb").alias("b")).where("a < b").select(
        F.struct("g").alias("s"))

    def across(keys, frame):
        """Blocks' histogram of one group: earlier block of places, later block of values."""
        grid = np.zeros((frame["pb"].max() - frame["pb"].min() + 1, frame["vb"].max() - frame["vb"].min() + 1), np.int64)
        grid[frame["pb"] - frame["pb"].min(), frame["vb"] - frame["vb"].min()] = frame["n"]
        before = np.cumsum(grid, axis=0) - grid
        above = before[:, ::-1].cumsum(axis=1)[:, ::-1] - before
        return pd.DataFrame({"g": [keys[0]], "inversions": [int((grid * above).sum())]})

    # at most one group per border between blocks of places is wide
    between = cells.withColumn("s", F.struct("g")).join(wide, "s", "left_semi").drop("s").groupBy("g").applyInPandas(
        across, f"g {kind}, inversions long")
    found = in_blocks("pb", None).unionByName(in_blocks("vb", "pb")).unionByName(between)
    sums = found.groupBy("g").agg(F.sum("inversions").alias("inversions"))
    sizes = cells.groupBy("g").agg(F.sum("n").alias("n"))
    return sizes.join(sums.withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h"))).select(
        F.col("g").alias(group), "n", "inversions")
