"""Connected components of a links table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """One large star and one small star; both only move links towards smaller nodes.

    Minima are written before they are joined, so both sides of each join are plain scans whose
    hot nodes adaptive execution can split.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{name}-large")
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    large = scratch.write(large, f"{name}-linked")
    least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-small")
    moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = moved.union(least.select("u", F.col("m").alias("v"))).distinct()
    return scratch.write(small, name)


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (the smallest node) of all nodes that have links; links are rows u, v of longs.

    Every round is a written table, so a lost executor repeats one round at most.
    """
    edges = scratch.write(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "round0")

    def state(df):
        row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 31) - 1)))).first()
        return row[0], row[1]

    before, k = state(edges), 0
    while before[0]:
        k += 1
        edges = _stars(edges, scratch, f"round{k}")
        for part in (f"round{k}-large", f"round{k}-linked", f"round{k}-small", f"round{k - 1}"):
            scratch.delete(part)
        now = state(edges)
        if now == before:
            break
        before = now
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("v", "v"))
