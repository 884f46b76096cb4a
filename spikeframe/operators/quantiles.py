"""Quantiles: a mergeable sketch with a certificate of its rank error, and exact selection without a sort.

The sketch keeps sorted buffers of at most `k` values; a value of level h stands for 2^h values. A
full buffer is compacted: of its sorted values every other one moves one level up. That shifts any
rank by at most 2^h, and the sketch adds up what its compactions may have shifted: `error` is a
proven bound for every rank, whatever the order of merges. With n values it stays below
(n / k) * log2(n / k) * 2. The least and greatest values are kept exactly.

Selection refines histograms: the interval that holds the wanted rank is narrowed by `bits` binary
digits in each counting pass, so the number of passes follows from the values' range alone. Ties
need no care: the last interval is one value.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Groups a task holds at once before it hands on their partial sketches.
HELD_GROUPS = 4096


class Sketch:
    def __init__(self, k: int):
        self.k, self.n, self.error = k, 0, 0
        self.low, self.high = math.inf, -math.inf
        self.levels: list[np.ndarray] = []

    def add(self, values: np.ndarray, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append(np.zeros(0))
        self.levels[level] = np.append(self.levels[level], values)

    def update(self, values: np.ndarray) -> None:
        if len(values):
            self.n += len(values)
            self.low, self.high = min(self.low, values.min()), max(self.high, values.max())
            self.add(values)
            self.compact()

    def merge(self, n, error, low, high, levels) -> None:
        self.n, self.error = self.n + n, self.error + error
        self.low, self.high = min(self.low, low), max(self.high, high)
        for level, values in enumerate(levels):
            self.add(np.asarray(values, float), level)
        self.compact()

    def compact(self) -> None:
        level = 0
        while level < len(self.levels):
            own = self.levels[level]
            if len(own) >= self.k:
                own = np.sort(own)
                whole = len(own) & ~1  # an odd last value stays
                self.levels[level] = own[whole:]
                self.add(own[:whole][(level & 1)::2], level + 1)
                self.error += 1 << level
            level += 1

    def row(self) -> tuple:
        return self.n, self.error, self.low, self.high, [v.tolist() for v in self.levels]


_PARTS = "n long, error long, low double, high double, levels array<array<double>>"


def sketches(df: DataFrame, key: str, value: str, k: int = 512) -> DataFrame:
    """key, n, error, low, high, levels: one sketch per key; NULL and NaN values are left out.

    One pass over the rows; tasks hand on partial sketches only, which are merged in two rounds, so
    that no task gets all partial sketches of a hot key.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        key, F.col(value).cast("double").alias("value"))

    def partial(frames):
        held: dict = {}

        def give():
            out = pd.DataFrame([(key_, *s.row()) for key_, s in held.items()],
                               columns=[key, "n", "error", "low", "high", "levels"])
            held.clear()
            return out

        for frame in frames:
            for own, part in frame.groupby(key, dropna=False, sort=False):
                held.setdefault(None if pd.isna(own) else own, Sketch(k)).update(part["value"].to_numpy())
            if len(held) > HELD_GROUPS:
                yield give()
        yield give()

    def merged(keys, frame):
        sketch = Sketch(k)
        for r in frame.itertuples(index=False):
            sketch.merge(r.n, r.error, r.low, r.high, r.levels)
        return pd.DataFrame([(keys[0], *sketch.row())], columns=[key, "n", "error", "low", "high", "levels"])

    schema = f"`{key}` {kind}, {_PARTS}"
    parts = rows.mapInPandas(partial, schema).withColumn("_part", F.spark_partition_id() % 64)
    some = parts.groupBy(key, "_part").applyInPandas(merged, schema)
    return some.groupBy(key).applyInPandas(merged, schema)


def sketch_quantiles(found: DataFrame, key: str, fractions) -> DataFrame:
    """key, fraction, n, error, value: a value whose rank is within `error` of ceil(fraction * n)."""
    entries = F.array_sort(F.flatten(F.transform("levels", lambda values, level: F.transform(
        values, lambda v: F.struct(v.alias("v"), F.call_function("shiftleft", F.lit(1).cast("long"), level).alias("w"))))))
    runs = F.aggregate(entries, F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast(
        "array<struct<v: double, upto: bigint>>").alias("all")), lambda s, e: F.struct(
        (s["sum"] + e["w"]).alias("sum"), F.concat(s["all"], F.array(F.struct(
            e["v"].alias("v"), (s["sum"] + e["w"]).alias("upto")))).alias("all")))["all"]
    each = found.withColumn("_runs", runs).select("*", F.explode(F.array(*map(F.lit, fractions))).alias("fraction"))
    rank = F.greatest(F.ceil(F.col("fraction") * F.col("n")), F.lit(1))
    hit = F.get(F.filter("_runs", lambda e: e["upto"] >= rank), F.lit(0))["v"]
    return each.select(key, "fraction", "n", "error", F.when(rank >= F.col("n"), F.col("high")).otherwise(
        F.coalesce(hit, F.col("high"))).alias("value"))


def kth_values(df: DataFrame, key: str, value: str, permilles, bits: int = 10) -> DataFrame:
    """key, permille, k, value: the value of rank k = ceil(permille * n / 1000), at least 1, of each group.

    Values are whole numbers (NULLs are left out). Each pass counts values by the next `bits` binary
    digits inside the intervals still wanted; partial counts leave the tasks, never rows.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.struct(key).alias("_g"), F.col(value).cast("long").alias("_v"))
    range_ = rows.agg(F.min("_v").alias("low"), F.max("_v").alias("high")).first()
    low = range_["low"] or 0
    width = ((range_["high"] or 0) - low).bit_length()
    if width > 62:
        raise ValueError("the values' range must be below 2^62")
    rows = rows.withColumn("_v", F.col("_v") - F.lit(low))
    shift = max(0, -(-width // bits) * bits)
    sizes = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n"))
    wanted = sizes.select("_g", F.explode(F.array(*map(F.lit, permilles))).alias("permille"), "n").select(
        "_g", "permille", F.greatest(F.expr("(permille * n + 999) div 1000"), F.lit(1)).alias("k")).withColumn(
        "rest", F.col("k")).withColumn("prefix", F.lit(0).cast("long"))
    while shift:
        own = cut_lineage(wanted)
        inside = own.select("_g", "prefix").distinct()
        step = shift - bits
        counts = rows.withColumn("prefix", F.shiftright("_v", shift)).join(inside, ["_g", "prefix"], "left_semi").groupBy(
            "_g", "prefix", F.shiftright("_v", step).alias("next")).agg(F.count(F.lit(1)).alias("c"))
        upto = Window.partitionBy("_g", "prefix").orderBy("next")
        counts = counts.withColumn("upto", F.sum("c").over(upto))
        wanted = own.join(counts, ["_g", "prefix"]).where(
            (F.col("rest") <= F.col("upto")) & (F.col("rest") > F.col("upto") - F.col("c"))).select(
            "_g", "permille", "k", (F.col("rest") - F.col("upto") + F.col("c")).alias("rest"), F.col("next").alias("prefix"))
        shift = step
    return wanted.select(f"_g.{key}", "permille", "k", (F.col("prefix") + F.lit(low)).alias("value"))
