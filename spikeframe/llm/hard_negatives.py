"""Hard negatives by vertical scans: dimensions in each anchor's order, candidates ruled out by what is left.

Vectors lie in blocks, one column per dimension. For an anchor the columns are read in the order of
its descending magnitudes; after each few columns the least and the greatest contribution that the
columns not yet read can make (from the columns' minima and maxima) bound every candidate's score,
and candidates leave the bitmap as soon as their bounds can't reach a result. What stays to the last
column has its exact score.

Two scans: the first finds each anchor's positives (a candidate leaves when its upper bound is below
the lower bounds of enough others), the second the negatives (it leaves when it can't fall into the
window of any positive, or only below enough certain ones). Every anchor meets every block: anchors
are repeated per block, in streams of rows beside the block's own, so a task holds one block and a
batch of anchors. Tasks keep the best few of each anchor and window; a ranked window merges them.

All scores are exact integers; where they could pass the exact range of floating point numbers,
integers are used. Defined results: rows without an id take part and rank last among equal scores;
repeated rows are rows of their own; missing components of shorter vectors count as zero; a vector
with a component beyond +-2^19 takes no part, its scores needn't fit into a long; an anchor without
positives, and a positive without rows in its window, gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of a block at most (about), and of the parts of it that are scanned at once.
BLOCK_ROWS = 1 << 16
ZONE_ROWS = 1 << 13
#: A component beyond this takes its row out.
GREATEST = float(1 << 19)


def scaled_rows(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                scale: int = 256) -> DataFrame:
    """id, label, v of the rows that take part; v holds floor(scale * component)."""
    x = F.col(vector_col)
    whole = F.coalesce(F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) <= GREATEST, F.lit(False))), F.lit(False))
    return vectors.where(F.col(label_col).isNotNull() & whole).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("v"))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows as a matrix; shorter ones end in zeros."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _stacked(matrices: list[np.ndarray]) -> np.ndarray:
    width = max(m.shape[1] for m in matrices)
    return np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in matrices])


class Rows:
    """Ids (with a flag where there is none), numbers and labels of some rows."""

    def __init__(self, uid, ident, absent, label):
        self.uid, self.ident, self.absent, self.label = uid, ident, absent, label

    def at(self, index) -> Rows:
        return Rows(self.uid[index], self.ident[index], self.absent[index], self.label[index])

    @staticmethod
    def of(batch: pa.RecordBatch) -> Rows:
        ident = batch.column("id")
        return Rows(batch.column("uid").to_numpy(), ident.fill_null(0).to_numpy(zero_copy_only=False),
                    ident.is_null().to_numpy(zero_copy_only=False), batch.column("label").to_numpy())

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        return Rows(*[np.concatenate([getattr(p, k) for p in parts]) for k in ("uid", "ident", "absent", "label")])


class Zone:
    """Some rows of a block, by columns."""

    def __init__(self, rows: Rows, vectors: np.ndarray):
        self.rows, self.exact = rows, vectors
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        self.reach = int(np.abs(vectors).max(initial=0))
        self.columns: dict = {}

    def of_kind(self, kind) -> np.ndarray:
        if kind not in self.columns:
            self.columns[kind] = np.ascontiguousarray(self.exact.T.astype(kind))
        return self.columns[kind]

    def scan(self, anchor: np.ndarray, index: np.ndarray, possible) -> tuple[np.ndarray, np.ndarray]:
        """Rows of `index` that stay possible to the last column, and their scores.

        `possible(least, most)` judges bounds of the scores. Columns are read in runs that halve what
        is left of them, as little can be ruled out before the anchor's large components are known.
        """
        width = min(len(anchor), len(self.low))
        anchor = anchor[:width]
        bound = width * self.reach * int(np.abs(anchor).max(initial=0))
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        columns = self.of_kind(kind)
        order = np.argsort(-np.abs(anchor), kind="stable")
        a, low, high = anchor[order], self.low[:width][order], self.high[:width][order]
        # what columns k and later can add at least and at most
        least, most = (np.append(np.cumsum(x[::-1])[::-1], 0) for x in (
            np.minimum(a * low, a * high), np.maximum(a * low, a * high)))
        weight = a.astype(kind)
        score, done = np.zeros(len(index), kind), 0
        whole = len(index) == columns.shape[1]
        while done < width and len(index):
            stop = min(width, done + max(4, (width - done) // 2))
            part = columns[order[done:stop]] if whole else columns[order[done:stop, None], index]
            score = score + weight[done:stop] @ part
            done = stop
            if done < width:
                bitmap = possible(score + kind(least[done]), score + kind(most[done]))
                if not bitmap.all():
                    index, score, whole = index[bitmap], score[bitmap], False
        return index, score.astype(np.int64)


class Best:
    """The best `k` rows seen: greater scores first, then smaller ids, rows without an id last."""

    def __init__(self, k: int):
        self.k, self.score, self.rows = k, np.zeros(0, np.int64), None

    def add(self, score: np.ndarray, rows: Rows) -> None:
        if not len(score):
            return
        rows = rows if self.rows is None else Rows.joined([self.rows, rows])
        score = np.append(self.score, score)
        first = np.lexsort((rows.uid, rows.ident, rows.absent, -score))[:self.k]
        self.score, self.rows = score[first], rows.at(first)

    def floor(self, certain: np.ndarray):
        """A score that the k-th best row surely reaches: of those seen, and of `certain` lower bounds."""
        known = self.score[-1] if len(self.score) == self.k else None
        if len(certain) >= self.k:
            bound = np.partition(certain, len(certain) - self.k)[len(certain) - self.k]
            return bound if known is None else max(known, bound)
        return known


def find_positives(zones: list[Zone], uid: int, label: int, anchor: np.ndarray, k: int) -> Best:
    best = Best(k)
    for zone in zones:
        index = np.flatnonzero((zone.rows.label == label) & (zone.rows.uid != uid))

        def possible(least, most):
            floor = best.floor(least)
            return np.ones(len(least), bool) if floor is None else most >= floor

        index, score = zone.scan(anchor, index, possible)
        best.add(score, zone.rows.at(index))
    return best


def find_negatives(zones: list[Zone], label: int, anchor: np.ndarray, windows: list[tuple[int, int]],
                   k: int) -> list[Best]:
    """The best rows of another label in each window of scores (both ends inside)."""
    found = [Best(k) for _ in windows]
    distinct: dict = {}
    for n, window in enumerate(windows):
        distinct.setdefault(window, found[n])
    highest = max(high for _, high in distinct)
    for zone in zones:
        index = np.flatnonzero(zone.rows.label != label)

        def possible(least, most):
            reach = []  # what a row must reach to count in a window
            for (low, high), best in distinct.items():
                full = len(best.score) == k  # then the rows seen bound it, otherwise those certain to lie inside
                floor = best.score[-1] if full else best.floor(least[(least >= low) & (most <= high)])
                reach.append(low if floor is None else max(low, floor))
            return (most >= min(reach)) & (least <= highest)

        index, score = zone.scan(anchor, index, possible)
        for (low, high), best in distinct.items():
            inside = (score >= low) & (score <= high)
            best.add(score[inside], zone.rows.at(index[inside]))
    return [distinct[window] for window in windows]


def _streams(batches, zone_rows: int):
    """(zones of a block, anchors' batch) for rows sorted by block, the block's own rows first."""
    block, held, zones = None, [], []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy() for k in ("block", "kind")], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            part = batch.slice(start, stop - start)
            if key[start, 0] != block:
                block, held, zones = key[start, 0], [], []
            if key[start, 1] == 0:
                held.append((Rows.of(part), _matrix(part.column("v"))))
                continue
            if held:
                rows, vectors = Rows.joined([r for r, _ in held]), _stacked([m for _, m in held])
                order = np.argsort(rows.label, kind="stable")  # a label's rows share few zones
                zones = [Zone(rows.at(at), vectors[at]) for at in np.split(order, range(zone_rows, len(order), zone_rows))]
                held = []
            if zones:
                yield zones, part


def _by_block(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Each block's rows, then all anchors, as one partition's sorted stream."""
    columns = ["block", "kind", "uid", "id", "label", "v", "windows"]
    own = rows.withColumn("kind", F.lit(0)).withColumn(
        "windows", F.lit(None).cast("array<struct<low: bigint, high: bigint>>")).select(*columns)
    theirs = anchors.withColumn("kind", F.lit(1)).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*columns)
    return own.union(theirs).repartitionById(blocks, "block").sortWithinPartitions("block", "kind")


def _result(owner, window, best: list[Best]):
    some = [(o, w, b) for o, w, b in zip(owner, window, best) if len(b.score)]
    if not some:
        return None
    sizes = [len(b.score) for _, _, b in some]
    rows = Rows.joined([b.rows for _, _, b in some])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.array([o for o, _, _ in some], np.int64), sizes)),
         pa.array(np.repeat(np.array([w for _, w, _ in some], np.int32), sizes)), pa.array(rows.uid),
         pa.array(rows.ident, mask=rows.absent), pa.array(np.concatenate([b.score for _, _, b in some]))],
        names=["anchor", "window", "uid", "id", "score"])


def _scan(rows: DataFrame, anchors: DataFrame, blocks: int, k: int, zone_rows: int) -> DataFrame:
    """anchor, window, uid, id, score: the best k rows of every anchor (and window, where it has some)."""
    def kernel(batches):
        for zones, part in _streams(batches, zone_rows):
            seeker, vectors = Rows.of(part), _matrix(part.column("v"))
            owner, number, best = [], [], []
            for n, windows in enumerate(part.column("windows").to_pylist()):
                if windows is None:
                    new = [find_positives(zones, seeker.uid[n], seeker.label[n], vectors[n], k)]
                else:
                    new = find_negatives(zones, seeker.label[n], vectors[n], [(w["low"], w["high"]) for w in windows], k)
                owner += [seeker.uid[n]] * len(new)
                number += range(len(new))
                best += new
            result = _result(owner, number, best)
            if result is not None:
                yield result

    found = _by_block(rows, anchors, blocks).mapInArrow(kernel, "anchor long, window int, uid long, id long, score long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         block_rows: int = BLOCK_ROWS, zone_rows: int = ZONE_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (id, label, v).

    A negative's score lies between `low` and `high` percent of the positive's.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    rows = scratch.write(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    n = rows.count()
    blocks = max(1, min(2 * spark.sparkContext.defaultParallelism, n // 1024), -(-n // block_rows))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))
    anchors = rows.where(is_anchor).drop("block")

    no_windows = F.lit(None).cast("array<struct<low: bigint, high: bigint>>")
    near = scratch.write(_scan(rows, anchors.withColumn("windows", no_windows), blocks, positives, zone_rows), "positives")
    score = F.col("score").cast("decimal(20,0)")
    bounds = F.struct(F.ceil(score * low / 100).cast("long").alias("low"), F.floor(score * high / 100).cast("long").alias("high"))
    windows = near.groupBy(F.col("anchor").alias("uid")).agg(
        F.array_sort(F.collect_list(F.struct("rank", bounds.alias("bounds")))).alias("all")).select(
        "uid", F.transform("all", lambda x: x["bounds"]).alias("windows"))
    far = _scan(rows, anchors.join(windows, "uid"), blocks, negatives, zone_rows)
    pairs = near.select("anchor", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"),
                        F.col("score").alias("positive_score"))
    named = anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"))
    return far.select("anchor", "window", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                      F.col("score").alias("negative_score")).join(pairs, ["anchor", "window"]).join(
        named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(embeddings: DataFrame, **options) -> DataFrame:
    """The query's form: labels of ids divisible by 7 move on by one, ids divisible by 50 are anchors."""
    rows = scaled_rows(embeddings).withColumn(
        "label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, F.col("id") % 50 == 0, **options)
