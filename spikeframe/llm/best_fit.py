"""Packing whole documents into few sequences by exact complements.

What packs well depends only on how many pieces there are of each length, and lengths end at the
sequence size: so a histogram of at most `size` numbers is planned on the driver, and the plan, as
long as the histogram and not as the corpus, is what tasks look their pieces up in.

Planning: lengths are taken from the longest down. What a piece leaves open is looked up among the
lengths, the sums of two lengths and the sums of three that are still available; a combination that
fills the gap exactly is used as often as its lengths allow. Pieces without such a combination are
then packed best-fit, the longest that fits first, and after every step the rest of the gap is
looked up among the exact sums again.

A piece finds its place by its rank among all pieces of its length: pieces are range partitioned by
(length, number), so a length that a third of all pieces share is spread over many partitions, and
only the partitions' row counts are broadcast.

Defined results: a null text is empty and has the end id alone; repeated rows (and null ids) are
documents of their own; extra columns don't matter; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tokenizer_file
from .mixture_packing import WordIds


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> WordIds:
    return WordIds(path)


def piece_table(docs: DataFrame, path: str | None = None, size: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: a document is cut only where it is longer than `size`."""
    def kernel(batches):
        own = _encoder(path or tokenizer_file("word_bpe_49k.json"))
        for rows, all_ids, ends in (run for batch in batches for run in own.runs(batch, end_id)):
            owner, start, length, sums = [], [], [], []
            for k, ids in enumerate(np.split(all_ids, ends[:-1])):
                ids = ids.astype("<u4")
                for at in range(0, len(ids), size):
                    part = ids[at:at + size]
                    owner.append(k)
                    start.append(at)
                    length.append(len(part))
                    sums.append(zlib.crc32(part))
            starts = np.array(start, np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(starts // size, pa.int32()),
                 pa.array(starts), pa.array(length, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        kernel, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class SumIndex:
    """Lengths still available, with the sums of two and, by way of these, of three of them."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.copy()
        self.size = len(counts) - 1
        self.pairs = np.zeros(2 * len(counts), np.int64)
        here = np.flatnonzero(self.left)
        for a in here:
            self.pairs[a + here[here > a]] += 1
            self.pairs[2 * a] += self.left[a] > 1

    def take(self, length: int, n: int) -> None:
        before, after = self.left[length], self.left[length] - n
        self.left[length] = after
        if before > 1 >= after:
            self.pairs[2 * length] -= 1
        if after == 0:
            self.pairs[length + np.flatnonzero(self.left)] -= 1

    def exact(self, gap: int, used: dict[int, int]) -> tuple[int, ...] | None:
        """One, two or three lengths that fill `gap` beside those in use; longest first."""
        if gap < 1:
            return None
        if self._has((gap,), used):
            return (gap,)
        return self._two(gap, gap, used) or self._three(gap, used)

    def _has(self, lengths: tuple[int, ...], used: dict[int, int]) -> bool:
        return all(self.left[a] >= used.get(a, 0) + lengths.count(a) for a in set(lengths))

    def _two(self, gap: int, most: int, used: dict[int, int], first: tuple[int, ...] = ()):
        if self.pairs[gap] <= 0:
            return None
        a = np.arange(min(gap - 1, most), (gap - 1) // 2, -1)
        for x in a[(self.left[a] > 0) & (self.left[gap - a] > 0)]:
            found = (*first, int(x), int(gap - x))
            if self._has(found, used):
                return found
        return None

    def _three(self, gap: int, used: dict[int, int]):
        a = np.arange(gap - 2, (gap + 2) // 3 - 1, -1)
        for x in a[(self.left[a] > 0) & (self.pairs[gap - a] > 0)]:
            found = self._two(int(gap - x), int(x), used, (int(x),))
            if found:
                return found
        return None

    def longest(self, gap: int, used: dict[int, int]) -> int | None:
        for x in np.flatnonzero(self.left[:gap + 1])[::-1]:
            if self._has((int(x),), used):
                return int(x)
        return None


def plan_patterns(counts: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """(pieces of each length, number of sequences) of all sequences; counts[k]: pieces of length k."""
    index, size, plan, rest = SumIndex(counts), len(counts) - 1, [], []

    def use(pattern: dict[int, int]) -> None:
        times = min(int(index.left[a]) // n for a, n in pattern.items())
        for a, n in pattern.items():
            index.take(a, n * times)
        plan.append((pattern, times))

    def with_lengths(pattern: dict[int, int], lengths) -> dict[int, int]:
        pattern = dict(pattern)
        for a in lengths:
            pattern[a] = pattern.get(a, 0) + 1
        return pattern

    for length in range(size, 0, -1):
        while index.left[length]:
            exact = index.exact(size - length, {length: 1}) if length < size else ()
            if exact is None:
                break
            use(with_lengths({length: 1}, exact))
    for length in range(size, 0, -1):
        while index.left[length]:
            pattern, gap = {length: 1}, size - length
            while gap:
                more = index.exact(gap, pattern)
                if more is None:
                    best = index.longest(gap, pattern)
                    if best is None:
                        break
                    more = (best,)
                pattern, gap = with_lengths(pattern, more), gap - sum(more)
            use(pattern)
    return plan


def _lookup(counts: np.ndarray, plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """For pieces in order of length: ranges of rank, each with its pattern's sequences and offset."""
    begin = np.append(0, np.cumsum(counts))[:-1]
    done, rows, sequence = begin.copy(), [], 0
    for pattern, times in plan:
        offset = 0
        for length, n in sorted(pattern.items(), reverse=True):
            rows.append((int(done[length]), sequence, offset, n))
            done[length] += n * times
            offset += n * length
        sequence += times
    rows.sort()
    names = ("rank", "sequence", "offset", "per")
    return {name: np.array(values, np.int64) for name, values in zip(names, zip(*rows))}


def pack(docs: DataFrame, path: str | None = None, size: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "best-fit")
    pieces = scratch.write(
        piece_table(docs, path, size, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(size + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `size` rows
        counts[r["length"]] = r["count"]
    if not counts.any():
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32",
                             F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    lookup = _lookup(counts, plan_patterns(counts))

    sorted_ = scratch.write(pieces.repartitionByRange("length", "uid").sortWithinPartitions("length", "uid").withColumn(
        "mid", F.monotonically_increasing_id()), "sorted")
    block = F.shiftright("mid", 33)
    sums = sorted_.groupBy(block.alias("block")).agg(F.count(F.lit(1)).alias("n"))
    sums = sums.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    ranked = sorted_.withColumn("block", block).join(F.broadcast(sums), "block").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("before") + F.col("mid").bitwiseAND((1 << 33) - 1)).alias("rank"))

    def kernel(batches):
        for batch in batches:
            rank, length = (batch.column(k).to_numpy() for k in ("rank", "length"))
            row = np.searchsorted(lookup["rank"], rank, "right") - 1
            nth = rank - lookup["rank"][row]
            per = lookup["per"][row]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(lookup["sequence"][row] + nth // per),
                 pa.array(lookup["offset"][row] + nth % per * length)],
                names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(kernel, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, "
                                     "sequence_id long, offset long")
