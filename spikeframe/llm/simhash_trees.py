"""SimHash near-duplicates: fingerprints linked by BK-trees, then connected components.

Fingerprints within r bits agree in at least one of r + 1 parts, so all distinct fingerprints are
dealt to shards by the value of each part. Each shard's task holds its BK-tree (children keyed by
their Hamming distance to the parent) and follows, for all members at once, only the edges within
the radius. A shard above `shard_limit` is dealt again by parts of its remaining bits, with the same
guarantee, until the remaining bits allow no more distinct members than the limit; nothing is
capped. A shard gives a spanning star of each of its components, never its pairs.

Shard trees live in the tasks that own them: together they grow with the corpus, so no tree is
broadcast and no fingerprint goes to the driver.

Defined results: null and empty texts have fingerprint zero and link like any other; a null id
never is the smallest id (component_id is null where all ids are null); repeated rows give
repeated results; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

ALL_BITS = (1 << 64) - 1


def fingerprint(text: str | None, width: int, seed: int = 42) -> bytes:
    """Eight bytes, the highest first: a bit is set if over half of the shingle hashes have it."""
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()
    if not words:
        return bytes(8)
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*[words[k:] for k in range(width)])))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        raw = b"".join([xxh64_digest(s, seed) for s in shingles[at:at + (1 << 16)]])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles)).tobytes()


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (64 bits as a long)."""
    def kernel(batches):
        for batch in batches:
            raw = b"".join([fingerprint(t, width) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.frombuffer(raw, ">i8").astype("<i8"))], names=["doc_id", "fp"])

    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(kernel, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def parts(mask: int, radius: int) -> list[int]:
    """Masks that fix, besides `mask`, one of radius + 1 runs of the remaining bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    n = radius + 1
    return [mask | sum(1 << b for b in free[k * len(free) // n:(k + 1) * len(free) // n]) for k in range(n)]


class Tree:
    """BK-tree over distinct fingerprints; a node's children are keyed by distance."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        # all values go down together: those at one distance from a node form its child's subtree
        todo = [(0, np.arange(1, len(values)))]
        while todo:
            node, below = todo.pop()
            away = np.bitwise_count(values[below] ^ values[node])
            for d in np.unique(away):
                own = below[away == d]
                self.children[node][int(d)] = int(own[0])
                if len(own) > 1:
                    todo.append((int(own[0]), own[1:]))

    def matches(self, radius: int):
        """(node, members within the radius), all members searched at once."""
        todo = [(0, np.arange(len(self.values)))]
        while todo:
            node, active = todo.pop()
            away = np.bitwise_count(self.values[active] ^ self.values[node]).astype(np.int16)
            near = active[away <= radius]
            if len(near) > 1:
                yield node, near
            for edge, child in self.children[node].items():
                follow = active[np.abs(away - edge) <= radius]
                if len(follow):
                    todo.append((child, follow))


def spanning_stars(values: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(member, head) of the components of one shard; head is the first member."""
    label = np.arange(len(values))
    for node, near in Tree(values).matches(radius):
        merged = np.unique(np.append(label[near], label[node]))
        if len(merged) > 1:
            to = np.arange(len(values))
            to[merged] = merged[0]
            label = to[label]
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def _shard_links(shards: DataFrame, radius: int) -> DataFrame:
    """u, v of every shard. A shard's rows are neighbours: dealt by key, sorted within the partition."""
    def kernel(batches):
        rest = None

        def links(keys, fps):
            """All shards of a run of whole shards."""
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            starts, stops = np.append(0, new), np.append(new, len(keys))
            us, vs = [], []
            for a, b in zip(starts[stops - starts > 1], stops[stops - starts > 1]):
                u, v = spanning_stars(fps[a:b].view(np.uint64), radius)
                us.append(u.view(np.int64))
                vs.append(v.view(np.int64))
            return np.concatenate(us) if us else fps[:0], np.concatenate(vs) if vs else fps[:0]

        for batch in batches:
            table = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], axis=1)
            table = table if rest is None else np.concatenate([rest, table])
            if not len(table):
                continue
            same = (table[:, :2] == table[-1, :2]).all(axis=1)
            cut = len(table) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = table[cut:]
            if cut:
                u, v = links(table[:cut, :2], np.ascontiguousarray(table[:cut, 2]))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        if rest is not None and len(rest):
            u, v = links(rest[:, :2], np.ascontiguousarray(rest[:, 2]))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    dealt = shards.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return dealt.mapInArrow(kernel, "u long, v long")


def links(distinct: DataFrame, scratch: Scratch, radius: int = 2, shard_limit: int = 4096) -> DataFrame:
    """u, v: links that connect what is within `radius` bits, of distinct fingerprints `fp`."""
    def deal(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
        table = F.create_map(*[x for m, new in masks.items() for x in (
            F.lit(_signed(m)), F.array(*[F.lit(_signed(n)) for n in new]))])
        return rows.select("fp", F.explode(table[F.col("mask")]).alias("mask")).withColumn(
            "value", F.col("fp").bitwiseAND(F.col("mask"))).distinct()

    masks = [0]
    rows = distinct.select("fp", F.lit(0).cast("long").alias("mask"))
    found = []
    while True:
        masks = {m: parts(m, radius) for m in masks}
        level = len(found)
        shards = scratch.write(deal(rows, masks), f"shards{level}")
        masks = sorted({n for new in masks.values() for n in new})
        free = max(64 - m.bit_count() for m in masks)
        sizes = shards.groupBy("mask", "value").count()
        crowded = scratch.write(sizes.where(F.col("count") > shard_limit).select("mask", "value"), f"crowded{level}")
        if (1 << free) <= shard_limit or crowded.isEmpty():
            found.append(_shard_links(shards, radius))
            break
        found.append(_shard_links(shards.join(crowded, ["mask", "value"], "left_anti"), radius))
        rows = shards.join(crowded, ["mask", "value"], "left_semi").select("fp", "mask")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, shard_limit: int = 4096) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id: one row per document."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs, width), "prints")
    distinct = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    joined = scratch.write(links(distinct, scratch, radius, shard_limit), "links")
    roots = scratch.write(components(joined, scratch), "roots")
    linked = scratch.write(distinct.join(roots.withColumnRenamed("node", "fp"), "fp"), "linked")
    least = scratch.write(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = linked.join(least, "root").select("fp", "component_id")
    named = scratch.write(distinct.join(named, "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id")), "named")
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its columns.

    Repeated rows with that id count as one document (of several texts the greatest stays).
    Documents without an id can't be told apart by it and stay, one for each text.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    groups = near_duplicates(docs, width, radius)
    ids = groups.where("doc_id = component_id").select("doc_id").distinct()
    named = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__text"), row).join(ids, "doc_id", "left_semi")
             .groupBy("doc_id").agg(F.max_by("__row", "__text").alias("__row")))
    free = docs.where("doc_id IS NULL").select("text", row).groupBy("text").agg(F.max_by("__row", F.lit(0)).alias("__row"))
    return named.select("__row.*").union(free.select("__row.*"))
