"""Near copies for the pipeline: fingerprints find candidates, exact Jaccard similarity decides.

A text is the set of its five-word shingles (ASCII lower case; a shorter text is one shingle). A document
goes when its set has Jaccard similarity `SIMILARITY` or more with that of a kept document with a
smaller id: in order of ids a document stays unless such a document has stayed before it.

1. Fingerprints: SimHash of the set under `SEEDS` independent seeds, together 320 bits. At similarity 0.8
   two of them differ by about 48 bits (deviation 6.4), those of unrelated texts by 160 (9). `FAR` links
   the first and, at 6e-23 a pair, never the second: links are verified by all bits before anything is closed
   over them, so components stay families of similar texts at any number of documents.
2. Shards: the bits, permuted, are cut into runs; each run deals all fingerprints to shards by its value, so
   many that `bucket` share one. Fingerprints that differ in fewer bits than there are runs agree in one of them
   (pigeonhole), so they meet for certain; as many runs are made, from further permutations where one has
   too few, as find a pair that differs in a sixth of its bits with probability `FOUND`. A crowded shard is
   dealt again by runs of its own inside its task. Each shard's task holds its BK-tree over all 320 bits, searched
   within `FAR` for all members at once. A shard gives stars, never its pairs.
3. Components of the links are worked off in rounds: the first documents of each by id, at most `ROWS` and
   `HASHES`, are decided in order by exact similarity; those that stay are sent to salted parts of what is
   left of their component, and what is similar goes. Rounds double their rows until a bound holds, so a
   task holds one block of one component at a time, however large the component is.

Defined results: texts without words are no near copies; documents without an id stay, one for each text;
of rows with one id and several texts the greatest stays; an empty table gives none.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

WIDTH, SEEDS = 5, 5
#: Most differing bits of a link; the probability that the runs find a pair with a sixth of its bits differing.
FAR, FOUND = 72, 0.98
#: Documents of a component decided in the first round and in any round, and their shingles.
FIRST, ROWS, HASHES = 64, 8192, 1 << 21
#: Jaccard similarity as a fraction, so that comparisons are exact.
SIMILARITY = (4, 5)
_FACTORS = np.random.default_rng(20240502).integers(1, 1 << 63, (SEEDS, 2), dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WIDTH:
        found = {b" ".join(words)}
    else:
        found = set(map(b" ".join, zip(*[words[k:] for k in range(WIDTH)])))
    return np.unique(np.frombuffer(b"".join(map(xxh64_digest, found)), ">u8").astype(np.uint64))


def prints_of(hashes: np.ndarray) -> list[int]:
    """A fingerprint under each seed, as signed numbers: a bit is set if over half of the hashes have it.

    At exactly half the smallest hash decides, so that bits of short texts are set half of the time, too.
    """
    out = []
    for a, b in _FACTORS:
        mixed = hashes * a
        mixed = (mixed ^ (mixed >> np.uint64(32))) * b
        mixed ^= mixed >> np.uint64(29)
        ones = np.unpackbits(mixed[:1].view(np.uint8)).astype(np.int64)
        for at in range(0, len(mixed), 1 << 16):
            raw = mixed[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
            ones += 2 * np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones > len(hashes)).view(np.int64)[0]))
    return out


def similar(common, a, b):
    """Whether sets of a and b elements with so many in common reach SIMILARITY; numbers or columns."""
    up, down = SIMILARITY
    return (up + down) * common >= up * (a + b)


def _prints(docs: DataFrame) -> DataFrame:
    """node, fps (one of each seed) of all texts with words."""
    def kernel(batches):
        for batch in batches:
            nodes, fps = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = shingles(text)
                if len(found):
                    nodes.append(node)
                    fps.append(prints_of(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(fps, pa.list_(pa.int64()))], names=["node", "fps"])

    return docs.select(F.xxhash64("doc_id").alias("node"), "text").mapInArrow(kernel, "node long, fps array<long>")


def tables(n: int, bucket: int, level: int = 0) -> np.ndarray:
    """Masks (runs x seeds) of the bits by which n fingerprints are dealt to shards of about `bucket`."""
    bits = max(0, math.ceil(math.log2(max(n, 1) / bucket)))
    count = 1 if not bits else math.ceil(math.log(1 - FOUND) / math.log(1 - (5 / 6) ** bits))
    draw = np.random.default_rng((bits, level, 20240503))
    masks, free = np.zeros((count, SEEDS), np.uint64), np.zeros(0, np.int64)
    for row in masks:
        if len(free) < bits:
            free = draw.permutation(64 * SEEDS)
        for at in free[:bits]:
            row[at // 64] |= np.uint64(1) << np.uint64(at % 64)
        free = free[bits:]
    return masks


def _away(prints: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints (seeds x n) and one of them."""
    return np.bitwise_count(prints ^ one[:, None]).sum(axis=0, dtype=np.int16)


class Tree:
    """BK-tree over fingerprints (seeds x n): a node's children are keyed by their distance to it.

    Nodes are numbered in preorder, so that a subtree is a run of numbers; `places` are theirs in the input.
    What equals a node is no node but linked to it (`equal`).
    """

    def __init__(self, prints: np.ndarray):
        places, members = [], [np.arange(prints.shape[1])]
        self.children, self.equal = [], []
        while members:  # all go down together: those at one distance from a node form its child's subtree
            own = members.pop()
            node, own = own[0], own[1:]
            if len(own):
                away = _away(prints[:, own], prints[:, node])
                if not away.all():
                    self.equal.append((own[away == 0], np.full(np.count_nonzero(away == 0), node)))
                    own, away = own[away > 0], away[away > 0]
            places.append(node)
            children = []
            if len(own):
                by = np.argsort(away, kind="stable")
                own, away = own[by], away[by]
                cuts = [0, *(np.flatnonzero(away[1:] != away[:-1]) + 1).tolist(), len(own)]
                children = [int(away[c]) for c in cuts[:-1]]
                members += [own[a:b] for a, b in zip(cuts[-2::-1], cuts[:0:-1])]
            self.children.append(children)
        self.places = np.array(places)
        self.prints = np.ascontiguousarray(prints[:, self.places])
        self.ends = [0] * len(places)
        for at in range(len(places) - 1, -1, -1):
            end = at + 1
            for _ in self.children[at]:
                end = self.ends[end]
            self.ends[at] = end

    def links(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(member, head) in the input's places of the components within the radius; every later node meets the earlier ones.

        A subtree of one component isn't searched for that component's own members.
        """
        label = np.arange(len(self.places))
        merged = False
        todo = [(0, None, label[1:], None)]
        while todo:
            node, edge, active, away = todo.pop()
            if edge is not None:
                later = int(np.searchsorted(active, node, "right"))
                active = active[later:][np.abs(away[later:] - edge) <= radius]
            if merged and len(active):
                own = label[node:self.ends[node]]
                if (own == own[0]).all():
                    active = active[label[active] != own[0]]
            if not len(active):
                continue
            away = _away(self.prints[:, active], self.prints[:, node])
            near = active[away <= radius]
            if len(near):
                same = np.unique(np.append(label[near], label[node]))
                if len(same) > 1:
                    to = np.arange(len(label))
                    to[same] = same[0]
                    label, merged = to[label], True
            child = node + 1
            for edge in self.children[node]:
                todo.append((child, edge, active, away))
                child = self.ends[child]
        moved = np.flatnonzero(label != np.arange(len(label)))
        found = [(self.places[moved], self.places[label[moved]]), *self.equal]
        return np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found])


def stars(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, head) places of the fingerprints (seeds x n) that links connect, by a BK-tree over them."""
    if prints.shape[1] < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return Tree(prints).links(FAR)


def bucket_links(prints: np.ndarray, crowd: int = 4096, level: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Links inside a bucket, as `stars` gives them; a crowded one is dealt again by runs of its own."""
    n = prints.shape[1]
    if n <= crowd:
        return stars(prints)
    found = []
    for mask in tables(n, crowd // 8, level):
        values = prints & mask[:, None]
        order = np.lexsort(values)
        new = (values[:, order[1:]] != values[:, order[:-1]]).any(axis=0)
        for part in np.split(order, np.flatnonzero(new) + 1):
            if len(part) > 1:  # what hardly shrinks is one family
                links = stars(prints[:, part]) if 2 * len(part) > n else bucket_links(prints[:, part], crowd, level + 1)
                found.append((part[links[0]], part[links[1]]))
    return np.concatenate([u for u, _ in found]), np.concatenate([v for _, v in found])


def _links(distinct: DataFrame, bucket: int) -> DataFrame:
    """u, v: nodes of the distinct fingerprints that links connect."""
    def kernel(batches):
        rest = None

        def give(table):
            cuts = np.flatnonzero(table[0, 1:] != table[0, :-1]) + 1
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for part in np.split(table, cuts, axis=1):
                if part.shape[1] > 1:
                    u, v = bucket_links(np.ascontiguousarray(part[1:-1]).view(np.uint64))
                    us.append(part[-1][u])
                    vs.append(part[-1][v])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

        for batch in batches:
            table = np.stack([column.to_numpy(zero_copy_only=False) for column in batch.columns])
            table = table if rest is None else np.concatenate([rest, table], axis=1)
            cut = int(np.searchsorted(table[0], table[0, -1])) if table.shape[1] else 0
            rest = table[:, cut:]
            if cut:
                yield give(table[:, :cut])
        if rest is not None and rest.shape[1]:
            yield give(rest)

    def signed(n):
        return F.lit(int(np.uint64(n).astype(np.int64)))

    fps = [F.col("fps")[k] for k in range(SEEDS)]
    keys = [F.xxhash64(F.lit(t), *[fp.bitwiseAND(signed(m)) for fp, m in zip(fps, mask)])
            for t, mask in enumerate(tables(distinct.count(), bucket))]
    dealt = distinct.select(F.explode(F.array(*keys)).alias("key"), *[fp.alias(f"f{k}") for k, fp in enumerate(fps)], "node")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(kernel, "u long, v long")


def candidates(docs: DataFrame, scratch: Scratch, bucket: int = 512) -> DataFrame:
    """node, root: components of the documents that may be near copies."""
    prints = scratch.write(_prints(docs), "prints")
    distinct = scratch.write(prints.groupBy("fps").agg(F.min("node").alias("node")), "distinct")
    equal = prints.join(distinct.withColumnRenamed("node", "least"), "fps").where("node <> least").select(
        F.col("node").alias("u"), F.col("least").alias("v"))
    linked = scratch.write(_links(distinct, bucket).union(equal).distinct(), "links")
    return scratch.write(components(linked, scratch), "roots")


class Kept:
    """The kept sets of one block."""

    def __init__(self):
        self.sets: list[np.ndarray] = []
        self.at: dict[int, list[int]] = {}

    @staticmethod
    def least(hashes: np.ndarray) -> list[int]:
        """The smallest hashes: of two similar sets one of these is in both."""
        up, down = SIMILARITY
        return hashes[:len(hashes) - -(-len(hashes) * up // down) + 1].tolist()

    def like(self, hashes: np.ndarray) -> bool:
        """Whether a kept set is similar."""
        up, down = SIMILARITY
        for k in {k for h in self.least(hashes) for k in self.at.get(h, ())}:
            other = self.sets[k]
            a, b = len(hashes), len(other)
            if down * min(a, b) >= up * max(a, b) and similar(
                    len(np.intersect1d(hashes, other, assume_unique=True)), a, b):
                return True
        return False

    def add(self, hashes: np.ndarray) -> None:
        for h in self.least(hashes):
            self.at.setdefault(h, []).append(len(self.sets))
        self.sets.append(hashes)


def _judged(rows: DataFrame) -> DataFrame:
    """doc_id, root, gone, hashes (null where gone) of the rows root, salt, held, doc_id, hashes.

    Rows with `held` true stay; of the others, those with it null are decided in order, those with it
    false are compared with what is held only. One root and salt is one task's.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def kernel(batches):
        own, kept = None, Kept()
        for batch in batches:
            take, gone = [], []
            hashes = batch.column(4)
            for k, (*group, held) in enumerate(zip(*[batch.column(j).to_pylist() for j in range(3)])):
                if group != own:
                    own, kept = group, Kept()
                found = np.sort(hashes[k].values.to_numpy(zero_copy_only=False).view(np.uint64))
                if held:
                    kept.add(found)
                    continue
                take.append(k)
                gone.append(kept.like(found))
                if held is None and not gone[-1]:
                    kept.add(found)
            at = pa.array(take, pa.int64())
            left = pa.array([None if g else k for k, g in zip(take, gone)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(3).take(at), batch.column(0).take(at), pa.array(gone, pa.bool_()), hashes.take(left)],
                names=["doc_id", "root", "gone", "hashes"])

    columns = ["root", "salt", "held", "doc_id", "hashes"]
    dealt = rows.select(*columns).repartition("root", "salt").sortWithinPartitions(
        "root", "salt", F.col("held").desc_nulls_first(), "doc_id")
    return dealt.mapInArrow(kernel, f"doc_id {kind}, root long, gone boolean, hashes array<long>")


def _first(left: DataFrame, rows: int) -> DataFrame:
    """doc_id, root, inside: the first documents of each (large) component, found in salted parts before they meet."""
    part = Window.partitionBy("root", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy("doc_id")
    whole = Window.partitionBy("root").orderBy("doc_id")
    some = left.select("root", "doc_id", F.size("hashes").alias("n")).withColumn(
        "at", F.row_number().over(part)).where(F.col("at") <= rows)
    some = some.withColumn("at", F.row_number().over(whole)).withColumn(
        "total", F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    return some.where((F.col("at") == 1) | (F.col("at") <= rows) & (F.col("total") <= HASHES)).select(
        "root", "doc_id", F.lit(True).alias("inside"))


def rounds(sets: DataFrame, scratch: Scratch, first: int = FIRST) -> DataFrame:
    """doc_id of the documents similar to one of their component that stays before them; sets: root, doc_id, hashes."""
    left, gone, rows, k = sets, [], first, 0
    while True:
        sizes = left.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("hashes")).alias("total"))
        large = scratch.write(sizes.where((F.col("n") > rows) | (F.col("total") > HASHES)).select(
            "root", F.lit(True).alias("large")), f"large{k}")
        # written, so that joins know their true size: the sets move only where what is chosen is much
        some = scratch.write(_first(left.join(large, "root", "left_semi"), rows), f"first{k}")
        marked = scratch.write(left.join(large, "root", "left").join(some, ["root", "doc_id"], "left").withColumn(
            "inside", F.coalesce("inside", F.when(F.col("large").isNull(), F.lit(True)))).drop("large"), f"marked{k}")
        block = marked.where("inside").select("root", F.lit(0).alias("salt"), F.lit(None).cast("boolean").alias("held"),
                                              "doc_id", "hashes")
        block = scratch.write(_judged(block), f"block{k}")
        gone.append(block.where("gone").select("doc_id"))
        rest = marked.where("inside IS NULL")
        sizes = scratch.write(rest.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / (4 * rows)).cast("int").alias("salts")),
                              f"sizes{k}")
        if sizes.isEmpty():
            break
        kept = block.where("NOT gone").join(sizes, "root").select(
            "root", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("held"), "doc_id", "hashes")
        others = rest.join(sizes, "root").select(
            "root", F.pmod(F.xxhash64("doc_id"), "salts").cast("int").alias("salt"), F.lit(False).alias("held"), "doc_id", "hashes")
        tested = scratch.write(_judged(kept.union(others)), f"tested{k}")
        gone.append(tested.where("gone").select("doc_id"))
        left, rows, k = tested.where("NOT gone").select("root", "doc_id", "hashes"), min(2 * rows, ROWS), k + 1
    out = gone[0]
    for some in gone[1:]:
        out = out.union(some)
    return out


def _repeated(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id that several rows have."""
    named = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return scratch.write(named.where("n > 1").select("doc_id"), "repeated")


def _one_each(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """The row with the greatest text of each doc_id; texts of repeated ids only are shuffled for it."""
    columns = [F.col(f"`{c}`") for c in rows.columns]
    many = rows.join(repeated, "doc_id", "left_semi").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("__text"), F.struct(*columns).alias("__row")).groupBy("doc_id").agg(
        F.max_by("__row", "__text").alias("__row"))
    return rows.join(repeated, "doc_id", "left_anti").select(*columns).union(many.select("__row.*"))


def _may_be_linked(docs: DataFrame, roots: DataFrame, scratch: Scratch, most: int = 1 << 26) -> DataFrame:
    """The rows whose `node` may be in `roots`: all that are, and about one in 16 others (more above `most` bits).

    A bitmap of the nodes is sent to the rows, at most 8 MB, so that the join behind it needn't move all texts.
    """
    slots = min(most, max(1 << 15, 1 << (16 * roots.count()).bit_length()))
    slot = F.pmod(F.col("node"), F.lit(slots))
    marks = scratch.write(roots.groupBy(F.bitmap_bucket_number(slot).alias("mark")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")), "marks")
    place = F.bitmap_bit_position(slot)
    own = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = own.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int"))
    return docs.withColumn("mark", F.bitmap_bucket_number(slot)).join(F.broadcast(marks), "mark").where(
        bit != 0).drop("mark", "bits")


def near_copies(docs: DataFrame, scratch: Scratch, repeated: DataFrame, bucket: int = 512) -> DataFrame:
    """doc_id of the documents that go."""
    named = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    roots = candidates(named, scratch, bucket)
    kind = named.schema["doc_id"].dataType.simpleString()

    def kernel(batches):
        for batch in batches:
            found = [shingles(t).view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["root", "doc_id", "hashes"])

    some = _may_be_linked(named.withColumn("node", F.xxhash64("doc_id")), roots, scratch)
    own = some.join(roots, "node").select("root", "doc_id", "text")
    sets = _one_each(own, repeated).mapInArrow(kernel, f"root long, doc_id {kind}, hashes array<long>")
    return rounds(scratch.write(sets.where("size(hashes) > 0"), "sets"), scratch)


def keep_distinct(docs: DataFrame, bucket: int = 512) -> DataFrame:
    """The documents without near copies, with all their columns."""
    scratch, work = (Scratch(docs.sparkSession, name) for name in ("near-copies", "near-copies-work"))
    repeated = _repeated(docs, scratch)
    gone = scratch.write(near_copies(docs, work, repeated, bucket), "gone")
    work.delete()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = _one_each(docs.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").select(*columns), repeated)
    free = docs.where("doc_id IS NULL").select("text", F.struct(*columns).alias("__row")).groupBy("text").agg(
        F.max_by("__row", F.lit(0)).alias("__row"))
    return named.union(free.select("__row.*"))
