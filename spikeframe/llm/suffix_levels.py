"""Repeated byte strings across documents by a logarithmic family of sampled suffix arrays.

A byte goes when a `length`-byte string that covers it also starts in a document with a smaller id.

Sampling: in every `length`-byte string the `gram`-byte piece with the smallest hash is its anchor,
so equal strings have equal anchors at equal places. Consecutive strings share anchors; a run is the
strings of one anchor, and its context the bytes they cover. Only suffixes that start at anchors
are indexed, about one in sixteen.

1. Index family: documents lie in slots; batches of slots bring sorted arrays of their suffixes'
   keys, which are merge-scanned against all existing levels, and levels of equal rank merge. Keys
   found in two documents lead to candidate runs.
2. Candidate runs with equal contexts: all but those of the smallest document are repeated whole.
3. The remaining runs whose key has several contexts compare string by string.

Each step sends, per slot and key range, one sorted array, and gets one bit per entry back, so a
passage in a third of all documents is one entry per slot. Contexts and strings are compared by two
independent 64-bit polynomial hashes over a random byte table; a false hit in step 1 costs work only.

Defined results: null and empty texts have no bytes; a null id ranks below every id; rows with
equal ids never remove each other's bytes; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shared_folder

_TABLE = np.random.default_rng(20240501).integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
NO_ID = -(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of text hashed at a time (or one document); bounds a task's memory, not its results.
CHUNK = 1 << 20
#: Low bits of an anchor's number that hold its position; the others compare hashes.
POSITION_BITS = 24
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a base and of its inverse."""
    if k not in _POWERS or len(_POWERS[k][0]) <= n:
        size = max(n, CHUNK) + 1
        both = []
        for base in (_BASE[k], pow(_BASE[k], -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            both.append(np.cumprod(factors, dtype=np.uint64))
        if size > CHUNK + 1:  # a single long document; not worth keeping
            return both[0], both[1]
        _POWERS[k] = both[0], both[1]
    return _POWERS[k]


class Hashes:
    """Hashes of any stretch of some bytes."""

    def __init__(self, data: np.ndarray):
        self.sums, self.back = [], []
        for k in range(2):
            up, back = _powers(k, len(data))
            self.sums.append(np.append(np.uint64(0), np.cumsum(_TABLE[k][data] * up[:len(data)], dtype=np.uint64)))
            self.back.append(back)

    def of(self, k: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[k][stop] - self.sums[k][start]) * self.back[k][start])


def _runs(hashes: Hashes, starts: np.ndarray, length: int, gram: int):
    """first and last start, document, and key of the runs of documents that begin at `starts`."""
    n = int(starts[-1])
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    at = np.arange(n - gram + 1)
    value = hashes.of(0, at, at + gram)
    low = np.uint64((1 << POSITION_BITS) - 1)
    width, reach = length - gram + 1, 1
    if n <= int(low):
        # hash and position in one number: the smallest is the leftmost piece with the smallest hash
        best = (value & ~low) | at.view(np.uint64)
        while reach < width:
            step = min(reach, width - reach)
            best = np.minimum(best[:-step], best[step:])
            reach += step
        where = (best & low).view(np.int64)
    else:
        best, where = value & ~low, at
        while reach < width:
            step = min(reach, width - reach)
            left = best[:-step] <= best[step:]
            where = np.where(left, where[:-step], where[step:])
            best = np.where(left, best[:-step], best[step:])
            reach += step
    # strings that lie within one document
    size = np.maximum(np.diff(starts) - (length - 1), 0)
    doc = np.repeat(np.arange(len(size)), size)
    if not len(doc):  # the chunk has enough bytes, but none of its documents
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    start = np.arange(len(doc)) + np.repeat(starts[:-1] - np.append(0, np.cumsum(size)[:-1]), size)
    where = where[start]
    heads = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (doc[1:] != doc[:-1]))[:len(start)])
    tails = np.append(heads[1:], len(start)) - 1
    return start[heads], start[tails], doc[heads], value[where[heads]]


class Slot:
    """The documents of one slot, one after the other, with their runs."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.length = length
        self.raw = [(t or "").encode() for t in table.column("text").to_pylist()]
        self.ids = np.array([NO_ID if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
        sizes = np.array([len(r) for r in self.raw], np.int64)
        self.starts = np.append(0, np.cumsum(sizes))
        self.chunks, at = [], 0
        for d in range(1, len(sizes) + 1):
            if d == len(sizes) or self.starts[d + 1] - self.starts[at] > CHUNK:
                self.chunks.append((at, d))
                at = d
        parts = []
        for low, high in self.chunks:
            hashes, base = self._hashes(low, high), self.starts[low]
            first, last, doc, key = _runs(hashes, self.starts[low:high + 1] - base, length, gram)
            context = [hashes.of(k, first, last + length) for k in range(2)]
            parts.append((first + base, last + base, doc + low, key, *context))
        self.first, self.last, self.doc, self.key, *self.context = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(self.key)
        new = np.append(True, self.key[order][1:] != self.key[order][:-1])[:len(order)]
        heads = np.flatnonzero(new)
        self.rank = np.empty(len(order), np.int64)  # place of each run's key among the distinct keys
        self.rank[order] = np.cumsum(new) - 1
        self.keys = self.key[order][heads]
        doc = self.doc[order]
        self.own_shared = (np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)) if len(doc) else new

    def _hashes(self, low: int, high: int) -> Hashes:
        return Hashes(np.frombuffer(b"".join(self.raw[low:high]), np.uint8))

    # --- what a slot asks, and what the answers tell it; entries are always in sorted order ---

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Runs whose key two documents have, here or (`shared`, for each of keys) anywhere."""
        return np.flatnonzero((shared | self.own_shared)[self.rank])

    def contexts(self, runs: np.ndarray) -> list[np.ndarray]:
        """Hashes of the bytes that the runs' strings cover."""
        return [c[runs] for c in self.context]

    def strings(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Starts, documents and hashes of all strings of the runs."""
        parts = []
        for low, high in self.chunks:
            own = runs[(self.doc[runs] >= low) & (self.doc[runs] < high)]
            if not len(own):
                continue
            hashes, base = self._hashes(low, high), self.starts[low]
            count = self.last[own] - self.first[own] + 1
            start = np.repeat(self.first[own] - base - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
            parts.append((start + base, np.repeat(self.doc[own], count),
                          *(hashes.of(k, start, start + self.length) for k in range(2))))
        if not parts:
            return self.first[:0], self.doc[:0], [self.key[:0], self.key[:0]]
        start, doc, *both = (np.concatenate(x) for x in zip(*parts))
        return start, doc, both


def _least(hashes: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hash pairs with their smallest id, sorted, as rows (h1, h2, id); and each entry's row."""
    if not len(ids):
        return np.zeros((0, 3), np.uint64), np.zeros(0, np.int64)
    order = np.argsort(hashes[0])
    a, b = hashes[0][order], hashes[1][order]
    new = a[1:] != a[:-1]
    if (b[1:] != b[:-1])[~new].any():  # equal first hashes of different strings
        order = np.lexsort((hashes[1], hashes[0]))
        a, b = hashes[0][order], hashes[1][order]
        new = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    new = np.append(True, new)
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(ids[order], heads)
    own = np.empty(len(a), np.int64)
    own[order] = np.cumsum(new) - 1
    return np.stack([a[heads], b[heads], least.view(np.uint64)], axis=1), own


def _spread(kind: int, slot: int, high: np.ndarray, rows: np.ndarray, bits: int):
    """One message per range of the leading bits; `rows` are sorted by `high`."""
    part = (high >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(high), np.int64)
    edges = np.append(0, np.flatnonzero(part[1:] != part[:-1]) + 1) if len(part) else part
    stops = np.append(edges[1:], len(part)) if len(part) else part
    return [(kind, slot, int(part[a]), np.ascontiguousarray(rows[a:b]).tobytes()) for a, b in zip(edges, stops)]


def _distinct(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.append(True, ordered[1:] != ordered[:-1])[:len(ordered)]]


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values occur in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


MESSAGE = pa.schema([("kind", pa.int32()), ("slot", pa.int32()), ("part", pa.int64()), ("body", pa.binary())])


def _table(rows) -> pa.Table:
    return pa.Table.from_arrays(
        [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(MESSAGE)], schema=MESSAGE)


MESSAGES = "kind int, slot int, part long, body binary"
KEY, CONTEXT, VARIETY, STRING = range(4)


def _answers(right: pa.Table, kind: int) -> np.ndarray:
    """The bits of one kind in the order of what was asked."""
    rows = sorted((r["part"], r["body"]) for r in right.to_pylist() if r["kind"] == kind)
    return np.frombuffer(b"".join([b for _, b in rows]), np.uint8).astype(bool)


class SuffixLevels:
    """The index family over the slots' messages of kind KEY, part by part; levels are written tables."""

    def __init__(self, scratch: Scratch):
        self.scratch, self.batches, self.found = scratch, 0, []
        self.levels: DataFrame | None = None

    @staticmethod
    def _scan(new_rows, levels, shared_kind: int):
        """Keys of a new batch that occur twice in it or in a level; and the levels after it."""
        arrays = [_distinct(np.frombuffer(r["body"], np.uint32)) for r in new_rows]
        held = {r["slot"]: np.frombuffer(r["body"], np.uint32) for r in levels}
        if not arrays:
            return np.zeros(0, np.uint32), held
        both = np.sort(np.concatenate(arrays))
        hits = [both[1:][both[1:] == both[:-1]]]
        both = _distinct(both)
        hits += [both[_member(both, x)] for x in held.values()]
        rank = 0
        while rank in held:
            both = _distinct(np.sort(np.concatenate([both, held.pop(rank)])))
            rank += 1
        held[rank] = both
        return _distinct(np.sort(np.concatenate(hits))), held

    def add(self, batch: DataFrame) -> None:
        """Merge-scan a batch (messages of kind KEY) against the levels, then let it join them."""
        scan = self._scan

        def step(key, left, right):
            part = key[0].as_py()
            shared, held = scan(left.to_pylist(), right.to_pylist(), KEY)
            return _table([(1, -1, part, shared.tobytes())] + [(0, r, part, x.tobytes()) for r, x in held.items()])

        old = self.levels
        if old is None:
            old = batch.limit(0)
        state = batch.groupBy("part").cogroup(old.groupBy("part")).applyInArrow(step, MESSAGES)
        self.batches += 1
        state = self.scratch.write(state, f"levels{self.batches}")
        self.levels = state.where("kind = 0")
        self.found.append(self.scratch.write(state.where("kind = 1 AND length(body) > 0"), f"shared{self.batches}"))
        if self.batches > 1:
            self.scratch.delete(f"levels{self.batches - 1}")

    def shared(self) -> DataFrame:
        out = self.found[0]
        for more in self.found[1:]:
            out = out.union(more)
        return out


def _answer_keys(asked: DataFrame, shared: DataFrame) -> DataFrame:
    def step(key, left, right):
        hits = [np.frombuffer(r["body"], np.uint32) for r in right.to_pylist()]
        hits = _distinct(np.sort(np.concatenate([*hits, np.zeros(0, np.uint32)])))
        return _table([(KEY, r["slot"], r["part"], _member(np.frombuffer(r["body"], np.uint32), hits).tobytes())
                       for r in left.to_pylist()])

    return asked.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(step, MESSAGES)


def _answer_rest(asked: DataFrame) -> DataFrame:
    """CONTEXT and STRING: does a smaller id have the entry; VARIETY: has the key several contexts."""
    def step(key, table):
        rows = table.to_pylist()
        bodies = [np.frombuffer(r["body"], np.uint64).reshape(-1, 3) for r in rows]
        whole = np.concatenate(bodies)
        if rows[0]["kind"] == VARIETY:
            order = np.argsort(whole[:, 0], kind="stable")
            heads = np.flatnonzero(np.append(True, whole[order][1:, 0] != whole[order][:-1, 0]))
            low = np.minimum.reduceat(whole[order, 1], heads)
            high = np.maximum.reduceat(whole[order, 2], heads)
            group = np.empty(len(whole), np.int64)
            group[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(whole))))
            answer = (low != high)[group]
        else:
            ids = np.ascontiguousarray(whole[:, 2]).view(np.int64)
            least, own = _least([whole[:, 0], whole[:, 1]], ids)
            answer = np.ascontiguousarray(least[:, 2]).view(np.int64)[own] < ids
        out, at = [], 0
        for r, body in zip(rows, bodies):
            out.append((r["kind"], r["slot"], r["part"], answer[at:at + len(body)].tobytes()))
            at += len(body)
        return _table(out)

    return asked.groupBy("kind", "part").applyInArrow(step, MESSAGES)


class Work:
    """The kernels of a slot; every step works the runs out again from the text."""

    def __init__(self, length: int, gram: int, bits: int):
        self.length, self.gram, self.bits = length, gram, bits

    def ask_keys(self, key, table):
        keys = Slot(table, self.length, self.gram).keys
        low = (keys >> np.uint64(32 - self.bits)).astype(np.uint32)
        return _table(_spread(KEY, key[0].as_py(), keys, low, self.bits))

    def ask_contexts(self, key, left, right):
        slot = Slot(left, self.length, self.gram)
        runs = slot.candidates(_answers(right, KEY))
        hashes = slot.contexts(runs)
        rows, _ = _least(hashes, slot.ids[slot.doc[runs]])
        order = np.argsort(slot.key[runs], kind="stable")
        own, first = slot.key[runs][order], hashes[0][order]
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))[:len(own)]
        variety = np.stack([own[heads], np.minimum.reduceat(first, heads), np.maximum.reduceat(first, heads)], axis=1) \
            if len(own) else np.zeros((0, 3), np.uint64)
        name = key[0].as_py()
        return _table(_spread(CONTEXT, name, rows[:, 0], rows, self.bits)
                      + _spread(VARIETY, name, variety[:, 0], variety, self.bits))

    def _open(self, slot: Slot, right: pa.Table):
        """Runs repeated whole, and runs to be compared string by string."""
        runs = slot.candidates(_answers(right, KEY))
        rows, own = _least(slot.contexts(runs), slot.ids[slot.doc[runs]])
        least = np.ascontiguousarray(rows[:, 2]).view(np.int64)
        repeated = _answers(right, CONTEXT)[own] | (slot.ids[slot.doc[runs]] > least[own])
        asked = np.zeros(len(slot.keys), bool)
        asked[slot.rank[runs]] = True
        several = _answers(right, VARIETY)[(np.cumsum(asked) - 1)[slot.rank[runs]]] if len(runs) else repeated
        return runs[repeated], runs[~repeated & several]

    def ask_strings(self, key, left, right):
        slot = Slot(left, self.length, self.gram)
        _, runs = self._open(slot, right)
        _, doc, hashes = slot.strings(runs)
        rows, _ = _least(hashes, slot.ids[doc])
        return _table(_spread(STRING, key[0].as_py(), rows[:, 0], rows, self.bits))

    def spans(self, left: pa.Table, right: pa.Table) -> tuple[Slot, np.ndarray, np.ndarray]:
        """Starts and stops of the maximal removed stretches, over the slot's bytes."""
        slot = Slot(left, self.length, self.gram)
        whole, runs = self._open(slot, right)
        start, doc, hashes = slot.strings(runs)
        rows, own = _least(hashes, slot.ids[doc])
        least = np.ascontiguousarray(rows[:, 2]).view(np.int64)
        hit = start[_answers(right, STRING)[own] | (slot.ids[doc] > least[own])] if len(own) else start
        begin = np.concatenate([slot.first[whole], hit])
        end = np.concatenate([slot.last[whole], hit]) + self.length
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], np.maximum.accumulate(end[order]) if len(order) else end
        new = np.append(True, begin[1:] > end[:-1])[:len(begin)]
        return slot, begin[new], end[np.append(np.flatnonzero(new)[1:], len(end)) - 1] if len(end) else end

    def cut(self, key, left, right):
        slot, starts, stops = self.spans(left, right)
        out = []
        for d, raw in enumerate(slot.raw):
            a, b = slot.starts[d], slot.starts[d + 1]
            k = np.searchsorted(stops, a, side="right")
            pieces, spans, at = [], [], a
            while k < len(starts) and starts[k] < b:
                s, e = max(starts[k], a), min(stops[k], b)
                pieces.append(raw[at - a:s - a])
                spans.append({"start": int(s - a), "stop": int(e - a)})
                at, k = e, k + 1
            pieces.append(raw[at - a:])
            out.append((len(raw), spans, hashlib.sha256(b"".join(pieces)).hexdigest()))
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.Table.from_arrays(
            [left.column("doc_id").cast(pa.int64()), pa.array([o[0] for o in out], pa.int64()),
             pa.array([o[1] for o in out], span), pa.array([o[2] for o in out], pa.string())],
            names=["doc_id", "n_bytes", "spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = 50, gram: int = 20, slot_bytes: int = 8 << 20,
                   batches: int = 4) -> DataFrame:
    """doc_id, n_bytes, spans (removed stretches in bytes), kept_sha256: one row per document."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-levels")
    shared_folder(spark)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = max(8, math.ceil(total / slot_bytes))
    bits = max(3, math.ceil(math.log2(slots)))
    name = f"suffix_slots_{uuid.uuid4().hex}"
    dealt = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int").alias("slot"))
    # bucketed by slot: all later steps meet the texts without moving them again
    dealt.repartition(slots, "slot").write.bucketBy(slots, "slot").option("compression", "zstd").format(
        "parquet").saveAsTable(name)
    try:
        return _spans_of(spark.table(name), scratch, Work(length, gram, bits), slots, batches)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _spans_of(texts: DataFrame, scratch: Scratch, work: Work, slots: int, batches: int) -> DataFrame:
    """The steps over the bucketed texts; the result is a written table."""
    asked = scratch.write(texts.groupBy("slot").applyInArrow(lambda key, table: work.ask_keys(key, table), MESSAGES), "keys")
    index = SuffixLevels(scratch)
    for b in range(batches):
        index.add(asked.where((F.col("slot") >= b * slots // batches) & (F.col("slot") < (b + 1) * slots // batches)))
    answers = scratch.write(_answer_keys(asked, index.shared()), "key-answers")
    scratch.delete("keys")
    scratch.delete(f"levels{batches}")

    def together(step, schema):
        return texts.groupBy("slot").cogroup(answers.groupBy("slot")).applyInArrow(
            lambda key, left, right: step(key, left, right), schema)

    answers = answers.union(scratch.write(_answer_rest(together(work.ask_contexts, MESSAGES)), "context-answers"))
    answers = answers.union(scratch.write(_answer_rest(together(work.ask_strings, MESSAGES)), "string-answers"))
    kind = "doc_id long, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept_sha256 string"
    return scratch.write(together(work.cut, kind), "result")


def digests(spans: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return spans.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        "kept_sha256")
