"""Phrase collocations per language: two to four words that occur together more than their parts do.

Texts are cut into chunks of one language, each with its own dictionary of words (one Python pass);
word counts are summed over the chunks' dictionaries, and only words that are frequent in their
language keep a number. From then on a chunk is an array of numbers, a gap where a piece ends or a
rarer word stands.

Level by level, phrases of one word more are found: a phrase can be frequent only if the phrase
without its last word is, if its last word is (the scan tests both), and if the phrase without its
first word is (a semi join tests that). Such candidates, observed in the text and at the threshold by their summed chunk counts, go
into double-array tries; a trie is broadcast, all positions of a chunk advance through it together,
one word at a time, and the states that accept are counted with `bincount`. The same pass gathers
the next level's candidates. Counts are summed over chunks and tries.

A trie holds at most `trie_phrases` phrases, so what is broadcast is bounded whatever the corpus:
phrases are dealt to tries by their first two words, and each trie is a scan of its own, one after
another, whose sums are written and united. No step gathers a word, a language or a document's neighbours in one
task: chunks have a bounded length (or are one document), and sums are made before they are shuffled.

Defined results: a null text is empty; a null language is `und`; repeated rows (and rows without an
id) are documents of their own; extra columns don't matter; an empty table gives no phrases.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

LONGEST = 4
#: Text bytes of a chunk, unless one document is longer.
CHUNK_BYTES = 2 << 20
#: Phrases of one broadcast trie.
TRIE_PHRASES = 500_000
#: Columns of a phrase's word numbers.
WORDS = [f"g{k}" for k in range(1, LONGEST + 1)]

_BREAK, _SPACE = 2, 1
_CLASS = np.zeros(256, np.int8)
_CLASS[list(b" \t")] = _SPACE
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def chunk_words(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, their counts, and the words' places in order; -1 where a piece ends."""
    raw = _LOWER[np.frombuffer("\n".join(texts).encode(), np.uint8)]
    kind = _CLASS[raw]
    inside = kind == 0
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    ends = np.append(0, np.cumsum(stop - start)).astype(np.int64)
    data = raw[inside]
    words = pa.Array.from_buffers(
        pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
    places = words.indices.to_numpy().astype(np.int32)
    piece = np.cumsum(kind == _BREAK)[start]
    at = np.arange(len(places)) + np.cumsum(np.diff(piece, prepend=piece[:1]) > 0)
    order = np.full(int(at[-1]) + 1 if len(at) else 0, -1, np.int32)
    order[at] = places
    return words.dictionary.cast(pa.string()), np.bincount(places, minlength=len(words.dictionary)), order


def text_chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """lang, words, counts, places of every chunk of texts of one language."""
    def kernel(batches):
        def row(lang, texts):
            words, counts, order = chunk_words(texts)
            return pa.RecordBatch.from_arrays([
                pa.array([lang]), pa.ListArray.from_arrays([0, len(words)], words),
                pa.ListArray.from_arrays([0, len(words)], pa.array(counts, pa.int64())),
                pa.array([order.tobytes()], pa.binary())], names=["lang", "words", "counts", "places"])

        waiting, sizes = {}, {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                waiting.setdefault(lang, []).append(text)
                sizes[lang] = sizes.get(lang, 0) + len(text)
                full = [lang] if sizes[lang] >= chunk_bytes else []
                if sum(sizes.values()) >= 8 * chunk_bytes:  # many languages
                    full = list(waiting)
                for done in full:
                    sizes.pop(done)
                    yield row(done, waiting.pop(done))
        for lang, texts in waiting.items():
            yield row(lang, texts)

    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where(
        "text <> ''")
    return texts.mapInArrow(kernel, "lang string, words array<string>, counts array<long>, places binary")


def _numbered(chunks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """chunk, numbers (of the chunk's frequent words), places (into numbers; -1: a gap)."""
    entries = chunks.select("chunk", "lang", F.posexplode("words").alias("place", "word"))
    known = entries.join(vocabulary.select("lang", "word", "number"), ["lang", "word"]).groupBy("chunk").agg(
        F.collect_list(F.struct("place", "number")).alias("known"))

    def kernel(batches):
        for batch in batches:
            out = []
            for chunk, known, places in zip(*(batch.column(k) for k in ("chunk", "known", "places"))):
                own, order = known.values, np.frombuffer(places.as_buffer(), np.int32)
                slots = own.field("place").to_numpy(zero_copy_only=False)
                to = np.full(max(int(order.max(initial=-1)), int(slots.max(initial=-1))) + 2, -1, np.int32)
                to[slots] = np.arange(len(slots))
                out.append((chunk.as_py(), own.field("number").to_numpy(zero_copy_only=False).tobytes(),
                            to[order].tobytes()))
            ids, numbers, order = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(numbers, pa.binary()), pa.array(order, pa.binary())],
                names=["chunk", "numbers", "places"])

    return chunks.select("chunk", "places").join(known, "chunk").select("chunk", "known", "places").mapInArrow(
        kernel, "chunk long, numbers binary, places binary")


class DoubleArray:
    """Trie of equally long phrases: the child of state s by digit c is s' = base[s] + c if check[s'] == s.

    A word is two digits of its number among the trie's words, so that no state has very many children.
    """

    def __init__(self, phrases: np.ndarray):
        self.words, spelled = np.unique(phrases, return_inverse=True)
        self.depth = phrases.shape[1]
        self.digits = int(len(self.words) ** 0.5) + 1
        spelled = spelled.reshape(phrases.shape)
        codes = np.stack([spelled // self.digits, spelled % self.digits], axis=2).reshape(len(phrases), -1)
        # the root is node 0; each level's distinct prefixes follow
        parent, digit, node, count = [], [], np.zeros(len(phrases), np.int64), 1
        for k in range(codes.shape[1]):
            edges, node = np.unique(node * self.digits + codes[:, k], return_inverse=True)
            parent.append(edges // self.digits)
            digit.append(edges % self.digits)
            node = node.reshape(-1) + count
            count += len(edges)
        parent, digit = np.concatenate(parent), np.concatenate(digit)
        offset, slots = self._offsets(parent, digit, count)
        self.root = slots  # the root's state lies behind all slots
        slot = np.append(self.root, offset[parent] + digit)
        self.base = np.zeros(slots + 1, np.int32)
        self.base[slot] = offset
        self.check = np.full(slots + 1, -1, np.int32)
        self.check[slot[1:]] = slot[parent]
        #: Row of `phrases` by accepting state.
        self.row = np.full(slots + 1, -1, np.int32)
        self.row[slot[node]] = np.arange(len(phrases))
        self.phrases = phrases

    def _offsets(self, parent: np.ndarray, digit: np.ndarray, count: int) -> tuple[np.ndarray, int]:
        """An offset for every node such that no two children share a slot, and the number of slots.

        Nodes with most children go first. Each round proposes a random offset to all nodes of a
        class at once and keeps those that collide with nothing.
        """
        random = np.random.default_rng(1)
        children = np.bincount(parent, minlength=count)
        offset = np.zeros(count, np.int64)
        taken = np.zeros(2 * count + 4 * self.digits, bool)
        low = int(children.max())
        while low:
            high, low = low, low // 2
            waiting = (children > low) & (children <= high)
            edges, tried = np.flatnonzero(waiting[parent]), 0
            while len(edges):
                offset[waiting] = random.integers(0, len(taken) - self.digits, int(waiting.sum()))
                slots = offset[parent[edges]] + digit[edges]
                bad = np.ones(len(edges), bool)
                bad[np.unique(slots, return_index=True)[1]] = False
                bad |= taken[slots]
                failed = np.zeros(count, bool)
                failed[parent[edges[bad]]] = True
                taken[slots[~failed[parent[edges]]]] = True
                waiting &= failed
                edges, tried = edges[waiting[parent[edges]]], tried + 1
                if tried % 32 == 0:  # too full for this class: more room
                    taken = np.append(taken, np.zeros(len(taken) // 2, bool))
        return offset, len(taken)

    def advance(self, numbers: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a phrase begins, and the accepting states there."""
        at = np.minimum(np.searchsorted(self.words, numbers), len(self.words) - 1)
        spelled = np.append(np.where(self.words[at] == numbers, at, -1), -1)[places]
        position = np.flatnonzero(spelled[:max(len(spelled) - self.depth + 1, 0)] >= 0)
        state = np.full(len(position), self.root, np.int32)
        for k in range(self.depth):
            word = spelled[position + k]
            position, state, word = (x[word >= 0] for x in (position, state, word))
            for high in (True, False):
                child = self.base[state] + (word // self.digits if high else word % self.digits)
                fits = self.check[child] == state
                position, state, word = position[fits], child[fits], word[fits]
        return position, state


#: A phrase or its first words (p), the word that follows (g; none: p's own occurrences), and how often.
_SCHEMA = "p long, g long, n long"


def _rows(p: np.ndarray, g: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(p), pa.nulls(len(n), pa.int64()) if g is None else pa.array(g), pa.array(n.astype(np.int64))],
        names=["p", "g", "n"])


def _arrays(batch: pa.RecordBatch):
    for numbers, places in zip(batch.column("numbers"), batch.column("places")):
        yield np.frombuffer(numbers.as_buffer(), np.int64), np.frombuffer(places.as_buffer(), np.int32)


def _followed(first: np.ndarray, places: np.ndarray, position: np.ndarray, width: int):
    """Distinct (first, next word's place) where a frequent word follows `width` words, with counts."""
    position, first = position[position + width < len(places)], first[position + width < len(places)]
    word = places[position + width].astype(np.int64)
    keys, n = np.unique(first[word >= 0].astype(np.int64) << 32 | word[word >= 0], return_counts=True)
    return keys >> 32, keys & 0xffffffff, n


def _pairs(chunks: DataFrame) -> DataFrame:
    def kernel(batches):
        for batch in batches:
            for numbers, places in _arrays(batch):
                position = np.flatnonzero(places >= 0)
                a, b, n = _followed(places[position], places, position, 1)
                yield _rows(numbers[a], numbers[b], n)

    return chunks.select("numbers", "places").mapInArrow(kernel, _SCHEMA)


def _scan(chunks: DataFrame, shared) -> DataFrame:
    """Occurrences of the phrases of one broadcast trie, by their numbers, and their extensions by a frequent word."""

    def kernel(batches):
        trie, names = shared.value
        total = np.zeros(trie.root + 1, np.int64)
        for batch in batches:
            for numbers, places in _arrays(batch):
                position, state = trie.advance(numbers, places)
                total += np.bincount(state, minlength=len(total))
                if trie.depth < LONGEST:
                    row, word, n = _followed(trie.row[state], places, position, trie.depth)
                    yield _rows(names[row], numbers[word], n)
        found = np.flatnonzero(total)
        yield _rows(names[trie.row[found]], None, total[found])

    return chunks.select("numbers", "places").mapInArrow(kernel, _SCHEMA)


def _summed(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("p", "g").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def phrase_counts(docs: DataFrame, least: int = 30, chunk_bytes: int = CHUNK_BYTES,
                  trie_phrases: int = TRIE_PHRASES, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, word, number, n, total) of frequent words and (g, n) of frequent phrases, words included."""
    scratch = scratch or Scratch(docs.sparkSession, "collocations")
    chunks = scratch.write(text_chunks(docs, chunk_bytes).withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    entry = F.explode(F.arrays_zip("words", "counts")).alias("e")
    counted = scratch.write(chunks.select("lang", entry).groupBy("lang", F.col("e.words").alias("word")).agg(
        F.sum("e.counts").alias("n")), "words")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    vocabulary = scratch.write(counted.where(F.col("n") >= least).join(totals, "lang").withColumn(
        "number", F.monotonically_increasing_id()), "vocabulary")
    numbered = scratch.write(_numbered(chunks, vocabulary), "numbered")

    found = [vocabulary.select(F.array("number").alias("g"), "n")]
    number = F.monotonically_increasing_id().alias("p")
    candidates = scratch.write(_summed(_pairs(numbered), least).select(
        number, F.col("p").alias("g1"), F.col("g").alias("g2")), "candidates2")
    for depth in range(2, LONGEST + 1):
        here = WORDS[:depth]
        tries = -(-candidates.count() // trie_phrases)
        dealt = candidates.withColumn("trie", F.pmod(F.xxhash64("g1", "g2"), F.lit(max(tries, 1))))
        level = []
        for k in range(tries):  # one trie at a time: its sums are whole, as no other trie has its phrases
            phrases = dealt.where(F.col("trie") == k).select("p", *here).toArrow()
            if phrases.num_rows:
                names, *words = (c.to_numpy() for c in phrases.columns)
                shared = docs.sparkSession.sparkContext.broadcast((DoubleArray(np.stack(words, axis=1)), names))
                level.append(scratch.write(_summed(_scan(numbered, shared), least), f"level{depth}-{k}"))
                shared.unpersist()
        if not level:
            break
        rows = level[0]
        for more in level[1:]:
            rows = rows.union(more)
        rows = rows.join(candidates, "p")
        exact = rows.where("g IS NULL")
        found.append(exact.select(F.array(*here).alias("g"), "n"))
        if depth < LONGEST:
            tail = exact.select(*[F.col(w).alias(v) for w, v in zip(here, WORDS[1:])])
            longer = rows.where("g IS NOT NULL").select(*here, F.col("g").alias(WORDS[depth]))
            candidates = scratch.write(longer.join(tail, WORDS[1:depth + 1], "left_semi").select(
                number, *WORDS[:depth + 1]), f"candidates{depth + 1}")
    counts = found[0]
    for more in found[1:]:
        counts = counts.union(more)
    return vocabulary, counts


def collocations(docs: DataFrame, least: int = 30, best: int = 2000, covered: int = 80, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's `best` phrases."""
    scratch = Scratch(docs.sparkSession, "collocations")
    vocabulary, counts = phrase_counts(docs, least, scratch=scratch, **options)
    counts = scratch.write(counts, "counts")
    size = F.size("g")
    phrases = counts.where(size > 1)

    inner = phrases.where(size > 2).select(F.col("n").alias("above"), F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1), lambda m: F.transform(
            F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("g", i, m))))).alias("g"))
    above = inner.groupBy("g").agg(F.max("above").alias("above"))
    kept = phrases.join(above, "g", "left").where(
        F.coalesce(F.lit(100).cast("decimal(20,0)") * F.col("above") < F.lit(covered).cast("decimal(20,0)") * F.col("n"),
                   F.lit(True)))

    cuts = kept.select("g", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "g", "n", "k", F.slice("g", F.lit(1), F.col("k")).alias("head"),
        F.slice("g", F.col("k") + 1, size - F.col("k")).alias("rest"))
    left = counts.select(F.col("g").alias("head"), F.col("n").alias("l"))
    right = counts.select(F.col("g").alias("rest"), F.col("n").alias("r"))
    score = F.expr("(cast(2000000 as decimal(18,0)) * a) div (cast(l as decimal(20,0)) + r)")
    scored = cuts.withColumnRenamed("n", "a").join(left, "head").join(right, "rest").groupBy("g", "a").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    spelled = scored.select("g", F.posexplode("g").alias("at", "number")).join(
        vocabulary.select("number", "word", "lang", "total"), "number").groupBy("g").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"),
        F.first("lang").alias("lang"), F.first("total").alias("n"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = scored.join(spelled, "g").select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", F.pmod(F.xxhash64("g"), F.lit(64)).alias("part"))
    # the best of each part of a language first: a language's last sort has a bounded number of rows
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(
        F.col("rank") <= best)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(
        F.col("rank") <= best).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
