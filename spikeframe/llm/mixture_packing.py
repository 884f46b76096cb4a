"""Mixture-controlled packing of token ids into fixed-length sequences.

Each source is a queue whose documents lie end to end. Deficit round-robin with a quantum of some
tokens serves the queues: a queue earns credit in proportion to its share, and its next quantum is
due when its deficit (earned minus served) covers it. Quantum c of a queue with share p is thus due
at (c + 1/2) / p, so the whole service order is a sort by due time: deficits carry over from window
to window and from partition to partition without any state, and every window holds the target
proportions to within one quantum of each source. Shares default to the sources' sizes, with which
all queues end together; only the last sequence is padded.

Steps: tokens are made once and written, each document with the tokens its queue has before it in
its task; totals of tasks and queues give the places in the queues, so documents never move. The
tasks that read the tokens cut the quanta and check-sum them; from then on only quanta are kept,
ordered by range partitions and summed block by block. A window's end cuts no full quantum (where the
quantum divides the size), so only the queues' last, shorter quanta carry their ids for it. No step
gathers a queue; nothing but rows of blocks, or of blocks and queues, meets the rows by broadcast.

Defined results: a null text is empty and has the end id alone; a null source is a queue of its
own; repeated rows (and null ids) are documents of their own; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Recent, Scratch, tokenizer_file

KEPT_WORDS = 250_000
#: Bytes of text whose words are looked up at once, in one pass of Arrow and numpy over all of them.
RUN_BYTES = 8 << 20
#: Unknown parts of words that go through the vocabulary's merges in one line.
PARTS = 64


#: Below this character the vocabulary's own steps (NFC, lower case, split, bytes) are done here,
#: word by word; other words go through the tokenizer as a whole.
LATIN_END = 0x250


class WordIds:
    """Ids of texts by their distinct words, and of these by their distinct parts: no token holds a space or a line end."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # the merges never join two parts, and a part's last id is the one that carries the end of the word
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[k for token, k in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.parts, self.odd = Recent(KEPT_WORDS), Recent(KEPT_WORDS // 10)
        # Fixed value: the vocabulary's split pattern; a space stands before each word.
        self.split = regex.compile(r" |'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in shown]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.bytes = {c: "".join(letter[b] for b in chr(c).encode()) for c in range(33, LATIN_END)}
        self.plain = frozenset(chr(c) for c in range(32, LATIN_END) if chr(c).isprintable() and (
            len(chr(c).lower()) == 1 and ord(chr(c).lower()) < LATIN_END))

    def _whole(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, self.kind).tobytes()

    def _made(self, parts: list[str]) -> list[bytes]:
        """Ids of parts as the split pattern finds them, by the vocabulary's merges alone."""
        made = []
        for k in range(0, len(parts), PARTS):
            line = " ".join(parts[k:k + PARTS]).translate(self.bytes)
            ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, self.kind)
            ends = (self.kind.itemsize * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            ids = ids.tobytes()
            made += [ids[first:end] for first, end in zip([0, *ends], ends)]
        return made

    def _cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number by word, of words cut by the split pattern."""
        found = pa.array(self.split(f" {' '.join(words)}".lower()), pa.large_string()).dictionary_encode()
        made = [b"", *self.parts.many(found.dictionary.to_pylist()[1:], self._made)]  # the first is the space
        part, at = np.frombuffer(b"".join(made), self.kind), found.indices.to_numpy()
        size = np.fromiter(map(len, made), np.int64, len(made)) // self.kind.itemsize
        return _laid(part, size, at), np.add.reduceat(size[at], np.flatnonzero(at == 0))

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each word begin in them and how many they are."""
        line = " ".join(words)
        plain = self.plain.issuperset(line) and "<|" not in line
        letters, mixed, odd = [], [], []
        for k, word in enumerate(words):
            if not plain and ("<|" in word or not self.plain.issuperset(word)):
                odd.append(k)
            else:
                (letters if word.isalpha() else mixed).append(k)
        ids, sizes = [], np.zeros(len(words), np.int64)
        for own, made in ((letters, self.parts.many([words[k].lower() for k in letters], self._made)),
                          (odd, self.odd.all([words[k] for k in odd], self._whole))):
            ids.append(np.frombuffer(b"".join(made), self.kind))
            sizes[own] = np.fromiter(map(len, made), np.int64, len(made)) // self.kind.itemsize
        if mixed:
            cut, sizes[mixed] = self._cut([words[k] for k in mixed])
            ids.append(cut)
        order = np.array(letters + odd + mixed)
        firsts = np.zeros(len(words), np.int64)
        firsts[order] = np.cumsum(sizes[order]) - sizes[order]
        return np.concatenate(ids), firsts, sizes

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty), each followed by `end_id`, and the number of ids up to each text's end."""
        texts = pc.fill_null(texts, "")
        lower = pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring(texts, "<|")))
        texts = pc.if_else(lower, pc.ascii_lower(texts), texts)
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        found, last = words.values.dictionary_encode(), words.offsets.to_numpy()[1:]
        ids, firsts, sizes = self._words(found.dictionary.to_pylist())
        at = np.insert(found.indices.to_numpy(), last, len(sizes))
        ids, firsts, sizes = np.append(ids, self.kind.type(end_id)), np.append(firsts, len(ids)), np.append(sizes, 1)
        return _laid(ids, sizes, at, firsts), np.cumsum(sizes[at])[last + np.arange(len(last))]

    def runs(self, batch: pa.RecordBatch, end_id: int):
        """Rows of the batch, RUN_BYTES of `text` at a time, with what `encode` makes of them."""
        run = np.cumsum(pc.binary_length(pc.fill_null(batch.column("text"), "")).to_numpy().astype(np.int64)) // RUN_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1), len(run)] if len(run) else []
        for first, stop in zip(cuts, cuts[1:]):
            rows = batch.slice(first, stop - first)
            yield rows, *self.encode(rows.column("text"), end_id)


def _laid(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray, firsts: np.ndarray | None = None) -> np.ndarray:
    """The ids of the runs `at`, one after the other; run k is `sizes[k]` ids from `firsts[k]` (else where run k - 1 ends)."""
    firsts = np.cumsum(sizes) - sizes if firsts is None else firsts
    size = sizes[at].astype(np.int32)  # a run's ids are fewer than Arrow's offsets reach
    ends = np.cumsum(size, dtype=np.int32)
    place = np.repeat(firsts[at].astype(np.int32) - (ends - size), size)
    place += np.arange(ends[-1], dtype=np.int32)
    return ids[place]


_ENCODERS: dict[str, WordIds] = {}


def _encoder(path: str) -> WordIds:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]


def token_table(docs: DataFrame, path: str | None = None, end_id: int = 1) -> DataFrame:
    """doc_id, queue, doc_tokens, within, width, ids (little-endian, `width` bytes each), end id included.

    `within` counts the tokens that the queue has before the document in its partition.
    """
    def kernel(batches):
        own = _encoder(path or tokenizer_file("word_bpe_49k.json"))
        seen: dict[str, int] = {}
        for rows, ids, ends in (run for batch in batches for run in own.runs(batch, end_id)):
            lengths, within = np.diff(ends, prepend=0), []
            for queue, n in zip(rows.column("queue").to_pylist(), lengths.tolist()):
                within.append(seen.get(queue, 0))
                seen[queue] = within[-1] + n
            places = np.append(0, ends * own.kind.itemsize).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("queue"), pa.array(lengths, pa.int64()), pa.array(within, pa.int64()),
                 pa.array([own.kind.itemsize] * len(ends), pa.int32()),
                 pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(places), pa.py_buffer(ids)])],
                names=["doc_id", "queue", "doc_tokens", "within", "width", "ids"])

    queue = F.concat(F.lit("s"), F.col("source").cast("string")) if "source" in docs.columns else F.lit(None)
    source = docs.select("doc_id", F.coalesce(queue, F.lit("")).alias("queue"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        kernel, f"doc_id {kind}, queue string, doc_tokens long, within long, width int, ids binary")


def _quanta(tokens: DataFrame, scratch: Scratch, quantum: int, whole: bool) -> DataFrame:
    """Quanta of all queues cut at document borders: uid, doc_id, doc_tokens, queue, c, start, length, ids_crc32, total.

    Short quanta, and all where not `whole`, keep their ids (four bytes each) in `ids`.
    """
    sums = tokens.groupBy("block", "queue").agg(F.sum("doc_tokens").alias("n"))
    by_queue = Window.partitionBy("queue")
    # written, so that the join knows their true size and leaves the tokens where they are
    sums = scratch.write(sums.select(
        "block", "queue",
        (F.sum("n").over(by_queue.orderBy("block")) - F.col("n")).alias("before"),
        F.sum("n").over(by_queue).alias("total")), "sums")
    placed = tokens.join(sums, ["block", "queue"]).select(
        "uid", "doc_id", "doc_tokens", "queue", "total", (F.col("before") + F.col("within")).alias("from"), "width", "ids")

    def kernel(batches):
        for batch in batches:
            n, total, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_tokens", "total", "from"))
            count = (first + n - 1) // quantum - first // quantum + 1
            owner = np.repeat(np.arange(len(n)), count)
            ends = np.cumsum(count)
            c = (first // quantum)[owner] + np.arange(len(owner)) - (ends - count)[owner]
            start = np.maximum(c * quantum - first[owner], 0)
            stop = np.minimum((c + 1) * quantum - first[owner], n[owner])
            carried = (c + 1) * quantum > total[owner] if whole else np.ones(len(c), bool)
            sums, kept, k = np.zeros(len(c), np.int64), [None] * len(c), 0
            for d, (raw, width) in enumerate(zip(batch.column("ids"), batch.column("width").to_pylist())):
                ids = np.frombuffer(raw.as_buffer(), f"<u{width}").astype("<u4")
                for k in range(ends[d] - count[d], ends[d]):
                    piece = ids[start[k]:stop[k]]
                    sums[k] = zlib.crc32(piece)
                    if carried[k]:
                        kept[k] = piece.tobytes()
            own = [batch.column(x).take(pa.array(owner)) for x in ("uid", "doc_id", "doc_tokens", "queue", "total")]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(c), pa.array(start), pa.array(stop - start), pa.array(sums), pa.array(kept, pa.binary())],
                names=["uid", "doc_id", "doc_tokens", "queue", "total", "c", "start", "length", "ids_crc32", "ids"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(kernel, f"uid long, doc_id {kind}, doc_tokens long, queue string, total long, c long, "
                                     "start long, length long, ids_crc32 long, ids binary")


def pack(docs: DataFrame, path: str | None = None, size: int = 2048, quantum: int = 128, end_id: int = 1,
         shares: dict[str, float] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue."""
    scratch = Scratch(docs.sparkSession, "packing")
    tokens = scratch.write(token_table(docs, path, end_id).withColumn("uid", F.monotonically_increasing_id()).withColumn(
        "block", F.spark_partition_id()), "tokens")
    quanta = scratch.write(_quanta(tokens, scratch, quantum, size % quantum == 0), "quanta")
    scratch.delete("tokens")
    share = F.col("total").cast("double")
    for name, weight in (shares or {}).items():
        share = F.when(F.col("queue") == f"s{name}", F.lit(float(weight))).otherwise(share)
    # the queues' last, shorter quanta follow all full ones, so that windows stay whole
    quanta = quanta.withColumn("short", (F.col("c") + 1) * quantum > F.col("total")).withColumn(
        "due", (F.col("c") + 0.5) / share).drop("total")
    order = ["short", "due", "queue", "c", "uid"]
    blocks = scratch.write(
        quanta.repartitionByRange(*order).withColumn("block", F.spark_partition_id()), "blocks")
    scratch.delete("quanta")
    sums = blocks.groupBy("block").agg(F.sum("length").alias("n"))
    sums = sums.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    here = Window.partitionBy("block").orderBy(*order)
    placed = blocks.join(F.broadcast(sums), "block").withColumn(
        "at", F.col("before") + F.sum("length").over(here) - F.col("length"))
    window = placed.withColumn("sequence_id", F.explode(F.sequence(
        F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("length") - 1) / size))))
    skip = F.greatest(F.col("sequence_id") * size - F.col("at"), F.lit(0))
    stop = F.least((F.col("sequence_id") + 1) * size - F.col("at"), F.col("length"))
    part = F.substring("ids", (4 * skip + 1).cast("int"), (4 * (stop - skip)).cast("int"))
    return window.select(
        "doc_id", (F.col("start") + skip).cast("long").alias("start"), (stop - skip).cast("long").alias("length"),
        F.when(F.col("ids").isNull(), F.col("ids_crc32")).otherwise(F.crc32(part)).alias("ids_crc32"), "doc_tokens",
        "sequence_id", (F.col("at") + skip - F.col("sequence_id") * size).cast("long").alias("offset"), "queue")
