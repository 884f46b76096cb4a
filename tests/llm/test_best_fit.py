"""Packing by exact complements: every id once, whole documents, few sequences."""

import collections
import functools
import random
import zlib

import numpy as np

from spikeframe.llm import best_fit
from spikeframe.llm.common import tokenizer_file


@functools.lru_cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))


@functools.lru_cache(maxsize=None)
def token_ids(text):
    return np.array(tokenizer().encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def check(rows, texts, size=2048):
    """Pieces are the documents' cuts; sequences are full of them without gaps."""
    want = collections.Counter()
    for doc_id, text in texts:
        ids = token_ids(text)
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at:at + size]
            want[doc_id, k, at, len(part), zlib.crc32(part)] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(by_sequence)


def test_documents_and_odd_rows(documents, odd):
    for df in (documents.limit(150), odd):
        texts = [(r.doc_id, r.text) for r in df.collect()]
        n = check(best_fit.pack(df).collect(), texts)
        assert n <= 1.05 * sum(len(token_ids(t)) for _, t in texts) / 2048 + 1
    assert best_fit.pack(odd.limit(0)).count() == 0


def test_small_sequences(spark):
    rnd = random.Random(1)
    texts = [(k, "a " * rnd.randint(0, 40)) for k in range(500)] + [(1000 + k, "b " * 15) for k in range(300)]  # a hot length
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    n = check(best_fit.pack(df, size=32).collect(), texts, 32)
    assert n <= 1.02 * sum(len(token_ids(t)) for _, t in texts) / 32 + 1


def first_fit_decreasing(counts):
    bins = []
    for length in range(len(counts) - 1, 0, -1):
        for _ in range(counts[length]):
            k = min((k for k, room in enumerate(bins) if room >= length), key=lambda k: bins[k], default=None)
            if k is None:
                bins.append(len(counts) - 1)
                k = len(bins) - 1
            bins[k] -= length
    return len(bins)


def test_plans_use_all_and_little_space():
    rng = np.random.default_rng(4)
    for size, n, low, high in ((64, 400, 1, 64), (64, 300, 20, 45), (100, 500, 30, 60), (50, 200, 26, 50), (64, 50, 1, 6), (40, 1, 7, 8)):
        counts = np.bincount(rng.integers(low, high + 1, n), minlength=size + 1)[:size + 1]
        plan = best_fit.plan_patterns(counts)
        used = np.zeros(size + 1, np.int64)
        for pattern, times in plan:
            assert times > 0 and sum(a * k for a, k in pattern.items()) <= size
            for a, k in pattern.items():
                used[a] += k * times
        assert (used == counts).all()
        bound = -(-int((counts * np.arange(size + 1)).sum()) // size)
        sequences = sum(times for _, times in plan)
        assert bound <= sequences <= max(first_fit_decreasing(counts), bound + 1)


def test_sums():
    index = best_fit.SumIndex(np.array([0, 0, 1, 2, 0, 1, 0, 0, 1, 0, 0]))  # 2, 3, 3, 5, 8
    assert index.exact(8, {}) == (8,) and index.exact(8, {8: 1}) == (5, 3) and index.exact(6, {}) == (3, 3)
    assert index.exact(6, {3: 1}) is None and index.exact(8, {8: 1, 5: 1}) == (3, 3, 2) and index.exact(4, {}) is None
    index.take(3, 1)
    assert index.exact(6, {}) is None and index.exact(7, {}) == (5, 2)
