"""Packing: places, check sums and what is kept when windows cut quanta."""

import collections
import os
import zlib

from spikeframe.llm import mixture_packing
from test_tokens import packed, token_ids


def test_windows_that_cut_quanta(odd):
    """A size that the quantum doesn't divide, documents in several partitions."""
    rows, by_sequence = packed(odd, size=1000, quantum=96)
    want = collections.Counter(token_ids(r.text).tobytes() for r in odd.collect())
    ids = {(r.doc_id, len(own)): own for r in odd.collect() for own in [token_ids(r.text)] if r.doc_id is not None}
    for r in rows:
        if (r.doc_id, r.doc_tokens) in ids:
            assert zlib.crc32(ids[r.doc_id, r.doc_tokens][r.start:r.start + r.length]) == r.ids_crc32
    assert sum(r.length for r in rows) == sum(n * len(x) // 4 for x, n in want.items())
    for k, own in by_sequence.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 1000 or k == len(by_sequence) - 1


def test_tokens_are_not_kept_or_moved(documents):
    """When pieces are placed, the documents' ids are neither on disk nor joined again."""
    pieces = mixture_packing.pack(documents)
    folders = {os.path.basename(os.path.dirname(f)) for f in pieces.inputFiles()}
    run = os.path.dirname(os.path.dirname(pieces.inputFiles()[0])).removeprefix("file:").replace("///", "/")
    assert folders == {"blocks"} and not {"tokens", "quanta"} & set(os.listdir(run))
