"""Piece tokens and packing against the tokenizer libraries and brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from spikeframe.llm import mixture_packing, piece_tokens
from spikeframe.llm.common import tokenizer_file

ALPHABET = "ab the in ▁ \n\n\t  éüß漢字Ⅷ😀 .,!%0123abcdefghijklmnopqrstuvwxyź \r"


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))


def test_pieces_equal_the_library(library):
    own = piece_tokens.model(tokenizer_file("piece_bpe_32k.model"))
    rnd = random.Random(7)
    for k in range(3000):
        text = " " * rnd.choice((0, 0, 1, 3, 17)) + "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 60)))
        ids = library.encode(text)
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids), text


def test_digests_and_round_trip(documents, odd, library):
    for df in (documents, odd):
        want = collections.Counter()
        for r in df.select("doc_id", "text").collect():
            ids = library.encode(r.text or "")
            want[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256(library.decode(ids).encode()).hexdigest())] += 1
        assert collections.Counter(map(tuple, piece_tokens.token_digests(df).collect())) == want
    back = piece_tokens.decode_documents(piece_tokens.encode_documents(documents)).join(
        documents.withColumnRenamed("text", "old"), "doc_id")
    assert back.where("text <> old").count() == 0
    assert piece_tokens.token_digests(odd.limit(0)).count() == 0


def packed(df, **options):
    rows = mixture_packing.pack(df, **options).collect()
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    return rows, by_sequence


def token_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_every_id_is_packed_once(documents):
    rows, by_sequence = packed(documents)
    ids = {r.doc_id: token_ids(r.text) for r in documents.limit(60).collect()}
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        if r.doc_id in ids:
            own = ids[r.doc_id]
            assert r.doc_tokens == len(own) and zlib.crc32(own[r.start:r.start + r.length]) == r.ids_crc32
    assert set(pieces) == {r.doc_id for r in documents.select("doc_id").collect()}
    for own in pieces.values():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == own[0].doc_tokens
    assert set(by_sequence) == set(range(len(by_sequence)))
    for k, own in by_sequence.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 2048 or k == len(by_sequence) - 1


def test_windows_hold_the_mixture(spark):
    rows = [(i, "word " * 300, "big" if i % 4 else "small", None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    _, by_sequence = packed(df, size=1024, quantum=64)
    for k in range(len(by_sequence) - 2):
        small = sum(r.length for r in by_sequence[k] if r.queue == "ssmall")
        assert abs(small - 256) <= 64
    _, even = packed(df, size=1024, quantum=64, shares={"big": 1.0, "small": 1.0})
    assert sum(r.length for r in even[3] if r.queue == "ssmall") == 512


def test_packing_of_odd_rows(odd):
    rows, by_sequence = packed(odd)
    assert sum(r.length for r in rows) == sum(len(token_ids(r.text)) for r in odd.collect())
    assert mixture_packing.pack(odd.limit(0)).count() == 0
