"""Ids by distinct words and parts against the tokenizer, and how often unknown parts are tokenized."""

import random

import numpy as np
import pyarrow as pa
import pytest

from spikeframe.llm import mixture_packing
from spikeframe.llm.common import Recent, tokenizer_file
from spikeframe.llm.mixture_packing import WordIds

MARKS = ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "</w>", "<w>", "don't", "'S'll", "H̱", "Å", "İ", "Σ", "ſ", "ß",
         "\t", "\n", " ", " ", " ", "\u0085", "​", "漢字", "😀", "१२", "½", "ª", "ǅ", "a,'s!?", "x" * 200, "--1,000.50%"]
ALPHABET = "abcdeABCDEéÉüÑ 01'.,#%<|>\n"


@pytest.fixture()
def own():
    return WordIds(tokenizer_file("word_bpe_49k.json"))


def test_ids_equal_the_tokenizers(own):
    own.parts, own.odd = Recent(40), Recent(5)  # words are dropped and made again
    rnd = random.Random(11)
    texts = [None, "", " ", "\n", "word"] + ["".join(rnd.choice(MARKS) if rnd.random() < 0.15 else rnd.choice(ALPHABET)
                                                     for _ in range(rnd.randint(0, 90))) for _ in range(3000)]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, kind)], ["n", "text"]).slice(0, len(texts))
        seen = 0
        for rows, ids, ends in own.runs(batch, 1):
            for text, found in zip(rows.column("text").to_pylist(), np.split(ids, ends[:-1])):
                assert found.tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids + [1], text
                seen += 1
        assert seen == len(texts)


def test_runs_hold_all_rows_in_order(own, monkeypatch):
    texts = ["a b " * n for n in (1, 500, 2, 3, 2000, 0, 7)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["n", "text"])
    whole = [(rows.column("n").to_pylist(), ids.tolist()) for rows, ids, _ in own.runs(batch, 1)]
    monkeypatch.setattr(mixture_packing, "RUN_BYTES", 100)
    cut = [(rows.column("n").to_pylist(), ids.tolist()) for rows, ids, _ in own.runs(batch.slice(0), 1)]
    assert len(whole) == 1 < len(cut)
    assert whole[0] == tuple(sum((c[k] for c in cut), []) for k in (0, 1))
    assert list(own.runs(batch.slice(0, 0), 1)) == []


def test_unknown_parts_are_made_together(own):
    """A word costs no call of its own: repeats are found by Arrow, new parts go through the merges a line at a time."""
    lines = []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            lines.extend(texts)
            return model.encode_batch_fast(texts, **options)

    model, own.model = own.model, Counted()
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abcdefgh") for _ in range(9)) for _ in range(640)})
    own.encode(pa.array([" ".join(words), ", ".join(words), "\n".join(f"{w}!!" for w in words)]), 1)
    assert len(lines) == -(-(len(words) + 2) // mixture_packing.PARTS)
    own.encode(pa.array([" ".join(words)]), 1)
    assert len(lines) == -(-(len(words) + 2) // mixture_packing.PARTS)
