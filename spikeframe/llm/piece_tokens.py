"""Byte-fallback piece tokens: BPE by a prefix table, and decoding.

For every prefix of a unit the table holds the one token that ends its encoding. Candidates come
from an Aho-Corasick automaton over the vocabulary; a candidate is right if the last token of the
prefix before it may stand next to it, that is if merging the two pieces' characters by score
gives back exactly these two. The ids are then read off the table backwards.

A unit is a run of spaces with the characters up to the next space or line end: no piece of the
vocabulary goes beyond one (checked when the model is read), so units are independent. Units are
encoded once per worker and kept in a bounded memory, whose size has no influence on results.

Defined results: null and empty texts have no ids and decode to the empty text. Repeated rows are
encoded row by row.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Recent, tokenizer_file

SPACE_MARK = "▁"
#: Units and token pairs kept by a worker before its memory starts anew.
KEPT_UNITS = 200_000
KEPT_PAIRS = 500_000
#: In the prefix table: a character without any piece, which its bytes stand for.
OUTSIDE = -1
_UNIT = re.compile(f"{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+|\n")


class PieceModel:
    """Vocabulary, automaton and memory of one worker."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(self.size)]
        self.surface = [b""] * self.size
        self.byte_ids = [0] * 256
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        unknown = model.unk_id()
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif i == unknown:
                self.surface[i] = " ⁇ ".encode()
            elif not model.is_control(i):
                if SPACE_MARK in piece.lstrip(SPACE_MARK) or "\n" in piece:
                    raise ValueError(f"piece {piece!r} goes beyond a unit")
                self.surface[i] = piece.replace(SPACE_MARK, " ").encode()
                self.ids[piece] = i
                self.rank[piece] = model.get_score(i)
                self.automaton.add_word(piece, (i, len(piece)))
        if any(c not in self.ids for piece in self.ids for c in piece):
            raise ValueError("every character of a piece must be a piece")
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.units = Recent(KEPT_UNITS)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by repeated merging: best score first, leftmost among equals."""
        parts, rank = list(text), self.rank
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = rank.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self.pairs[left, right] = self.merged(a + b) == [a, b]
        return known

    def encode_unit(self, unit: str) -> list[int]:
        n = len(unit)
        last = [OUTSIDE] * (n + 1)  # id of the token that ends each prefix
        start = [0] * (n + 1)  # where that token begins
        done = 0
        pairs, compatible = self.pairs.get, self.compatible
        for end, (token, length) in self.automaton.iter(unit):
            end += 1
            if end == done:
                continue
            before = end - length
            left = last[before]
            if before == 0 or left == OUTSIDE:
                fits = length == 1 or self._alone(token)
            else:
                fits = pairs((left, token))
                if fits is None:
                    fits = compatible(left, token)
            if fits:
                last[end], start[end], done = token, before, end
        ids: list[int] = []
        while n:
            if last[n] == OUTSIDE:
                n -= 1
                ids.extend([self.byte_ids[b] for b in reversed(unit[n].encode())])
            else:
                ids.append(last[n])
                n = start[n]
        ids.reverse()
        return ids

    def _alone(self, token: int) -> bool:
        """Whether merging a piece's own characters gives the piece."""
        known = self.pairs.get((-1, token))
        if known is None:
            piece = self.pieces[token]
            known = self.pairs[-1, token] = self.merged(piece) == [piece]
        return known

    def split(self, text: str) -> list[str]:
        """Units of a whole text; the first has the space that encoding puts in front."""
        if not text:
            return []
        plain = text.replace(SPACE_MARK, " ")
        if "  " in plain or plain[0] == " ":
            return _UNIT.findall(SPACE_MARK + plain.replace(" ", SPACE_MARK))
        marked = SPACE_MARK + plain.replace(" ", f" {SPACE_MARK}")
        return marked.replace("\n", " \n ").replace("  ", " ").rstrip(" ").split(" ") if "\n" in plain else marked.split(" ")

    def _fill(self, unit: str) -> tuple[bytes, int, bytes]:
        ids = self.encode_unit(unit)
        return (",".join(map(str, ids)).encode(), len(ids), b"".join([self.surface[i] for i in ids]))

    def encode(self, text: str | None) -> list[int]:
        return [i for unit in self.split(text or "") for i in self.encode_unit(unit)]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join([self.surface[i] for i in ids])
        return self.text_of(raw)

    @staticmethod
    def text_of(raw: bytes) -> str:
        """Surface bytes as text, without the space that encoding put in front."""
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids and SHA-256 of the decoded text."""
        rows = self.units.all(self.split(text or ""), self._fill)
        ids = hashlib.sha256(b",".join([r[0] for r in rows])).hexdigest()
        back = self.text_of(b"".join([r[2] for r in rows]))
        return sum([r[1] for r in rows]), ids, hashlib.sha256(back.encode()).hexdigest()


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per worker process and file."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _vocabulary(path: str | None) -> str:
    return path or tokenizer_file("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids."""
    def kernel(batches):
        own = model(_vocabulary(path))
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([own.encode(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))],
                names=["doc_id", "ids"])

    source = docs.select("doc_id", "text")
    return source.mapInArrow(kernel, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from rows of doc_id, ids."""
    def kernel(batches):
        own = model(_vocabulary(path))
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([own.decode(t or []) for t in batch.column(1).to_pylist()], pa.string())],
                names=["doc_id", "text"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(kernel, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both directions in one pass over the text."""
    def kernel(batches):
        own = model(_vocabulary(path))
        for batch in batches:
            rows = [own.digest(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.int64()),
                 pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(kernel, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
