"""Language identification by nearest centroid.

A text is the vector of its hashed byte bigrams and trigrams, weighted by log frequency and inverse
document frequency and normalised. Every language has a few centroids (spherical k-means); a text
gets the language of the centroid with the largest cosine. A text further from every centroid than
nearly all training texts are from theirs is marked as rejected.

Document frequencies cover all training documents. Centroids are fitted on at most `sample`
documents of each language, those with the smallest hashes of id and text. What the driver holds is bounded by
`buckets`, `sample` and the number of languages.

Defined results: null texts and texts without a letter get `und` with score 0, and so does every
text when nothing could be learned. A null id counts as not held out. Repeated rows are predicted
row by row and are one document of the sample.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
#: ASCII letters and the bytes of other characters as they are; everything else is a space.
_LETTERS = np.array([c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)], np.uint32)


def counts(text: str, buckets: int) -> np.ndarray:
    """How often each bucket's n-grams occur in the whole text, in lower case with single spaces."""
    b = _LETTERS[np.frombuffer(text.lower().encode(), np.uint8)]
    b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))] if len(b) else b
    two = (b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA6B)) if len(b) > 1 else b[:0]
    three = (two[:-1] ^ (b[2:] * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F))) * np.uint32(0x9E3779B1)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    return np.bincount(np.concatenate([two * np.uint32(0x2C1B3C6D) >> shift, three >> shift]), minlength=buckets)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def unit_rows(rows: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1, norms)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_frequencies(docs: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and the number of texts; summed per task first."""
    def kernel(batches):
        total, n = np.zeros(buckets, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += counts(text, buckets) > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(buckets + 1)), pa.array(np.append(total, n))], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(kernel, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(buckets + 1, np.int64)
    for row in rows.collect():
        found[row["bucket"]] = row["n"]
    return found[:-1], int(found[-1])


def clusters(rows: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means; the first centres are far apart."""
    centres = [rows.mean(axis=0)]
    while len(centres) < min(k, len(rows)):
        centres.append(rows[np.argmin((rows @ unit_rows(np.array(centres)).T).max(axis=1))])
    centres = unit_rows(np.array(centres))
    for _ in range(rounds):
        own = (rows @ centres.T).argmax(axis=1)
        centres = unit_rows(np.array([
            rows[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))]))
    return centres


class Model:
    def __init__(self, buckets: int, idf: np.ndarray, languages: list[str], centres: np.ndarray, least: float):
        self.buckets, self.idf = buckets, idf.astype(np.float32)
        self.languages, self.centres, self.least = languages, centres.astype(np.float32), least

    def vector(self, text: str) -> np.ndarray:
        v = np.log1p(counts(text, self.buckets)).astype(np.float32) * self.idf
        norm = float(np.linalg.norm(v))
        return v / norm if norm else v

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine to its centroid, and whether the text is too far from all of them."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        near = self.centres @ self.vector(text)
        best = int(near.argmax())
        return self.languages[best], float(min(1.0, max(0.0, near[best]))), bool(near[best] < self.least)


def _samples(rows: DataFrame, model: Model, sample: int):
    """Each language with the vectors of its `sample` documents of smallest hashes, one language at a time.

    Repeated rows count once. The first pass gathers hashes only (two numbers a document, distinct
    ones summed in the tasks), the second makes vectors of the chosen texts in the tasks: the driver
    gets no text, and vectors of one language at a time.
    """
    draw = F.xxhash64("doc_id", "text")
    order = Window.partitionBy("lang").orderBy("draw")
    ranked = rows.select("lang", draw.alias("draw")).distinct().withColumn("n", F.row_number().over(order))
    last = {r["lang"]: r["draw"] for r in ranked.where(F.col("n") <= sample).groupBy("lang").agg(
        F.max("draw").alias("draw")).collect()}
    if not last:
        return
    limit = F.create_map(*[F.lit(x) for pair in sorted(last.items()) for x in pair])[F.col("lang")]

    def kernel(batches):
        for batch in batches:
            vectors = [model.vector(t).tobytes() if has_letter(t) else None for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(vectors, pa.binary())], names=["lang", "draw", "v"])

    chosen = rows.where(draw <= limit).select("lang", draw.alias("draw"), "text").mapInArrow(
        kernel, "lang string, draw long, v binary").where("v IS NOT NULL").dropDuplicates(["lang", "draw"])
    for language, found in itertools.groupby(chosen.orderBy("lang", "draw").toLocalIterator(), key=lambda r: r["lang"]):
        yield language, np.array([np.frombuffer(r["v"], np.float32) for r in found])


def fit(docs: DataFrame, buckets: int = 4096, sample: int = 400, centroids: int = 3, far_share: float = 0.001) -> Model:
    """Learn from rows of doc_id, text, lang with a language and a text; `buckets` is a power of two."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", "text", F.col("lang").cast("string").alias("lang"))
    df, n = document_frequencies(rows, buckets)
    idf = np.log((1 + n) / (1 + df)) + 1
    model = Model(buckets, idf, [], np.zeros((0, buckets)), 0.0)
    languages, centres, own = [], [], []
    for language, vectors in _samples(rows, model, sample):
        found = clusters(vectors, centroids)
        languages += [language] * len(found)
        centres.append(found)
        own.append((vectors @ found.T).max(axis=1))
    if not languages:
        return model
    return Model(buckets, idf, languages, np.concatenate(centres), float(np.quantile(np.concatenate(own), far_share)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected: from the text alone."""
    def kernel(batches):
        for batch in batches:
            found = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"])

    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(kernel, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """Predictions for all documents, learned from those that aren't held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
