"""Language centroids against a plain model: frequencies, the sample, vectors and the nearest centroid."""

import collections
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from spikeframe.llm import language_centroids as lc

BUCKETS = 512


def grams(text):
    """Buckets of the text's byte bigrams and trigrams, one by one."""
    text = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in text.lower().encode())
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    found, mask, shift = collections.Counter(), (1 << 32) - 1, 32 - BUCKETS.bit_length() + 1
    two = [(a * 0x9E3779B1 + b * 0x85EBCA6B) & mask for a, b in zip(text, text[1:])]
    for x in two:
        found[(x * 0x2C1B3C6D & mask) >> shift] += 1
    for x, c in zip(two, text[2:]):
        found[((x ^ ((c * 0xC2B2AE35 + 0x27D4EB2F) & mask)) * 0x9E3779B1 & mask) >> shift] += 1
    return found


def vector(text, idf):
    v = {g: math.log1p(n) * idf[g] for g, n in grams(text).items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {g: x / norm for g, x in v.items()} if norm else v


def test_predictions_equal_a_plain_model(spark, documents):
    train = documents.where(~lc.held_out(F.col("doc_id")))
    model = lc.fit(train, buckets=BUCKETS, sample=20)
    rows = [r for r in train.collect() if r.lang is not None and r.text is not None]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in rows)
    df = collections.Counter(g for r in rows for g in grams(r.text))
    idf = [math.log((1 + len(rows)) / (1 + df[g])) + 1 for g in range(BUCKETS)]
    assert np.allclose(model.idf, idf, rtol=1e-5)
    assert set(model.languages) == {r.lang for r in rows} and all(n <= 3 for n in collections.Counter(model.languages).values())
    centres = model.centres.astype(float)
    assert np.allclose(np.linalg.norm(centres, axis=1), 1, atol=1e-4)
    checked = 0
    for r in lc.identify(documents, model).join(documents.select("doc_id", "text"), "doc_id").collect():
        if not lc.has_letter(r.text):
            assert r.lang_pred == "und" and r.score == 0
            continue
        cosines = [sum(x * c[g] for g, x in vector(r.text, idf).items()) for c in centres]
        assert abs(max(cosines) - r.score) < 1e-3
        assert cosines[model.languages.index(r.lang_pred)] <= max(cosines) + 1e-6
        best = max(c for c, lang in zip(cosines, model.languages) if lang == r.lang_pred)
        assert best >= max(cosines) - 1e-3
        checked += 1
    assert checked > 100


def test_sample_is_bounded_and_spread(spark):
    rows = [(None, f"the hot row of no id {k % 5}", "en") for k in range(300)] + [(k, f"der text nummer {k}", "de") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    empty = lc.Model(BUCKETS, np.ones(BUCKETS), [], np.zeros((0, BUCKETS)), 0.0)
    found = dict(lc._samples(df, empty, 20))
    assert list(found) == ["de", "en"] and len(found["de"]) == 20 and len(found["en"]) == 5
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("doc_id", "text").alias("h")).where("text LIKE 'der%'").collect()}
    first = sorted(hashes, key=hashes.get)[:20]
    assert np.allclose(found["de"], [empty.vector(t) for t in first])
