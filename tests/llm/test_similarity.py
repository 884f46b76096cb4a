"""SimHash components, repeated byte strings: brute force, crowded shards, odd rows, empty tables."""

import collections
import hashlib
import random
import re

import numpy as np

from spikeframe.llm import simhash_trees, suffix_levels
from spikeframe.llm.common import Scratch
from spikeframe.llm.components import components


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 3 else [" ".join(w[i:i + 3]) for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, radius):
    """Label of every fingerprint: its component's number."""
    values = np.array(sorted(set(prints)), np.uint64)
    label = np.arange(len(values))
    for k, v in enumerate(values):
        near = np.flatnonzero(np.bitwise_count(values ^ v) <= radius)
        old = np.unique(label[near])
        label[np.isin(label, old)] = old[0]
    return dict(zip(map(int, values), label))


def test_components_match_brute_force(documents, odd):
    for df in (documents, odd):
        rows = df.select("doc_id", "text").collect()
        prints = [brute_fingerprint(r.text) for r in rows]
        label = brute_components(prints, 2)
        least = {}
        for r, p in zip(rows, prints):
            if r.doc_id is not None:
                least[label[p]] = min(least.get(label[p], r.doc_id), r.doc_id)
        want = collections.Counter((r.doc_id, f"{p:016x}", least.get(label[p])) for r, p in zip(rows, prints))
        assert collections.Counter(map(tuple, simhash_trees.near_duplicates(df).collect())) == want
    assert simhash_trees.near_duplicates(odd.limit(0)).count() == 0


def test_links_survive_crowded_shards(spark):
    rnd = random.Random(5)
    prints = set()
    for centre in (rnd.getrandbits(64), 0):  # balls of neighbours, chains included
        ball = [centre]
        for _ in range(150):
            ball.append(rnd.choice(ball) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) * rnd.randint(0, 1))
        prints |= set(ball)
    prints |= {rnd.getrandbits(64) for _ in range(200)}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    want = brute_components(prints, 2)
    for limit in (4096, 8):  # no shard crowded, nearly all crowded
        scratch = Scratch(spark, "test-links")
        links = simhash_trees.links(df, scratch, 2, limit)
        roots = {r.node & (1 << 64) - 1: r.root for r in components(links, scratch).collect()}
        groups = collections.defaultdict(set)
        for p in prints:
            groups[want[p]].add(roots.get(p))
        assert all(len(g) == 1 for g in groups.values())  # one root for each component
        linked = [next(iter(g)) for g in groups.values() if g != {None}]
        assert len(linked) == len(set(linked))


def test_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1300)] + [(5000, 5000)]
    scratch = Scratch(spark, "test-components")
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long"), scratch).collect()}
    assert found == {k: 0 for k in range(201)} | {k: 1000 for k in range(1000, 1300)}


def test_representatives(spark, odd):
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(5, text, 1), (6, text + " more", 1), (7, "other words entirely here", 2), (7, "other words entirely here", 2)]
    kept = simhash_trees.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string, component_id int"))
    assert sorted((r.doc_id, r.component_id) for r in kept.collect()) in ([(5, 1), (7, 2)], [(5, 1), (6, 1), (7, 2)])
    kept = simhash_trees.keep_representatives(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and {1, 3, 6, 8} <= set(ids) and 2 not in ids


def brute_repeats(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by a table of all strings."""
    raw = [(-(1 << 63) if r.doc_id is None else r.doc_id, (r.text or "").encode(), r.doc_id) for r in rows]
    least = {}
    for i, t, _ in raw:
        for p in range(len(t) - length + 1):
            s = t[p:p + length]
            if least.get(s, i) >= i:
                least[s] = i
    out = collections.Counter()
    for i, t, own in raw:
        covered = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if least[t[p:p + length]] < i:
                covered[p:p + length] = b"\x01" * length
        kept = bytes(b for b, c in zip(t, covered) if not c)
        out[(own, len(t), sum(covered), len(re.findall(rb"\x01+", bytes(covered))), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_repeats_match_brute_force(spark, documents):
    few = documents.where("length(text) < 4000")
    got = suffix_levels.digests(suffix_levels.repeated_spans(few, slot_bytes=30_000))
    assert collections.Counter(map(tuple, got.collect())) == brute_repeats(few.collect(), 50)


def test_repeats_of_odd_rows(spark, odd):
    rnd = random.Random(2)
    passage = "".join(rnd.choice("abcdé ") for _ in range(120))
    rows = [(k, "".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, 90))) + passage[rnd.randint(0, 40):]
             + "".join(rnd.choice("uvw ") for _ in range(rnd.randint(0, 30)))) for k in range(60)]
    rows += [(100, "a" * 400), (101, "a" * 300), (102, "ab" * 100), (103, "ab" * 60), (7, "a" * 60), (None, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").union(odd.select("doc_id", "text").where("doc_id <> 6"))
    for batches in (1, 5):
        got = suffix_levels.digests(suffix_levels.repeated_spans(df, slot_bytes=20_000, batches=batches))
        assert collections.Counter(map(tuple, got.collect())) == brute_repeats(df.collect(), 50)
    assert suffix_levels.repeated_spans(odd.limit(0)).count() == 0


def test_repeats_of_short_texts_only(spark):
    rows = [(k, f"Comment number {k % 7}, short.") for k in range(40)] + [(50, "x" * 49), (51, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_levels.digests(suffix_levels.repeated_spans(df))
    assert collections.Counter(map(tuple, got.collect())) == brute_repeats(df.collect(), 50)
