"""Near copies of the pipeline: one-word changes, recall at Jaccard 0.8, brute force."""

import random

import corpus_pipeline
import numpy as np
from spikeframe.llm import near_copies
from spikeframe.llm.common import Scratch


def five_words(text):
    w = (text or "").lower().split()
    return {" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = five_words(a), five_words(b)
    return len(a & b) / len(a | b)


def test_one_word_changes(spark):
    rnd = random.Random(3)
    rows = []
    for k in range(60):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(60, 300))]
        rows.append((k, " ".join(words)))
        words[rnd.randrange(len(words))] = "changed"
        rows.append((1000 + k, " ".join(words)))
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    got = stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == list(range(60))


def test_recall_at_the_threshold(spark):
    rnd = random.Random(4)
    rows, near = [], 0
    for k in range(300):
        words = [f"w{rnd.randrange(50000)}" for _ in range(300)]
        rows.append((k, " ".join(words)))
        for at in rnd.sample(range(4, 290, 10), 6):
            words[at] = "changed"
        rows.append((1000 + k, " ".join(words)))
        near += jaccard(rows[-1][1], rows[-2][1]) >= 0.8
    got = {r.doc_id for r in near_copies.keep_distinct(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    gone = set(text) - got
    assert all(i >= 1000 and jaccard(text[i], text[i - 1000]) >= 0.8 for i in gone)  # no false one
    print(len(gone), near)
    assert near == 300 and len(gone) >= 0.9 * near


def test_order_of_ids_and_odd_rows(spark, odd):
    words = [f"w{k}" for k in range(200)]
    chain = []
    for k in range(30):  # neighbours are alike, far ones are not
        chain.append((k, " ".join(words)))
        words[6 * k + 3] = f"new{k}"
    want = []
    for i, t in chain:
        if all(jaccard(t, chain[j][1]) < 0.8 for j in want):
            want.append(i)
    got = near_copies.keep_distinct(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == want and 1 < len(want) < 30
    kept = near_copies.keep_distinct(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == [1, 3, 4, 5, 6, 7, 8, 9, 10]
    assert near_copies.keep_distinct(odd.limit(0)).count() == 0


def test_stage_keeps_what_brute_force_keeps(spark, documents):
    docs = documents.where("doc_id IS NOT NULL").select("doc_id", "text")
    kept = []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        own = five_words(r.text)
        if not own or all(9 * len(own & k) < 4 * (len(own) + len(k)) for k in (k for _, k in kept)):
            kept.append((r.doc_id, own))
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in kept]


def test_tables_link_near_prints_only(spark):
    """Many small buckets, some crowded: near prints are linked, unlike ones never."""
    rnd = np.random.default_rng(5)
    prints = rnd.integers(0, 1 << 64, (20000, near_copies.SEEDS), dtype=np.uint64)
    bits = np.zeros((2000, 64 * near_copies.SEEDS), np.uint8)
    for row in bits:
        row[rnd.choice(len(row), 53, replace=False)] = 1  # a sixth
    prints[18000:] = prints[:2000] ^ np.packbits(bits, axis=1).view(np.uint64)
    rows = [(k, [int(x) for x in row]) for k, row in enumerate(prints.view(np.int64))]
    df = spark.createDataFrame(rows, "node long, fps array<long>")
    links = {(min(r), max(r)) for r in near_copies._links(df, 64).collect()}
    assert all(v == u + 18000 for u, v in links) and len(links) >= 0.95 * 2000
    u, v = near_copies.bucket_links(np.ascontiguousarray(prints.T), 1024)
    assert np.all(np.abs(u - v) == 18000) and len({(min(p), max(p)) for p in zip(u, v)}) >= 0.95 * 2000
    same = np.repeat(prints[:1].T, 5000, axis=1)
    u, v = near_copies.bucket_links(same, 1024)
    assert len(set(u)) == 4999 and set(v) == {0}


def test_rounds_decide_in_order(spark):
    """One component of many rounds equals the decisions in order of ids."""
    rnd = random.Random(6)
    sets, base = [], [rnd.sample(range(1 << 40), 40) for _ in range(300)]
    for k in range(3000):
        own = list(rnd.choice(base))
        for at in rnd.sample(range(40), rnd.randint(0, 6)):
            own[at] = rnd.randrange(1 << 40)
        sets.append((1 + k % 7 // 6, k, own))
    want, kept = [], {1: [], 2: []}
    for root, k, own in sets:
        own = set(own)
        if any(9 * len(own & other) >= 4 * (len(own) + len(other)) for other in kept[root]):
            want.append(k)
        else:
            kept[root].append(own)
    df = spark.createDataFrame(sets, "root long, doc_id long, hashes array<long>").repartition(5)
    got = near_copies.rounds(df, Scratch(spark, "rounds"), first=200)
    assert sorted(r.doc_id for r in got.collect()) == want and 0 < len(want) < 3000


def test_small_buckets_keep_what_brute_force_keeps(spark, documents):
    docs = documents.where("doc_id IS NOT NULL").select("doc_id", "text")
    ids = [sorted(r.doc_id for r in near_copies.keep_distinct(docs, bucket=size).collect()) for size in (8, 512)]
    assert ids[0] == ids[1] and len(ids[0]) < docs.count()
