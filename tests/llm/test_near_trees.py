"""The near-copy stage's pigeonhole runs and BK-trees against brute force."""

import os

import numpy as np
from pyspark.sql import functions as F
from spikeframe.llm import near_copies
from spikeframe.llm.common import Scratch


def components(n, pairs):
    label = list(range(n))
    for _ in range(n):
        old = list(label)
        for u, v in pairs:
            label[u] = label[v] = min(label[u], label[v])
        if label == old:
            return label
    return label


def test_runs_keep_the_pigeonhole_promise():
    """Runs of one permutation share no bit: what differs in fewer bits than there are runs meets in one."""
    for n in (3000, 10 ** 5, 10 ** 7):
        masks = near_copies.tables(n, 512)
        bits = int(np.bitwise_count(masks[0]).sum())
        per = 64 * near_copies.SEEDS // bits
        assert 512 << bits >= n and (np.bitwise_count(masks).sum(axis=1) == bits).all()
        for at in range(0, len(masks), per):
            assert np.bitwise_count(np.bitwise_or.reduce(masks[at:at + per])).sum() == bits * len(masks[at:at + per])
        first = masks[:per]
        rnd = np.random.default_rng(n)
        for _ in range(50):
            differing = np.zeros(64 * near_copies.SEEDS, np.uint8)
            differing[rnd.choice(len(differing), len(first) - 1, replace=False)] = 1
            assert ((first & np.packbits(differing).view(np.uint64)) == 0).all(axis=1).any()


def test_trees_link_what_brute_force_links():
    rnd = np.random.default_rng(8)
    for far in (60, 90):
        prints = rnd.integers(0, 1 << 64, (near_copies.SEEDS, 300), dtype=np.uint64)
        for k in range(100, 300):  # families and chains
            own = np.zeros(64 * near_copies.SEEDS, np.uint8)
            own[rnd.choice(len(own), rnd.integers(0, far), replace=False)] = 1
            prints[:, k] = prints[:, rnd.integers(0, 100 if far == 60 else k)] ^ np.packbits(own).view(np.uint64)
        near = np.bitwise_count(prints[:, :, None] ^ prints[:, None, :]).sum(axis=0) <= near_copies.FAR
        want = components(300, [p for p in zip(*np.nonzero(near)) if p[0] < p[1]])
        u, v = near_copies.Tree(prints).links(near_copies.FAR)
        assert components(300, list(zip(u.tolist(), v.tolist()))) == want and 1 < len(set(want)) < 300
        assert len(u) == 300 - len(set(want))  # stars, not pairs


def test_texts_of_unlinked_documents_stay_where_they_are(spark, documents):
    """Nearly all documents without a link are left out before texts are joined; none with a link is."""
    scratch = Scratch(spark, "marks")
    rows = spark.range(200000).select(F.xxhash64("id").alias("node"), "id")
    roots = scratch.write(rows.where("id % 100 = 3").select("node", F.col("node").alias("root")), "roots")
    got = near_copies._may_be_linked(rows, roots, scratch)
    assert got.columns == ["node", "id"]
    assert got.join(roots, "node").count() == 2000 and got.count() < 0.1 * 200000
    few = near_copies._may_be_linked(rows, roots, scratch, most=1 << 12)  # a bitmap too small stays right
    assert few.join(roots, "node").count() == 2000
    none = near_copies._may_be_linked(rows, roots.limit(0), scratch)
    assert none.count() == 0


def test_work_is_removed(spark, documents):
    kept = near_copies.keep_distinct(documents.select("doc_id", "text"))
    folder = os.path.dirname(os.path.dirname([f for f in kept.inputFiles() if "near-copies" in f][0])).removeprefix("file:")
    assert sorted(os.listdir("/" + folder.lstrip("/"))) == ["gone", "repeated"]
