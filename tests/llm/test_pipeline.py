"""The pipeline's stages against brute force on a small table."""

import collections
import re

import corpus_pipeline
from spikeframe.llm import line_quality
from test_near_copies import five_words

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, documents, tmp_path):
    words = " ".join(f"word{k} of the text" for k in range(150)) + "."
    planted = spark.createDataFrame([
        (9001, words, "en", "p", 1), (9002, words, "en", "p", 1), (9003, words.upper(), "en", "p", 1),
        (9004, words.replace("word77", "mail me at x.y@mail.example.org or"), "en", "p", 1),
        (9005, "Home | News | About | Contact | More | Search | Terms | End | Top | Go | Up", "en", "p", 1),
        (9006, "A clean and short document of its own, with just over ten words.", "en", "p", 1),
        (9007, None, None, None, None)], documents.schema)
    docs, seen = documents.select(*COLUMNS).union(planted), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
        if name != "packing":
            assert sorted(docs.columns) == sorted(COLUMNS)
    quality, exact, near, pii, packed = seen
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    judged = {r.doc_id for r in line_quality.quality_report(documents.union(planted)).where("kept").collect()}
    assert ids[0] == judged and not {9005, 9007} & judged and {9001, 9002, 9003, 9004, 9006} <= judged
    by_text = collections.defaultdict(list)
    for r in quality.collect():
        by_text[re.sub("[A-Z]", lambda m: m[0].lower(), r.text)].append(r.doc_id)
    assert ids[1] == {max(v) for v in by_text.values()} and 9003 in ids[1] and 9001 not in ids[1]
    kept = []  # in order of ids a text stays unless it is too similar to one that stayed
    for r in sorted(exact.collect(), key=lambda r: r.doc_id):
        own = five_words(r.text)
        if all(9 * len(own & k) < 4 * (len(own) + len(k)) for _, k in kept):
            kept.append((r.doc_id, own))
    assert ids[2] == {i for i, _ in kept} and near.count() == len(ids[2]) < len(ids[1])
    assert ids[3] == ids[2] == ids[4]
    assert pii.where("text LIKE '%x.y@mail.example.org%'").count() == 0
    assert {r.doc_id: r.doc_tokens for r in packed.collect()}.keys() == ids[3]
    assert collections.Counter(r.doc_id for r in pii.collect()) == collections.Counter(ids[3])
