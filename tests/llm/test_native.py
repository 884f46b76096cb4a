"""Quality rules, exact copies and surrogates: brute force, odd rows, empty tables."""

import collections
import re

from pyspark.sql import functions as F

from spikeframe.llm import exact_dedup, line_quality, surrogates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_quality_matches_brute_force(documents, odd):
    for df in (documents, odd):
        want = collections.Counter((r.doc_id, *base(r.text)) for r in df.select("doc_id", "text").collect())
        got = collections.Counter(tuple(r)[:7] for r in line_quality.quality_report(df).collect())
        assert got == want


def test_line_rules(spark):
    prose = "The first line of a text ends as it should. " * 3
    rows = [(1, prose), (2, "\n".join(["Home | News | About | Contact | Search | Top | End | More"] * 3)),
            (3, prose + "\nAll rights reserved.\nHome | News | Help"), (4, "BUY!! NOW!! " * 10),
            (5, f"{prose}\n\n{prose}"), (6, prose + "\nThe cookie " + "crumbled on the old table " * 8)]
    got = {r.doc_id: r for r in line_quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].quality.clean_text == prose and got[3].quality.clean_text == prose
    assert got[2].quality.clean_text == "" and not got[2].quality.kept
    assert not got[4].quality.kept
    assert got[5].quality.clean_text == rows[4][1] and got[6].quality.clean_text == rows[5][1]


def test_quality_stage_keeps_columns(odd):
    kept = line_quality.keep_good(odd)
    assert kept.columns == odd.columns and kept.schema["quality"].dataType == odd.schema["quality"].dataType
    assert {r.doc_id for r in kept.collect()} <= {None, 1, 2, 6, 7, 9}
    assert line_quality.keep_good(odd.limit(0)).count() == 0


def test_clean_labels_are_kept(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").withColumnRenamed("quality", "label")
    rows = line_quality.quality_report(documents).join(labels, "doc_id").where("NOT base_failed")
    assert rows.where("label = 1 AND NOT kept").count() == 0
    assert rows.where("label = 0 AND kept").count() <= 0.05 * rows.where("label = 0").count()


def test_exact_groups(documents, odd):
    for df in (documents, odd):
        rows = df.select("doc_id", "text").collect()
        groups = collections.defaultdict(list)
        for r in rows:
            groups[lower(r.text)].append(r.doc_id)
        want = set()
        for norm, ids in groups.items():
            known = [i for i in ids if i is not None]
            keep = max(known) if known else None
            want |= {(i, keep, len(ids), i == keep) for i in ids}
        got = [tuple(r)[:4] for r in exact_dedup.exact_dedup(df).collect()]
        assert len(got) == len(set((r.doc_id, lower(r.text)) for r in rows))
        assert set(got) == want


def test_hash_collisions_are_split(documents):
    def weak(text):
        return F.lit(1)

    assert set(map(tuple, exact_dedup.exact_dedup(documents, weak).collect())) == set(
        map(tuple, exact_dedup.exact_dedup(documents).collect()))


def test_distinct_stage(documents, odd):
    for df in (documents, odd, odd.limit(0)):
        kept = exact_dedup.keep_distinct(df)
        assert kept.columns == df.columns
        rows = kept.select("doc_id", "text").collect()
        assert len(rows) == len({lower(r.text) for r in rows}) == len({lower(r.text) for r in df.select("text").collect()})


def test_surrogates(spark, odd):
    text = ("Anna.Lee@Mail3.example.com ANNA.LEE@MAIL3.EXAMPLE.COM +1 (286) 555-5136 +1 286 555 5136 4379362835490466 "
            "180.194.127.198!! 123-45-6789 Mrs Maria Ivanova, Herr Müller; 2024-01-15 and 3.14159")
    df = spark.createDataFrame([(1, text), (2, "x " + text)], "doc_id long, text string")
    one, two = surrogates.rewritten(df).orderBy("doc_id").collect()
    assert two.text == "x " + one.text  # the same entities in another document
    by = {e.value: e.surrogate for e in one.entities}
    assert len(by) == 9 and not any(v in one.text for v in by)
    assert by["Anna.Lee@Mail3.example.com"].upper() == by["ANNA.LEE@MAIL3.EXAMPLE.COM"]
    a, b = by["+1 (286) 555-5136"], by["+1 286 555 5136"]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", a) and re.sub(r"\D", "", a) == re.sub(r"\D", "", b)
    assert all(0 <= int(x) <= 255 for x in by["180.194.127.198"].split("."))
    assert by["Mrs Maria Ivanova"].startswith("Mrs ") and by["Mrs Maria Ivanova"].endswith("a")
    assert one.text.endswith("; 2024-01-15 and 3.14159")
    other = surrogates.rewritten(df, key="another key").where("doc_id = 1").first()
    assert all(e.surrogate != by[e.value] for e in other.entities)
    same = surrogates.without_personal_data(odd)
    assert same.columns == odd.columns and same.count() == odd.count()
    assert same.where("text LIKE '%a.b@c.example.com%'").count() == 0
    assert surrogates.report(odd.limit(0)).count() == 0


def test_surrogates_stay_distinct(spark, documents):
    near = spark.range(3000).select(
        "id", F.concat(F.lit("call 555-"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(" or mail u"), "id",
                       F.lit("@m.example.com or 10.0."), (F.col("id") / 256).cast("int"), F.lit("."),
                       (F.col("id") % 256).cast("int")).alias("text"))
    assert surrogates.collisions(near).count() == 0
    assert surrogates.rewritten(near).select(F.sum(F.size("entities"))).first()[0] == 9000
    plain = documents.where("NOT text RLIKE '[@0-9]'")
    assert surrogates.rewritten(plain).join(plain.withColumnRenamed("text", "old"), "doc_id").where("text <> old").count() == 0
