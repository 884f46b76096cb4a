import datetime
import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True, scope="session")
def few_partitions(spark):
    from spikeframe.session import ship_package

    ship_package(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.spikeframe.surrogates.key", "the key of the tests")


@pytest.fixture(scope="session")
def documents(spark):
    if not os.path.isdir(SF):
        pytest.skip("test tables absent")
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, ties, clashing extra columns."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, hash string, quality string, "
              "entities string, queue string, slot int, norm string, kept boolean, __row string, spans date")
    long = "Thonan der 12 réon, " * 9000
    extra = ("h", "q", "e", "u", 7, "n", True, "r", datetime.date(2020, 1, 1))
    rows = [
        (1, "Same text here.", "en", "a", 15, *extra), (1, "Same text here.", "en", "a", 15, *extra),
        (2, "SAME text here.", "en", "a", 15, *extra), (3, None, None, None, None, *[None] * 9),
        (None, None, None, None, None, *[None] * 9), (None, "Same text here.", "en", None, 1, *extra),
        (4, "", "en", "b", 0, *extra), (5, " \t\n\x0b ", "en", "b", 5, *extra), (6, long, "fr", "b", len(long), *extra),
        (7, long + "end", "fr", None, len(long) + 3, *extra), (7, "another text of the same id", "de", "a", 3, *extra),
        (8, "漢字 😀 ß\r\nx", None, "b", 9, *extra), (9, "a.b@c.example.com password = hunter2hunter2", "en", "c", 3, *extra),
        (10, "🙂", "en", "c", 1, *extra), (None, "no id, but text", "en", "c", 1, *extra),
    ]
    return spark.createDataFrame(rows, schema).repartition(3).cache()
