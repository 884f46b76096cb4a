"""The corpus pipeline: each stage's rows are written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spikeframe.llm import exact_dedup, line_quality, mixture_packing, near_copies as near, surrogates
from spikeframe.llm.common import Scratch, table
from spikeframe.llm.queries import PUBLIC_KEY


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_distinct(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_distinct(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.without_personal_data(docs, docs.sparkSession.conf.get(surrogates.KEY, None) or PUBLIC_KEY)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture_packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules), ("exact_dedup", exact_copies), ("simhash_near_dedup", near_copies),
    ("pii", personal_data), ("packing", packing),
]

#: Fingerprint links, keyed surrogates and tokens are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result lies in the shared folder."""
    scratch, docs = Scratch(spark, "corpus-pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.delete(STAGES[k - 1][0])
    return docs
