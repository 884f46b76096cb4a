"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java and RE2 character class body.
SPACE = r" \t-\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spikeframe-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives lost executors and shortens the plan."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Parquet tables of one operator run in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write once, read back with the written schema (no inference job on empty tables)."""
        schema = df.schema
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def delete(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file; OPT_TOKENIZERS overrides the installed package."""
    folder = os.environ.get("OPT_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent:
    """Results by word in two generations: words in use survive when the older half is dropped."""

    def __init__(self, size: int, longest: int = 64):
        self.size, self.longest = size, longest
        self.young: dict = {}
        self.old: dict = {}

    def all(self, words: list[str], make: Callable[[str], object]) -> list:
        """Results of all words, made where they aren't kept."""
        found = list(map(self.young.get, words))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            found[at] = self.one(words[at], make)
        return found

    def many(self, words: list[str], make: Callable[[list[str]], list]) -> list:
        """Results of distinct words; those that aren't kept are made in one call."""
        found = list(map(self.young.get, words))
        missing = [k for k, value in enumerate(found) if value is None]
        for k in missing:
            found[k] = self.old.get(words[k])
        new = [k for k in missing if found[k] is None]
        for k, value in zip(new, make([words[k] for k in new])):
            found[k] = value
        for k in missing:
            self._keep(words[k], found[k])
        return found

    def one(self, word: str, make: Callable[[str], object]):
        value = self.young.get(word)
        if value is None:
            value = self.old.get(word)
            if value is None:
                value = make(word)
            self._keep(word, value)
        return value

    def _keep(self, word: str, value: object) -> None:
        if len(word) <= self.longest:
            if len(self.young) >= self.size:
                self.old = self.young
                self.young = {}
            self.young[word] = value
