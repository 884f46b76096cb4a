"""Benchmark result files: read JSON, write JSON or CSV."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BENCH_FILE, BENCH_RUNS


def read_results(spark: SparkSession, *paths) -> DataFrame:
    """One row per reading with its file's context and its place in the file."""
    files = spark.read.schema(BENCH_FILE).option("multiLine", True).json(list(paths))
    return (files.select("context", F.input_file_name().alias("file"),
                         F.posexplode("benchmarks").alias("place", "b"))
            .select("file", "place", "context", "b.*"))


def result_document(context) -> Column:
    """JSON text of one result document that holds the row's reading."""
    fields = [f.name for f in BENCH_RUNS.fields if f.name not in ("Size",)]
    return F.to_json(F.struct(context.alias("context"), F.array(F.struct(*fields)).alias("benchmarks")))


def parse_documents(documents: DataFrame, text, *keep) -> DataFrame:
    """One row per reading of JSON result texts, with the document's context and its place."""
    return (documents.select(*keep, F.from_json(text, BENCH_FILE).alias("d"))
            .select(*keep, F.col("d.context").alias("context"), F.posexplode("d.benchmarks").alias("place", "b"))
            .select(*keep, "place", "context", "b.*"))


def with_sequence(results: DataFrame) -> DataFrame:
    """Reading order over all files as a sortable struct: file name, then place."""
    return results.withColumn("seq", F.struct("file", "place"))


def write_results(results: DataFrame, path, fmt="json"):
    writer = results.write.mode("errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
