"""Registered queries on result documents, streams of readings, sketches and confidence, with their SQL oracles."""

import uuid

from pyspark.sql import functions as F

from ..functions.columns import MIX_FIRST, MIX_PRIME, MIX_SECOND
from ..operators import bench, confidence, quantiles
from ..session import ensure_checkpoint_dir, written
from ..sources import names
from ..sources.result_source import scan_results
from ..sources.results import result_document
from ..sources.tables import event_results, table
from ..streaming import readings
from .benchmark import _RESULTS

#: Readings of one result document, arrival batches of the stream, and how late a reading may be.
DOCUMENT, BATCHES, DELAY_DAYS = 500, 4, 3
FRACTIONS = (0.05, 0.25, 0.5, 0.75, 0.95)


def _folder(spark, name):
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir().rsplit("/", 1)[0]
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _documents(spark, folder):
    """Readings as result documents of up to DOCUMENT readings in files below a folder of their implementation."""
    rows = event_results(spark, folder).withColumn("impl", F.split("name", "[/_]").getItem(0))
    lines = rows.select("impl", result_document(F.create_map(F.lit("host"), (F.col("seq") % 7).cast("string"))).alias("value"))
    path = _folder(spark, "result-documents")
    lines.write.partitionBy("impl").option("maxRecordsPerFile", DOCUMENT).text(path)
    return path


def bench_scanned_documents(spark, folder):
    """All readings, written as result files and read back through the data source."""
    return scan_results(spark, _documents(spark, folder)).select(
        "name", "real_time", "cpu_time", F.col("context")["host"].alias("host"), "place")


def bench_scanned_filter(spark, folder):
    """Sorted inputs of the two plain GPU implementations; other files are not opened, or not parsed."""
    found = scan_results(spark, _documents(spark, folder)).where(
        F.col("file").startswith("impl=Cuda") & F.col("name").contains("/Sorted/"))
    return found.select("name", "real_time", F.col("context")["host"].alias("host"))


def bench_streamed_configurations(spark, folder):
    """Last readings per configuration from a stream whose every 20th reading arrives two batches late."""
    results = event_results(spark, folder).join(
        table(spark, folder, "events").select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts")), "seq")
    own = F.expr(f"least({BATCHES - 1}, seq * {BATCHES} div n + if(seq % 20 = 7, 2, 0))")
    path, size = _folder(spark, "readings"), table(spark, folder, "events").agg(F.max("event_id") + 1).first()[0]
    dealt = written(results.withColumn("n", F.lit(size)).withColumn("arrival", own.cast("int")).drop("n"), f"{path}/dealt", "arrival")
    for k in range(BATCHES):  # one arrival after the other, each read as one batch whatever its files
        dealt.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(results.schema).parquet(f"{path}/in")
        changes = readings.latest_readings(stream, "ts", f"{DELAY_DAYS} days")
        readings.process_available(changes, f"{path}/state", f"{path}/out")
    return readings.current(spark, f"{path}/out").drop("seq")


def bench_quantile_sketch(spark, folder):
    """Whether sketched quantiles of every implementation's times are within their proven rank error."""
    runs = bench.runs_from(event_results(spark, folder)).select("impl", "real_time")
    found = quantiles.sketch_quantiles(quantiles.sketches(runs, "impl", "real_time", k=256), "impl", FRACTIONS)
    # one row per implementation and fraction
    ranks = runs.join(F.broadcast(found), "impl").groupBy("impl", "fraction", "n", "error").agg(
        F.count_if(F.col("real_time") < F.col("value")).alias("below"),
        F.count_if(F.col("real_time") <= F.col("value")).alias("upto"))
    rank = F.ceil(F.col("fraction") * F.col("n"))
    return ranks.select("impl", "fraction", "n", (
        (F.col("below") - F.col("error") < rank) & (rank <= F.col("upto") + F.col("error"))).alias("within"),
        (F.col("error") <= F.col("n") * 0.1).alias("tight"))


def bench_speedup_bounds(spark, folder):
    return confidence.speedup_bounds(bench.runs_from(event_results(spark, folder)))


def bench_names_by_function(spark, folder):
    """Names parsed by the table function, called from SQL."""
    names.register(spark)
    return spark.sql("SELECT seq, impl, dist, size, max_value FROM parse_names(TABLE({readings}), 'name')",
                     readings=event_results(spark, folder).select("seq", "name"))


QUERIES = {f.__name__: f for f in (
    bench_names_by_function, bench_scanned_documents, bench_scanned_filter, bench_streamed_configurations, bench_quantile_sketch, bench_speedup_bounds)}

_NAME = "CASE WHEN broken THEN 'broken_' || seq ELSE concat_ws('/', impl, dist, size, max_value, 'iterations:5') END"
_UNIT = 10 ** 6
_MIXED = f"""
d1 AS (SELECT *, (((number + replicate * {confidence.STEP}) % {MIX_PRIME}) * {MIX_FIRST} + 1) % {MIX_PRIME} AS a FROM each),
d2 AS (SELECT * REPLACE ((a * a + {MIX_SECOND}) % {MIX_PRIME} AS a) FROM d1),
d3 AS (SELECT *, (a * a + {MIX_FIRST}) % {MIX_PRIME} AS u FROM d2)"""
_WEIGHT = " + ".join(f"(u >= {limit})::BIGINT" for limit in confidence.LIMITS)

ORACLES = {
    "bench_names_by_function": f"""{_RESULTS}
SELECT seq, CASE WHEN NOT broken THEN impl END AS impl, CASE WHEN NOT broken THEN dist END AS dist,
  CASE WHEN NOT broken THEN size END AS size, CASE WHEN NOT broken THEN max_value END AS max_value FROM res""",
    "bench_scanned_documents": f"""{_RESULTS}
SELECT {_NAME} AS name, real_time, cpu_time, CAST(seq % 7 AS VARCHAR) AS host, 0 AS place FROM res""",
    "bench_scanned_filter": f"""{_RESULTS}
SELECT {_NAME} AS name, real_time, CAST(seq % 7 AS VARCHAR) AS host FROM res
WHERE NOT broken AND dist = 'Sorted' AND impl IN ('CudaSnp', 'CudaMpiSnp')""",
    # a batch drops what is not later than the watermark its predecessor began with: the greatest time
    # of the batches before that one, less the delay
    "bench_streamed_configurations": f"""{_RESULTS},
arrived AS (SELECT r.*, epoch_ms(e.ts) AS ms, epoch_us(e.ts) AS us,
  least({BATCHES - 1}, seq * {BATCHES} // (SELECT max(event_id) + 1 FROM events) + CASE WHEN seq % 20 = 7 THEN 2 ELSE 0 END) AS batch
  FROM runs r JOIN events e ON e.event_id = r.seq),
marks AS (SELECT b.batch, max(a.ms) - {DELAY_DAYS * 86400000} AS mark
  FROM (SELECT DISTINCT batch FROM arrived) b JOIN arrived a ON a.batch < b.batch - 1 GROUP BY b.batch),
kept AS (SELECT a.* FROM arrived a LEFT JOIN marks m USING (batch) WHERE mark IS NULL OR us > mark * 1000)
SELECT size, max_value, dist, impl, count(*) AS readings, arg_max(real_time, seq) AS real_time,
  arg_max(cpu_time, seq) AS cpu_time, arg_max(comm_time, seq)::DOUBLE AS comm_time,
  arg_max(compute_time, seq)::DOUBLE AS compute_time, arg_max(procs, seq) AS procs
FROM kept GROUP BY ALL""",
    "bench_quantile_sketch": f"""{_RESULTS}
SELECT impl, fraction, count(*) AS n, true AS within, true AS tight
FROM runs, (SELECT unnest([{', '.join(f"{f}::DOUBLE" for f in FRACTIONS)}]) AS fraction) GROUP BY impl, fraction""",
    "bench_speedup_bounds": f"""{_RESULTS},
rows AS (SELECT impl, round(speedup * {_UNIT}.0::DOUBLE)::BIGINT AS s,
  ('0x' || substr(md5(size || '/' || max_value || '/' || dist), 1, 8))::BIGINT AS number FROM sp),
each AS (SELECT *, unnest(range(0, {confidence.REPLICATES + 1})) AS replicate FROM rows),{_MIXED},
w AS (SELECT impl, replicate, s, CASE WHEN replicate = 0 THEN 1 ELSE {_WEIGHT} END AS w FROM d3),
m AS (SELECT impl, replicate, sum(w)::BIGINT AS w, sum(s * w)::BIGINT // sum(w)::BIGINT AS m
      FROM w GROUP BY impl, replicate HAVING sum(w) > 0),
o AS (SELECT impl, m, row_number() OVER (PARTITION BY impl ORDER BY m, replicate) AS pos, count(*) OVER (PARTITION BY impl) AS n
      FROM m WHERE replicate > 0),
e AS (SELECT impl, min(m) FILTER (pos >= (n * 25 + 999) // 1000) AS low, min(m) FILTER (pos >= (n * 975 + 999) // 1000) AS high
      FROM o GROUP BY impl)
SELECT impl, w AS configurations, m / {_UNIT}.0::DOUBLE AS mean, low / {_UNIT}.0::DOUBLE AS low, high / {_UNIT}.0::DOUBLE AS high
FROM m JOIN e USING (impl) WHERE replicate = 0""",
}
