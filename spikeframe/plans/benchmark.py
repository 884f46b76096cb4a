"""Registered benchmark-analytics queries with their SQL oracles; events are the readings."""

from pyspark.sql import functions as F

from ..functions.columns import parse_run_name
from ..operators import bench
from ..sources.results import parse_documents, result_document
from ..sources.tables import event_results, table

DIGITS = 6


def _runs(spark, folder):
    return bench.runs_from(event_results(spark, folder))


def _rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, DIGITS))
    return df


def bench_parse_names(spark, folder):
    """Every reading's name in both historical formats; NULL where it does not parse."""
    results = event_results(spark, folder).select("seq", "name")
    old = F.regexp_replace("name", "^([^/]*)/([^/]*)/([^/]*)/([^/]*)/.*$", "$1_$3_$4_$2")
    return results.select("seq", parse_run_name("name").alias("r"),
                          parse_run_name(old, "underscore").alias("o")).select(
        "seq", "r.impl", "r.dist", "r.size", "r.max_value", F.col("o.impl").alias("old_impl"),
        F.col("o.dist").alias("old_dist"), F.col("o.size").alias("old_size"))


def bench_by_configuration(spark, folder):
    return bench.by_configuration(_runs(spark, folder))


def bench_time_table(spark, folder):
    return bench.time_table(_runs(spark, folder))


def bench_speedups(spark, folder):
    return bench.speedups(_runs(spark, folder)).select("size", "max_value", "dist", "impl", "speedup")


def bench_speedups_by_size(spark, folder):
    return bench.speedups_by_size(_runs(spark, folder))


def bench_comm_and_compute(spark, folder):
    return bench.comm_and_compute(_runs(spark, folder))


def bench_comm_overhead(spark, folder):
    runs = bench.comm_overhead(bench.with_computation(_runs(spark, folder)))
    return _rounded(runs.select("seq", "impl", "dist", "size", "comp_time", "comm_percentage"),
                    "comp_time", "comm_percentage")


def bench_scalability(spark, folder):
    return bench.scalability(_runs(spark, folder))


def bench_speedup_statistics(spark, folder):
    return _rounded(bench.speedup_statistics(_runs(spark, folder)),
                    "average", "median", "minimum", "maximum", "deviation")


def bench_verdict(spark, folder):
    return _rounded(bench.optimisation_verdict(_runs(spark, folder)), "naive", "optimised", "improvement")


def bench_summary(spark, folder):
    return bench.implementation_summary(_runs(spark, folder))


def bench_implementations(spark, folder):
    return bench.configured_implementations(_runs(spark, folder))


def bench_efficiency(spark, folder):
    return _rounded(bench.efficiency(_runs(spark, folder)), "speedup", "efficiency", "elements_per_second")


def bench_name_filter(spark, folder):
    hits = bench.filter_names(event_results(spark, folder), "Cuda.*/Sorted/.*00/")
    return hits.select("seq", "name")


def bench_report_metric(spark, folder):
    """Number behind a key in a text report."""
    reports = table(spark, folder, "events").select("event_id", F.concat(
        F.lit("Total Steps: 3\nComm Time:    "), F.col("value"), F.lit(" ms\n"), F.col("props")).alias("report"))
    return bench.report_metrics(reports, "report", ["Comm Time", "\"k\"", "Absent"]).select(
        "event_id", F.col("Comm Time").alias("comm_time"), F.col("\"k\"").alias("k"),
        F.col("Absent").alias("absent"))


def bench_timing_summary(spark, folder):
    """Events as step timings of the users' ranks, in whole hundredths."""
    steps = table(spark, folder, "events").select(
        F.col("user_id").alias("rank"), F.round(F.col("value") * 100).alias("compute_ms"),
        F.length("props").cast("double").alias("comm_ms"))
    return _rounded(bench.timing_summary(steps), "avg_compute_ms", "avg_comm_ms", "avg_step_ms", "comm_ratio")


def bench_summary_lines(spark, folder):
    return bench.summary_lines(_runs(spark, folder))


def bench_summary_report(spark, folder):
    return bench.summary_report(_runs(spark, folder))


def bench_json_documents(spark, folder):
    """Readings written as result documents, one JSON text each, and read back by the schema."""
    results = event_results(spark, folder)
    documents = results.select("seq", result_document(F.create_map(
        F.lit("host"), (F.col("seq") % 7).cast("string"))).alias("document"))
    return parse_documents(documents, "document", "seq").select(
        "seq", "name", "real_time", "cpu_time", F.col("context")["host"].alias("host"), "place")


def bench_csv_lines(spark, folder):
    """Readings written as CSV text and read back by the schema."""
    results = event_results(spark, folder)
    fields = ("name", "real_time", "cpu_time")
    lines = results.select("seq", F.to_csv(F.struct(*fields)).alias("line"))
    return lines.select("seq", F.from_csv("line", "name string, real_time double, cpu_time double").alias("r")).select(
        "seq", *[f"r.{f}" for f in fields])


QUERIES = {f.__name__: f for f in (
    bench_parse_names, bench_by_configuration, bench_time_table, bench_speedups,
    bench_speedups_by_size, bench_comm_and_compute, bench_comm_overhead, bench_scalability,
    bench_speedup_statistics, bench_verdict, bench_summary, bench_implementations, bench_efficiency,
    bench_name_filter, bench_report_metric, bench_timing_summary, bench_summary_lines,
    bench_summary_report, bench_json_documents, bench_csv_lines)}

_IMPL = """CASE WHEN user_id % 23 = 3 THEN 'OtherSnp' ELSE CASE event_type WHEN 'view' THEN 'CpuSnp' WHEN 'click' THEN 'CudaSnp'
    WHEN 'purchase' THEN 'SparseCudaSnp' WHEN 'signup' THEN 'NaiveCudaMpiSnp' ELSE 'CudaMpiSnp' END END"""
_KNOWN = "impl <> 'OtherSnp'"
_RESULTS = f"""WITH res AS (
  SELECT event_id AS seq, {_IMPL} AS impl, CASE WHEN user_id % 17 = 5 THEN 'AnArrangementWithAVeryLongName'
              ELSE ['Random', 'Sorted', 'Reverse'][user_id % 3 + 1] END AS dist,
         100 * (user_id // 3 + 1) AS size, 100 * (user_id // 3 + 1) AS max_value,
         user_id % 29 = 7 AS broken, value AS real_time, value * 2 AS cpu_time,
         CASE WHEN event_type IN ('signup', 'error') AND user_id % 4 <> 0
              THEN CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) * 0.0625 ELSE 0 END AS comm_time,
         CASE WHEN event_type IN ('signup', 'error') THEN value * 0.5 ELSE 0 END AS compute_time,
         CASE WHEN event_type IN ('signup', 'error') THEN 4 ELSE 1 END AS procs
  FROM events),
runs AS (SELECT * EXCLUDE (broken) FROM res WHERE NOT broken),
cfg AS (SELECT size, max_value, dist, impl, count(*) AS readings, arg_max(real_time, seq) AS real_time,
               arg_max(cpu_time, seq) AS cpu_time, arg_max(comm_time, seq) AS comm_time,
               arg_max(compute_time, seq) AS compute_time, arg_max(procs, seq) AS procs
        FROM runs GROUP BY ALL),
base AS (SELECT size, max_value, dist, real_time AS base_time FROM cfg WHERE impl = 'CpuSnp' AND real_time > 0),
sp AS (SELECT size, max_value, dist, impl, procs, real_time, base_time / real_time AS speedup
       FROM cfg JOIN base USING (size, max_value, dist) WHERE impl <> 'CpuSnp' AND real_time > 0)"""
_NAMES = ("CpuSnp", "CudaSnp", "SparseCudaSnp", "NaiveCudaMpiSnp", "CudaMpiSnp")
_PIVOT = ", ".join(f"coalesce(max(real_time) FILTER (impl = '{n}'), 0) AS {n}" for n in _NAMES)
_LABEL = """CASE impl WHEN 'CpuSnp' THEN 'CPU' WHEN 'CudaSnp' THEN 'CUDA' WHEN 'SparseCudaSnp' THEN 'Sparse CUDA'
    WHEN 'NaiveCudaMpiSnp' THEN 'Naive CUDA+MPI' ELSE 'Optimized CUDA+MPI' END"""
_ORDER = f"CAST(list_position({list(_NAMES)}, impl) AS INTEGER)"


def _pad(text, width):
    return f"CASE WHEN length({text}) >= {width} THEN {text} ELSE rpad({text}, {width}, ' ') END"


_CELLS = " || ' ' || ".join(
    _pad(f"(CASE WHEN {n} <> 0 THEN printf('%.2f', {n}) || ' ms' ELSE 'N/A' END)", 15) for n in _NAMES)
_SPEEDS = " || ' ' || ".join(
    f"CASE WHEN {n} > 0 AND CpuSnp > 0 THEN printf('%.2f', CpuSnp / {n}) || 'x          ' "
    f"ELSE 'N/A            ' END" for n in _NAMES[1:])
_LINES = f"""{_RESULTS},
p AS (SELECT size, max_value, dist, {_PIVOT} FROM cfg GROUP BY 1, 2, 3),
lines AS (SELECT size, max_value, dist,
  {_pad("(size || '/' || dist)", 30)} || ' ' || {_CELLS} || ' ' || {_SPEEDS} AS line FROM p)"""
_RULE, _DASH = "=" * 120, "-" * 120
_LABELS = ("CPU", "CUDA", "Sparse CUDA", "Naive CUDA+MPI", "Optimized CUDA+MPI")
_HEAD = f"{'Config':<30}" + "".join(f" {x:<15}" for x in _LABELS) + "".join(
    " CUDA Spd:<15| Sparse CUDA Sp| Naive CUDA+MPI| Optimized CUDA".split("|"))


def _fixed(part, lines):
    rows = ", ".join(f"({k}, '{x}')" for k, x in enumerate(lines))
    return (f"SELECT {part} AS part, line_no, CAST(NULL AS BIGINT) AS size, CAST(NULL AS BIGINT) AS max_value, "
            f"CAST(NULL AS VARCHAR) AS dist, line FROM (VALUES {rows}) t(line_no, line)")


_NUMBER = "printf('%.2f', {})"
_STATS = ["l || ':'", *(f"'  {name:<9}' || {_NUMBER.format(c)} || '{unit}'" for name, c, unit in (
    ("Average:", "av", "x"), ("Median:", "md", "x"), ("Min:", "mn", "x"), ("Max:", "mx", "x"), ("StdDev:", "sd", ""))), "''"]
_REPORT = f"""{_LINES},
st AS (SELECT {_ORDER} AS o, {_LABEL} AS l, avg(speedup) AS av, median(speedup) AS md, min(speedup) AS mn,
              max(speedup) AS mx, stddev_pop(speedup) AS sd FROM sp WHERE {_KNOWN} GROUP BY impl),
g AS (SELECT avg(speedup) FILTER (impl = 'CudaMpiSnp') / avg(speedup) FILTER (impl = 'NaiveCudaMpiSnp') AS r FROM sp)
{_fixed(1, [_RULE, "SNP SORT BENCHMARK SUMMARY REPORT", _RULE, "", "DETAILED RESULTS", _DASH, _HEAD, _DASH])}
UNION ALL SELECT 2, 0, size, max_value, dist, line FROM lines
UNION ALL {_fixed(3, ["", _RULE, "SUMMARY STATISTICS", _RULE, "", "Speedup vs CPU:", ""])}
UNION ALL {" UNION ALL ".join(f"SELECT 4, o * 10 + {k}, NULL, NULL, NULL, {x} FROM st" for k, x in enumerate(_STATS))}
UNION ALL SELECT 5, 0, NULL, NULL, NULL, 'Optimization Improvement:'
UNION ALL SELECT 5, 1, NULL, NULL, NULL, '  Optimized CUDA+MPI is ' || printf('%.2f', r)
  || 'x faster than Naive CUDA+MPI on average' FROM g
UNION ALL SELECT 5, 2, NULL, NULL, NULL, ''
UNION ALL {_fixed(6, [_RULE])}"""

ORACLES = {
    "bench_parse_names": f"""{_RESULTS}
SELECT seq, CASE WHEN NOT broken THEN impl END AS impl, CASE WHEN NOT broken THEN dist END AS dist,
       CASE WHEN NOT broken THEN size END AS size, CASE WHEN NOT broken THEN max_value END AS max_value,
       CASE WHEN NOT broken THEN impl END AS old_impl, CASE WHEN NOT broken THEN dist END AS old_dist,
       CASE WHEN NOT broken THEN size END AS old_size FROM res""",
    "bench_by_configuration": f"{_RESULTS} SELECT * FROM cfg",
    "bench_time_table": f"{_RESULTS} SELECT size, max_value, dist, {_PIVOT} FROM cfg GROUP BY 1, 2, 3",
    "bench_speedups": f"{_RESULTS} SELECT size, max_value, dist, impl, speedup FROM sp",
    "bench_speedups_by_size": f"""{_RESULTS},
l AS (SELECT dist, size, impl, arg_max(real_time, seq) AS t FROM runs GROUP BY ALL)
SELECT a.dist, a.size, a.impl, b.t / a.t AS speedup FROM l a JOIN l b USING (dist, size)
WHERE b.impl = 'CpuSnp' AND a.impl <> 'CpuSnp'""",
    "bench_comm_and_compute": f"""{_RESULTS}
SELECT size, max_value, dist,
       coalesce(max(comm_time) FILTER (impl = 'NaiveCudaMpiSnp'), 0) AS naive_comm,
       coalesce(max(compute_time) FILTER (impl = 'NaiveCudaMpiSnp'), 0) AS naive_compute,
       coalesce(max(comm_time) FILTER (impl = 'CudaMpiSnp'), 0) AS optimised_comm,
       coalesce(max(compute_time) FILTER (impl = 'CudaMpiSnp'), 0) AS optimised_compute
FROM cfg GROUP BY 1, 2, 3""",
    "bench_comm_overhead": f"""{_RESULTS}
SELECT seq, impl, dist, size,
       round(CASE WHEN comm_time > 0 THEN cpu_time - comm_time ELSE cpu_time END, {DIGITS}) AS comp_time,
       round(comm_time / nullif(cpu_time, 0) * 100, {DIGITS}) AS comm_percentage
FROM runs WHERE impl IN ('NaiveCudaMpiSnp', 'CudaMpiSnp')""",
    "bench_scalability": f"""{_RESULTS}
SELECT impl, {_ORDER} AS plot_order, size, real_time, seq FROM runs WHERE dist = 'Random' AND {_KNOWN}""",
    "bench_speedup_statistics": f"""{_RESULTS}
SELECT impl, count(*) AS configurations, round(avg(speedup), {DIGITS}) AS average,
       round(median(speedup), {DIGITS}) AS median, round(min(speedup), {DIGITS}) AS minimum,
       round(max(speedup), {DIGITS}) AS maximum, round(stddev_pop(speedup), {DIGITS}) AS deviation
FROM sp WHERE {_KNOWN} GROUP BY impl""",
    "bench_verdict": f"""{_RESULTS},
m AS (SELECT avg(speedup) FILTER (impl = 'NaiveCudaMpiSnp') AS naive,
             avg(speedup) FILTER (impl = 'CudaMpiSnp') AS optimised FROM sp)
SELECT round(naive, {DIGITS}) AS naive, round(optimised, {DIGITS}) AS optimised,
       round(optimised / naive, {DIGITS}) AS improvement,
       CASE WHEN optimised > 1.0 THEN 'faster' ELSE 'not faster' END AS against_baseline,
       CASE WHEN optimised / naive > 1.2 THEN 'improves' ELSE 'minimal' END AS against_naive FROM m""",
    "bench_summary": f"""{_RESULTS}
SELECT {_LABEL} AS label, round(avg(real_time), 2) AS avg_real_ms, round(avg(cpu_time), 2) AS avg_cpu_ms,
       round(CASE WHEN impl LIKE '%Mpi%' THEN avg(comm_time) ELSE 0 END, 2) AS avg_comm_ms,
       round(CASE WHEN impl LIKE '%Mpi%' THEN avg(comm_time) / avg(cpu_time) * 100 ELSE 0 END, 2) AS comm_overhead_pct,
       count(*) AS test_count FROM runs WHERE {_KNOWN} GROUP BY impl""",
    "bench_implementations": f"""{_RESULTS}
SELECT DISTINCT impl, {_LABEL} AS label, {_ORDER} AS plot_order,
       CASE impl WHEN 'CpuSnp' THEN 'baseline' WHEN 'CudaSnp' THEN 'gpu' WHEN 'SparseCudaSnp' THEN 'gpu'
            ELSE 'distributed' END AS category FROM runs WHERE {_KNOWN}""",
    "bench_efficiency": f"""{_RESULTS}
SELECT size, max_value, dist, impl, round(speedup, {DIGITS}) AS speedup,
       round(speedup / procs, {DIGITS}) AS efficiency,
       round(size / (real_time / 1000), {DIGITS}) AS elements_per_second FROM sp""",
    "bench_name_filter": f"""{_RESULTS}
SELECT seq, concat_ws('/', impl, dist, size, max_value, 'iterations:5') AS name FROM runs
WHERE impl LIKE '%Cuda%' AND dist = 'Sorted'""",
    "bench_report_metric": """
SELECT event_id, value AS comm_time, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS k,
       CAST(0 AS DOUBLE) AS absent FROM events""",
    "bench_timing_summary": f"""
WITH r AS (SELECT user_id, count(*) AS steps, sum(round(value * 100)) AS c,
                  sum(CAST(length(props) AS DOUBLE)) AS m FROM events GROUP BY 1),
t AS (SELECT count(*) AS ranks, max(steps) AS steps, avg(c) AS a, avg(m) AS b FROM r)
SELECT ranks, steps, round(a, {DIGITS}) AS avg_compute_ms, round(b, {DIGITS}) AS avg_comm_ms,
       round(a / steps, {DIGITS}) AS avg_step_ms, round(b / (a + 1e-9), {DIGITS}) AS comm_ratio FROM t""",
    "bench_summary_lines": f"{_LINES} SELECT size, max_value, dist, line FROM lines",
    "bench_summary_report": _REPORT,
    "bench_json_documents": f"""{_RESULTS}
SELECT seq, CASE WHEN broken THEN 'broken_' || seq ELSE concat_ws('/', impl, dist, size, max_value, 'iterations:5') END AS name,
       real_time, cpu_time, CAST(seq % 7 AS VARCHAR) AS host, 0 AS place FROM res""",
    "bench_csv_lines": f"""{_RESULTS}
SELECT seq, CASE WHEN broken THEN 'broken_' || seq ELSE concat_ws('/', impl, dist, size, max_value, 'iterations:5') END AS name,
       real_time, cpu_time FROM res""",
}
