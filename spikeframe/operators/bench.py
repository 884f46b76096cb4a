"""Analytics over benchmark results.

A run table has (seq, impl, dist, size, max_value, real_time, cpu_time, comm_time,
compute_time, procs); ``seq`` is the order of the readings, and where one reading per
configuration is needed the last one counts.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import extract_metric, int_div, parse_run_name, two_decimals
from ..functions.scans import ranked

# Implementation names, labels, plot order and roles.
IMPLEMENTATIONS = (
    ("CpuSnp", "CPU", 1, "baseline", False),
    ("CudaSnp", "CUDA", 2, "gpu", False),
    ("SparseCudaSnp", "Sparse CUDA", 3, "gpu", False),
    ("NaiveCudaMpiSnp", "Naive CUDA+MPI", 4, "distributed", True),
    ("CudaMpiSnp", "Optimized CUDA+MPI", 5, "distributed", True),
)
BASELINE = "CpuSnp"
NAIVE, OPTIMISED = "NaiveCudaMpiSnp", "CudaMpiSnp"
DEFAULT_DISTRIBUTION = "Random"
CONFIG = ["size", "max_value", "dist"]
RATIO_GUARD = 1e-9


def implementation_info(column, value) -> Column:
    """Label, order, category or has_comm of a known implementation, NULL otherwise."""
    place = {"label": 1, "order": 2, "category": 3, "has_comm": 4}[value]
    cases = [F.when(F.col(column) == row[0], F.lit(row[place])) for row in IMPLEMENTATIONS]
    return F.coalesce(*cases)


def known(column="impl") -> Column:
    return F.col(column).isin([row[0] for row in IMPLEMENTATIONS])


def runs_from(results: DataFrame, style="slash", keep=()) -> DataFrame:
    """Parse names, drop what does not fit, and fill optional metrics."""
    have = set(results.columns)

    def optional(name, default):
        return F.coalesce(name, F.lit(default)) if name in have else F.lit(default)

    # as a generator the parse runs once per row: later filters cannot pull copies of it
    # below themselves
    return results.select(
        *(["seq"] if "seq" in have else []), *keep,
        F.inline(F.array_compact(F.array(parse_run_name("name", style)))),
        F.col("real_time").cast("double").alias("real_time"),
        F.col("cpu_time").cast("double").alias("cpu_time"),
        optional("Comm_ms", 0.0).cast("double").alias("comm_time"),
        optional("ComputeTime_ms", 0.0).cast("double").alias("compute_time"),
        optional("Procs", 1).cast("int").alias("procs"))


def filter_names(results: DataFrame, pattern) -> DataFrame:
    return results.where(F.col("name").rlike(pattern))


def by_configuration(runs: DataFrame) -> DataFrame:
    """Readings per configuration and implementation, with the last one's times (B2)."""
    return runs.groupBy(*CONFIG, "impl").agg(
        F.count(F.lit(1)).alias("readings"),
        *[F.max_by(c, "seq").alias(c) for c in ("real_time", "cpu_time", "comm_time",
                                                "compute_time", "procs")])


def time_table(runs: DataFrame) -> DataFrame:
    """Execution time per configuration, one column per known implementation; 0 when it
    has no reading (B4). A configuration that only unknown implementations measured is
    listed too. Conditional aggregates need no extra pass to find the columns."""
    return by_configuration(runs).groupBy(*CONFIG).agg(*[
        F.coalesce(F.max(F.when(F.col("impl") == row[0], F.col("real_time"))), F.lit(0.0)).alias(row[0])
        for row in IMPLEMENTATIONS])


def speedups(runs: DataFrame, baseline=BASELINE) -> DataFrame:
    """Baseline time over implementation time per configuration (B5). The readings were
    already reduced to one per implementation, so no configuration is hot here."""
    last = by_configuration(runs)
    base = last.where(F.col("impl") == baseline).select(*CONFIG, F.col("real_time").alias("base_time"))
    others = last.where((F.col("impl") != baseline) & (F.col("real_time") > 0))
    return others.join(base.where("base_time > 0"), CONFIG).select(
        *CONFIG, "impl", "base_time", "real_time", "procs",
        (F.col("base_time") / F.col("real_time")).alias("speedup"))


def ieee_ratio(above: Column, below: Column) -> Column:
    """Quotient of doubles as IEEE 754 has it: infinite or NaN over zero, where Spark's is NULL or an error."""
    # texts tell -0.0 from 0.0, which compare as equal
    negative = (above < 0) != F.startswith(below.cast("string"), F.lit("-"))
    over_zero = F.when((above == 0) | F.isnan(above), F.lit(math.nan)).otherwise(
        F.when(negative, F.lit(-math.inf)).otherwise(F.lit(math.inf)))
    return F.when(below != 0, F.try_divide(above, below)).when(above.isNotNull() & below.isNotNull(), over_zero)


def speedups_by_size(runs: DataFrame, baseline=BASELINE) -> DataFrame:
    """Speedup with readings matched on pattern and size only (inner merge); infinite or NaN for a time of zero."""
    last = runs.groupBy("dist", "size", "impl").agg(F.max_by("real_time", "seq").alias("real_time"))
    base = last.where(F.col("impl") == baseline).select("dist", "size", F.col("real_time").alias("base_time"))
    return last.where(F.col("impl") != baseline).join(base, ["dist", "size"]).select(
        "dist", "size", "impl", ieee_ratio(F.col("base_time"), F.col("real_time")).alias("speedup"))


def comm_and_compute(runs: DataFrame) -> DataFrame:
    """Communication and compute times of the two distributed implementations."""
    last = by_configuration(runs)

    def of(impl, column):
        return F.coalesce(F.max(F.when(F.col("impl") == impl, F.col(column))), F.lit(0.0))

    return last.groupBy(*CONFIG).agg(
        of(NAIVE, "comm_time").alias("naive_comm"), of(NAIVE, "compute_time").alias("naive_compute"),
        of(OPTIMISED, "comm_time").alias("optimised_comm"),
        of(OPTIMISED, "compute_time").alias("optimised_compute"))


def with_computation(runs: DataFrame) -> DataFrame:
    """cpu time without communication where communication was measured."""
    return runs.withColumn("comp_time", F.when(F.col("comm_time") > 0, F.col("cpu_time") - F.col("comm_time"))
                           .otherwise(F.col("cpu_time")))


def comm_overhead(runs: DataFrame) -> DataFrame:
    """Share of cpu time spent communicating, for implementations that do."""
    return runs.where(F.col("impl").isin([row[0] for row in IMPLEMENTATIONS if row[4]])).withColumn(
        "comm_percentage", F.try_divide("comm_time", "cpu_time") * 100)


def scalability(runs: DataFrame, dist=DEFAULT_DISTRIBUTION) -> DataFrame:
    """(impl, plot order, size, time) readings of one distribution."""
    return runs.where((F.col("dist") == dist) & known()).select(
        "impl", implementation_info("impl", "order").alias("plot_order"), "size", "real_time", "seq")


def speedup_statistics(runs: DataFrame, baseline=BASELINE) -> DataFrame:
    """Mean, median, extremes and population deviation per implementation.
    The exact median comes from a distributed ranking, not from collected groups."""
    found = speedups(runs, baseline).where(known())
    placed = ranked(found.select("impl", "speedup", *CONFIG), ["impl", "speedup", *CONFIG], "at")
    stats = placed.groupBy("impl").agg(
        F.count(F.lit(1)).alias("configurations"), F.min("at").alias("head"),
        F.avg("speedup").alias("average"), F.min("speedup").alias("minimum"),
        F.max("speedup").alias("maximum"), F.stddev_pop("speedup").alias("deviation"))
    inside, n = F.col("at") - F.col("head"), F.col("configurations")
    # one row per known implementation
    middle = (placed.join(F.broadcast(stats.select("impl", "head", "configurations")), "impl")
              .where(inside.isin(int_div(n - 1, 2), int_div(n, 2)))
              .groupBy("impl").agg(F.avg("speedup").alias("median")))
    return stats.join(F.broadcast(middle), "impl").select(
        "impl", "configurations", "average", "median", "minimum", "maximum", "deviation")


def optimisation_verdict(runs: DataFrame, baseline=BASELINE) -> DataFrame:
    """Mean speedups of both distributed implementations, their ratio, and the two
    recommendations drawn from them (B12)."""
    found = speedups(runs, baseline).agg(
        F.avg(F.when(F.col("impl") == NAIVE, F.col("speedup"))).alias("naive"),
        F.avg(F.when(F.col("impl") == OPTIMISED, F.col("speedup"))).alias("optimised"))
    ratio = F.when(F.col("naive") > 0, F.col("optimised") / F.col("naive")).otherwise(
        F.when(F.col("optimised").isNotNull() & F.col("naive").isNotNull(), F.lit(0.0)))
    return found.select(
        "naive", "optimised", ratio.alias("improvement"),
        F.when(F.col("optimised") > 1.0, "faster").when(F.col("optimised") <= 1.0, "not faster")
         .alias("against_baseline"),
        F.when(ratio > 1.2, "improves").when(ratio <= 1.2, "minimal").alias("against_naive"))


def implementation_summary(runs: DataFrame) -> DataFrame:
    """Averages and communication overhead per known implementation, 2 decimals."""
    label, comm = implementation_info("impl", "label"), implementation_info("impl", "has_comm")
    means = runs.where(known()).groupBy("impl").agg(
        F.avg("real_time").alias("r"), F.avg("cpu_time").alias("c"), F.avg("comm_time").alias("m"),
        F.count(F.lit(1)).alias("test_count"))
    return means.select(
        label.alias("label"), F.round("r", 2).alias("avg_real_ms"), F.round("c", 2).alias("avg_cpu_ms"),
        F.round(F.when(comm, F.col("m")).otherwise(0.0), 2).alias("avg_comm_ms"),
        F.round(F.when(comm, F.try_divide("m", "c") * 100).otherwise(0.0), 2).alias("comm_overhead_pct"),
        "test_count")


def configured_implementations(runs: DataFrame) -> DataFrame:
    """Known implementations present in the data with label and plot order."""
    present = runs.where(known()).select("impl").distinct()
    return present.select("impl", implementation_info("impl", "label").alias("label"),
                          implementation_info("impl", "order").alias("plot_order"),
                          implementation_info("impl", "category").alias("category"))


def efficiency(runs: DataFrame, baseline=BASELINE) -> DataFrame:
    """Speedup per process and elements sorted per second."""
    return speedups(runs, baseline).select(
        *CONFIG, "impl", "speedup", (F.col("speedup") / F.col("procs")).alias("efficiency"),
        (F.col("size") / (F.col("real_time") / 1000)).alias("elements_per_second"))


def padded(text, width) -> Column:
    """Text filled with blanks to a width; longer text stays whole."""
    text = F.lit(text) if isinstance(text, str) else text
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, " "))


def _present(runs: DataFrame) -> Column:
    """Known implementations that have a reading, as one array for the whole plan."""
    return runs.where(known()).agg(F.collect_set("impl")).scalar()


def summary_lines(runs: DataFrame, baseline=BASELINE) -> DataFrame:
    """One text line per configuration: label, times of the implementations that occur at
    all, and their speedups (the body of the summary report)."""
    table = time_table(runs).withColumn("_present", _present(runs))
    base = F.col(baseline)

    def time_cell(impl):
        return F.when(F.col(impl) != 0, F.concat(two_decimals(impl), F.lit(" ms"))).otherwise("N/A")

    def speed_cell(impl):
        fast = F.concat(two_decimals(F.try_divide(base, F.col(impl))), F.lit("x" + " " * 10))
        return F.when((F.col(impl) > 0) & (base > 0), fast).otherwise(padded("N/A", 15))

    def cell(impl, text):
        there = F.array_contains("_present", impl)
        return F.when(there, F.concat(F.lit(" "), text)).otherwise("")

    names = [row[0] for row in IMPLEMENTATIONS]
    cells = [padded(F.concat_ws("/", F.col("size"), F.col("dist")), 30)]
    cells += [cell(n, padded(time_cell(n), 15)) for n in names]
    cells += [cell(n, speed_cell(n)) for n in names if n != baseline]
    return table.select(*CONFIG, F.concat(*cells).alias("line"))


def summary_report(runs: DataFrame, baseline=BASELINE) -> DataFrame:
    """The whole text report as rows (part, line_no, size, max_value, dist, line), to be read in
    that order: title, header, one line per configuration, statistics per implementation."""
    spark, rule = runs.sparkSession, "=" * 120
    others = [row for row in IMPLEMENTATIONS if row[0] != baseline]
    label = next(row[1] for row in IMPLEMENTATIONS if row[0] == baseline)
    heads = [padded("Config", 30)]
    heads += [F.when(F.array_contains("_present", row[0]), F.concat(F.lit(" "), padded(row[1], 15))).otherwise("")
              for row in IMPLEMENTATIONS]
    heads += [F.when(F.array_contains("_present", row[0]), f" {row[1]} Spd:<15"[:15]).otherwise("") for row in others]
    title = [rule, "SNP SORT BENCHMARK SUMMARY REPORT", rule, "", "DETAILED RESULTS", "-" * 120, None, "-" * 120]
    blank = (F.lit(None).cast("bigint").alias("size"), F.lit(None).cast("bigint").alias("max_value"),
             F.lit(None).cast("string").alias("dist"))

    def fixed(part, lines):
        rows = spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")
        return rows.select(F.lit(part).alias("part"), "line_no", *blank, "line")

    head = fixed(1, title).withColumn("_present", _present(runs)).withColumn(
        "line", F.coalesce("line", F.concat(*heads))).drop("_present")
    body = summary_lines(runs, baseline).select(F.lit(2).alias("part"), F.lit(0).alias("line_no"), *CONFIG, "line")
    stats = speedup_statistics(runs, baseline)
    order = implementation_info("impl", "order")

    def number(name, column, unit):
        return F.concat(F.lit(f"  {name:<9}"), two_decimals(column), F.lit(unit))

    lines = F.array(
        F.concat(implementation_info("impl", "label"), F.lit(":")), number("Average:", "average", "x"),
        number("Median:", "median", "x"), number("Min:", "minimum", "x"), number("Max:", "maximum", "x"),
        number("StdDev:", "deviation", ""), F.lit(""))
    listed = stats.select(order.alias("_order"), F.posexplode(lines).alias("_at", "line")).select(
        F.lit(4).alias("part"), (F.col("_order") * 10 + F.col("_at")).alias("line_no"), *blank, "line")
    gain = optimisation_verdict(runs, baseline).where("improvement IS NOT NULL").select(F.posexplode(F.array(
        F.lit("Optimization Improvement:"),
        F.concat(F.lit("  Optimized CUDA+MPI is "), two_decimals("improvement"),
                 F.lit("x faster than Naive CUDA+MPI on average")), F.lit(""))).alias("line_no", "line")).select(
        F.lit(5).alias("part"), "line_no", *blank, "line")
    parts = [head, body, fixed(3, ["", rule, "SUMMARY STATISTICS", rule, "", f"Speedup vs {label}:", ""]), listed,
             gain, fixed(6, [rule])]
    return reduce(lambda x, y: x.unionByName(y), parts)


def report_metrics(reports: DataFrame, column, keys) -> DataFrame:
    """Numbers that follow the given keys in text reports."""
    return reduce(lambda df, key: df.withColumn(key, extract_metric(column, key)), keys, reports)


def timing_summary(steps: DataFrame) -> DataFrame:
    """Per rank step timings (rank, compute_ms, comm_ms) to totals, average per step and
    the communication to computation ratio of the rank means (B16)."""
    ranks = steps.groupBy("rank").agg(F.count(F.lit(1)).alias("steps"), F.sum("compute_ms").alias("compute"),
                                      F.sum("comm_ms").alias("comm"))
    means = ranks.agg(F.count(F.lit(1)).alias("ranks"), F.max("steps").alias("steps"),
                      F.avg("compute").alias("avg_compute_ms"), F.avg("comm").alias("avg_comm_ms"))
    return means.select("*", F.try_divide("avg_compute_ms", "steps").alias("avg_step_ms"),
                        (F.col("avg_comm_ms") / (F.col("avg_compute_ms") + RATIO_GUARD)).alias("comm_ratio"))
