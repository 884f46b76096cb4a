import json

import pytest

from spikeframe.functions.columns import extract_metric, parse_run_name
from spikeframe.operators import bench
from spikeframe.sources.results import read_results, with_sequence, write_results

READINGS = [
    {"name": "CpuSnp/Random/100/100/iterations:25", "real_time": 10.0, "cpu_time": 9.0},
    {"name": "CpuSnp/Random/100/100/iterations:25", "real_time": 8.0, "cpu_time": 7.0},
    {"name": "NaiveCudaMpiSnp/Random/100/100", "real_time": 4.0, "cpu_time": 4.0, "Comm_ms": 1.0, "Procs": 2},
    {"name": "CudaMpiSnp/Random/100/100", "real_time": 2.0, "cpu_time": 2.0, "Comm_ms": 0.5, "Procs": 2},
    {"name": "CudaMpiSnp/Sorted/1000/1000", "real_time": 3.0, "cpu_time": 5.0},
    {"name": "CpuSnp/Sorted/1000/1000", "real_time": 30.0, "cpu_time": 30.0},
    {"name": "CudaMpiSnp/Reverse/1000/1000", "real_time": 3.0, "cpu_time": 5.0},
    {"name": "Mystery/Random/100/100", "real_time": 1.0, "cpu_time": 1.0},
    {"name": "CpuSnp/Random/big/100", "real_time": 1.0, "cpu_time": 1.0},
    {"name": "nothing", "real_time": 1.0, "cpu_time": 1.0},
]


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("results") / "run.json"
    path.write_text(json.dumps({"context": {"host_name": "h", "num_cpus": 8}, "benchmarks": READINGS}, indent=1))
    return with_sequence(read_results(spark, str(path)))


@pytest.fixture(scope="module")
def runs(results):
    return bench.runs_from(results).cache()


def test_reading_and_defaults(results, runs):
    assert results.count() == len(READINGS) and results.first().context["host_name"] == "h"
    assert runs.count() == 8
    cpu = runs.where("impl = 'CpuSnp' and dist = 'Sorted'").first()
    assert (cpu.size, cpu.max_value, cpu.comm_time, cpu.compute_time, cpu.procs) == (1000, 1000, 0.0, 0.0, 1)


def test_names(spark):
    names = ["CpuSnp/Random/10/20", "a/b/1", "a/b/x/2", "Cpu_10_20_few_unique/x", "Cpu_10", " /d/ 7 /8/z"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    new = [r[0] for r in df.select(parse_run_name("name")).collect()]
    assert [tuple(r) if r else None for r in new] == [
        ("CpuSnp", "Random", 10, 20), None, None, None, None, (" ", "d", 7, 8)]
    old = [r[0] for r in df.select(parse_run_name("name", "underscore")).collect()]
    assert [tuple(r) if r else None for r in old] == [None, None, None, ("Cpu", "few_unique", 10, 20), None, None]
    with pytest.raises(ValueError):
        parse_run_name("name", "dots")


def test_tables(runs):
    table = {(r["size"], r.dist): r for r in bench.time_table(runs).collect()}
    assert table[100, "Random"].CpuSnp == 8.0 and table[100, "Random"].CudaSnp == 0.0
    assert table[1000, "Reverse"].CpuSnp == 0.0 and len(table) == 3
    speed = {(r.dist, r.impl): r.speedup for r in bench.speedups(runs).collect()}
    assert speed == {("Random", "NaiveCudaMpiSnp"): 2.0, ("Random", "CudaMpiSnp"): 4.0, ("Random", "Mystery"): 8.0,
                     ("Sorted", "CudaMpiSnp"): 10.0}
    merged = {(r.dist, r.impl): r.speedup for r in bench.speedups_by_size(runs).collect()}
    assert merged == speed
    both = {r.dist: r for r in bench.comm_and_compute(runs).collect()}
    assert (both["Random"].naive_comm, both["Random"].optimised_comm, both["Sorted"].naive_comm) == (1.0, 0.5, 0.0)


def test_speedups_by_size_over_a_time_of_zero(spark):
    rows = [(1, 2.0, 0.0, "inf"), (2, 0.0, 0.0, "nan"), (3, -2.0, 0.0, "-inf"), (4, 2.0, -0.0, "-inf"), (5, None, 0.0, "None"),
            (6, 3.0, 2.0, "1.5"), (7, -2.0, -0.0, "inf"), (8, 0.0, 2.0, "0.0")]
    times = [(2 * k, "CpuSnp", k, base) for k, base, _, _ in rows] + [(2 * k + 1, "CudaSnp", k, own) for k, _, own, _ in rows]
    runs = spark.createDataFrame(times, "seq long, impl string, size long, real_time double").selectExpr("*", "'Random' as dist")
    assert {r["size"]: str(r.speedup) for r in bench.speedups_by_size(runs).collect()} == {k: shown for k, _, _, shown in rows}


def test_statistics(runs):
    stats = {r.impl: r for r in bench.speedup_statistics(runs).collect()}
    assert set(stats) == {"NaiveCudaMpiSnp", "CudaMpiSnp"}
    row = stats["CudaMpiSnp"]
    assert (row.configurations, row.average, row["median"], row.minimum, row.maximum, row.deviation) == (
        2, 7.0, 7.0, 4.0, 10.0, 3.0)
    verdict = bench.optimisation_verdict(runs).first()
    assert (verdict.naive, verdict.optimised, verdict.improvement) == (2.0, 7.0, 3.5)
    assert (verdict.against_baseline, verdict.against_naive) == ("faster", "improves")


def test_projections(runs):
    comp = {(r.impl, r.dist): r.comp_time for r in bench.with_computation(runs.where("size = 100")).collect()}
    assert comp["NaiveCudaMpiSnp", "Random"] == 3.0
    share = {(r.impl, r.dist): r.comm_percentage for r in bench.comm_overhead(runs).collect()}
    assert share["CudaMpiSnp", "Random"] == 25.0 and ("CpuSnp", "Random") not in share
    series = bench.scalability(runs).orderBy("plot_order", "seq").collect()
    assert [r.impl for r in series] == ["CpuSnp", "CpuSnp", "NaiveCudaMpiSnp", "CudaMpiSnp"]
    summary = {r.label: r for r in bench.implementation_summary(runs).collect()}
    assert summary["CPU"].avg_real_ms == 16.0 and summary["CPU"].avg_comm_ms == 0.0
    assert summary["Naive CUDA+MPI"].comm_overhead_pct == 25.0
    known = bench.configured_implementations(runs).orderBy("plot_order").collect()
    assert [r.category for r in known] == ["baseline", "distributed", "distributed"]
    eff = {(r.impl, r.dist): r.efficiency for r in bench.efficiency(runs).collect()}
    assert eff["CudaMpiSnp", "Random"] == 2.0


def test_missing_baseline(runs):
    none = runs.where("impl <> 'CpuSnp'")
    assert bench.speedups(none).count() == 0
    verdict = bench.optimisation_verdict(none).first()
    assert verdict.naive is None and verdict.improvement is None and verdict.against_naive is None


def test_report_text(spark, runs):
    lines = [r.line for r in bench.summary_lines(runs).orderBy("size", "dist").collect()]
    assert lines[0].startswith("100/Random") and "8.00 ms" in lines[0] and "4.00x" in lines[0]
    reports = spark.createDataFrame([("Avg Comm Time (MPI):    1.25e1 ms",), ("none",), ("Comm Time: x",)], "r string")
    got = [r[0] for r in reports.select(extract_metric("r", "Comm Time")).collect()]
    assert got == [12.5, 0.0, 0.0]
    steps = spark.createDataFrame([(0, 1.0, 2.0), (0, 3.0, 2.0), (1, 2.0, 0.0), (1, 2.0, 0.0)],
                                  "rank int, compute_ms double, comm_ms double")
    row = bench.timing_summary(steps).first()
    assert (row.ranks, row.steps, row.avg_compute_ms, row.avg_comm_ms, row.avg_step_ms) == (2, 2, 4.0, 2.0, 2.0)
    assert abs(row.comm_ratio - 0.5) < 1e-6


def test_sinks(spark, runs, tmp_path):
    times = runs.select("impl", "size", "real_time")
    for fmt in ("json", "csv"):
        write_results(times, str(tmp_path / fmt), fmt)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 8 == spark.read.json(str(tmp_path / "json")).count()
    assert bench.filter_names(spark.createDataFrame([("CpuSnp/a",), ("x",)], "name string"), "^Cpu").count() == 1


def test_report_rows_are_whole(spark):
    long = "x" * 40
    runs = bench.runs_from(spark.createDataFrame([
        (1, f"CpuSnp/{long}/100/100", 12345678901234567.0, 1.0), (2, f"CudaSnp/{long}/100/100", 2.0, 1.0),
        (3, "Other/Random/5/5", 1.0, 1.0)], "seq long, name string, real_time double, cpu_time double"))
    table = {r.dist: r for r in bench.time_table(runs).collect()}
    assert table["Random"].CpuSnp == 0 and table["Random"].CudaSnp == 0  # measured by an unknown one only
    lines = {r.dist: r.line for r in bench.summary_lines(runs).collect()}
    assert lines[long] == (f"100/{long} 12345678901234568.00 ms {'2.00 ms':<15} 6172839450617284.00x" + " " * 10)
    assert lines["Random"] == f"{'5/Random':<30} {'N/A':<15} {'N/A':<15} {'N/A':<15}"
    report = bench.summary_report(runs).orderBy("part", "line_no", "size", "max_value", "dist").collect()
    assert [r.line for r in report if r.part == 1][6] == f"{'Config':<30} {'CPU':<15} {'CUDA':<15} CUDA Spd:<15"
    assert [r.line for r in report if r.part == 4][:2] == ["CUDA:", "  Average: 6172839450617284.00x"]
