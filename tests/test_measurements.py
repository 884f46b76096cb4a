"""Result documents as a data source, streamed readings, sketches and bootstrap bounds."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spikeframe.operators import bench, confidence, quantiles
from spikeframe.sources import result_source
from spikeframe.sources.result_source import scan_results
from spikeframe.streaming import readings


@pytest.fixture
def results(tmp_path):
    for impl in ("CpuSnp", "CudaSnp"):
        (tmp_path / impl).mkdir()
        for k in range(5):
            document = {"context": {"host": "h1", "cpus": 8}, "benchmarks": [
                {"name": f"{impl}/Random/{100 * (k + 1)}/100/iterations:5", "real_time": k + j, "cpu_time": 2 * k, "Procs": 4}
                for j in range(3)]}
            (tmp_path / impl / f"run{k}.json").write_text(json.dumps(document, indent=1))
    return tmp_path


def test_documents_are_read(spark, results):
    rows = scan_results(spark, f"file://{results}").collect()
    assert len(rows) == 30 and {r.context["cpus"] for r in rows} == {"8"} and {r.place for r in rows} == {0, 1, 2}
    assert {r.Comm_ms for r in rows} == {None} and {r.Procs for r in rows} == {4.0}
    (results / "CpuSnp" / "two.json").write_text('{"benchmarks": [{"name": "a"}]}\n{"benchmarks": []} {"benchmarks": [{}]}')
    assert scan_results(spark, str(results)).count() == 32
    assert scan_results(spark, str(results / "CpuSnp" / "run0.json")).count() == 3


def test_files_are_skipped_before_they_are_parsed(spark, results):
    (results / "CpuSnp" / "broken.json").write_text("{no json")
    with pytest.raises(Exception, match="JSONDecodeError|Expecting"):
        scan_results(spark, str(results)).count()
    by_file = scan_results(spark, str(results)).where(F.col("file").startswith("CudaSnp/"))
    assert by_file.count() == 15
    by_name = scan_results(spark, str(results)).where(F.col("name").startswith("CudaSnp/Random/100/"))
    assert [r.real_time for r in by_name.orderBy("real_time").collect()] == [0.0, 1.0, 2.0]
    plan = by_file._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (" not in plan  # the listing answers it
    assert "Filter (" in by_name._jdf.queryExecution().executedPlan().toString()


def test_pushed_filters_select_files(spark, results):
    reader = result_source.ResultReader(None, {"path": str(results), "group_bytes": "1"})
    ds = result_source.ds
    left = list(reader.pushFilters([ds.EqualTo(("file",), "CpuSnp/run1.json"), ds.In(("name",), ("x", "CpuSnp/Random")),
                                    ds.GreaterThan(("place",), 1)]))
    assert [type(f) for f in left] == [ds.In, ds.GreaterThan]
    assert [p.names for p in reader.partitions()] == [["CpuSnp/run1.json"]]
    assert reader.may_hold(b'"CpuSnp/Random/"') and not reader.may_hold(b"CudaSnp") and reader.may_hold(b"a\\/b")
    whole = result_source.ResultReader(None, {"path": str(results), "group_bytes": "1"})
    assert len(whole.partitions()) == 10
    assert len(result_source.ResultReader(None, {"path": str(results)}).partitions()) == 1


def test_stream_restarts_after_any_batch(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(k, f"CpuSnp/Random/{rnd.randrange(3)}00/100/x" if k % 9 else "broken", float(k), k / 2, k * 3600)
            for k in range(240)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "seq long, name string, real_time double, cpu_time double, t long").select(
        "seq", "name", "real_time", "cpu_time", F.timestamp_seconds("t").alias("ts"))
    parts = df.randomSplit([1.0] * 3, 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for part in parts:  # each round starts a new query from the checkpoint of the one before
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        readings.process_available(readings.latest_readings(stream, "ts", "300 days"), f"{tmp_path}/state", f"{tmp_path}/out")
    got = readings.current(spark, f"{tmp_path}/out")
    want = bench.by_configuration(bench.runs_from(df))
    keys = ["size", "max_value", "dist", "impl", "readings", "real_time", "cpu_time", "procs"]
    assert sorted(map(tuple, got.select(*keys).collect())) == sorted(map(tuple, want.select(*keys).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def ranks_within(values, answer, rank, error):
    below, upto = (values < answer).sum(), (values <= answer).sum()
    return below - error < rank <= upto + error


@pytest.mark.parametrize("kind", ["random", "sorted", "reverse", "ties", "few"])
def test_sketch_keeps_its_certificate(kind):
    rng = np.random.default_rng(3)
    values = {"random": rng.normal(size=40_000), "sorted": np.arange(40_000.0), "reverse": -np.arange(40_000.0),
              "ties": rng.integers(0, 5, 40_000).astype(float), "few": np.array([3.0, 1.0, 2.0])}[kind]
    parts = []
    for chunk in np.array_split(values, 17):
        parts.append(quantiles.Sketch(128))
        for piece in np.array_split(chunk, 5):
            parts[-1].update(piece)
    whole = quantiles.Sketch(128)
    for part in parts:
        whole.merge(*part.row())
    assert whole.n == len(values) and whole.low == values.min() and whole.high == values.max()
    assert sum(len(v) << level for level, v in enumerate(whole.levels)) == len(values)
    assert whole.error <= 2 * len(values) / 128 * np.log2(max(len(values) / 128, 2))
    entries = sorted((v, 1 << level) for level, level_values in enumerate(whole.levels) for v in level_values)
    upto = np.cumsum([w for _, w in entries])
    for rank in range(1, len(values) + 1, 997):
        answer = entries[int(np.searchsorted(upto, rank))][0]
        assert ranks_within(values, answer, rank, whole.error)


def test_sketches_per_key(spark):
    rows = [(f"k{i % 3}" if i % 5 else None, float((i * 7919) % 1000)) for i in range(6000)] + [("k1", None), ("k1", float("nan"))]
    df = spark.createDataFrame(rows, "key string, v double").repartition(7)
    found = quantiles.sketch_quantiles(quantiles.sketches(df, "key", "v", k=64), "key", [0.01, 0.5, 1.0]).collect()
    assert len(found) == 12
    for r in found:
        values = np.array([v for k, v in rows if k == r.key and v is not None and v == v])
        assert r.n == len(values) and ranks_within(values, r.value, int(np.ceil(r.fraction * r.n)), r.error)
    assert quantiles.sketches(df.limit(0), "key", "v").count() == 0


def test_bounds_are_plausible_and_stable(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(300):
        rows += [(2 * k, f"CpuSnp/Random/{k}/1/x", 10.0, 1.0), (2 * k + 1, f"CudaSnp/Random/{k}/1/x", 10.0 / (2 + rng.normal() / 10), 1.0)]
    df = spark.createDataFrame(rows, "seq long, name string, real_time double, cpu_time double")
    got = confidence.speedup_bounds(bench.runs_from(df)).collect()
    assert len(got) == 1 and got[0].configurations == 300
    r = got[0]
    assert r.low < r.mean < r.high and abs(r.mean - 2) < 0.03
    # the bounds' width is about 2 * 1.96 standard errors of the mean
    assert 0.7 < (r.high - r.low) / (3.92 * 0.1 / np.sqrt(300)) < 1.3
    assert confidence.speedup_bounds(bench.runs_from(df.repartition(5))).collect() == got
    weights = spark.range(20000).select(confidence.poisson_weight(F.col("id") * 7 + 13, F.lit(1)).alias("w")).groupBy("w").count()
    share = {r.w: r["count"] / 20000 for r in weights.collect()}
    assert abs(share[0] - 0.368) < 0.02 and abs(share[1] - 0.368) < 0.02 and abs(share[2] - 0.184) < 0.02


def test_replicates_are_made_in_many_tasks(spark):
    rows = [(k, f"{impl}/Random/{k}00/100/x", 1.0 + k, 1.0) for k in range(1, 30) for impl in ("CpuSnp", "CudaSnp")]
    df = spark.createDataFrame(rows, "seq long, name string, real_time double, cpu_time double")
    plan = confidence.speedup_bounds(bench.runs_from(df))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_configurations_share_a_bucket(spark, tmp_path):
    rows = [(k, f"CpuSnp/Random/{k % 7}00/100/x", float(k), 1.0, k + 1) for k in range(100)]
    df = spark.createDataFrame(rows, "seq long, name string, real_time double, cpu_time double, t long").select(
        "seq", "name", "real_time", "cpu_time", F.timestamp_seconds("t").alias("ts"))
    for part in (df.where("seq >= 60"), df.where("seq < 60 and seq % 7 < 3")):
        part.write.mode("append").parquet(f"{tmp_path}/in")  # several files are one batch
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        readings.process_available(readings.latest_readings(stream, "ts", "300 days", 1), f"{tmp_path}/state", f"{tmp_path}/out")
    got = {r["size"]: (r.readings, r.seq, r.real_time) for r in readings.current(spark, f"{tmp_path}/out").collect()}
    arrived = [k for k in range(100) if k >= 60 or k % 7 < 3]
    assert got == {100 * m: (len(own), max(own), float(max(own))) for m in range(7) for own in [[k for k in arrived if k % 7 == m]]}
    assert spark.read.parquet(f"{tmp_path}/out").where("batch = 1").select("size").distinct().count() == 3
