"""Explicit schemas of every table the library reads or returns."""

from pyspark.sql import types as T

NEURONS = T.StructType([
    T.StructField("nid", T.LongType(), False),
    T.StructField("initial_spikes", T.LongType(), False),
    T.StructField("is_output", T.BooleanType(), False),
])

RULES = T.StructType([
    T.StructField("nid", T.LongType(), False),
    T.StructField("rule_idx", T.IntegerType(), False),
    T.StructField("threshold", T.IntegerType(), False),
    T.StructField("consumed", T.IntegerType(), False),
    T.StructField("produced", T.IntegerType(), False),
    T.StructField("delay", T.IntegerType(), False),
])

SYNAPSES = T.StructType([
    T.StructField("source_id", T.LongType(), False),
    T.StructField("dest_id", T.LongType(), False),
    T.StructField("weight", T.IntegerType(), False),
])

STATE_COLUMNS = ("spikes", "timer", "is_open", "pending")

MATRIX = T.StructType([
    T.StructField("i", T.LongType(), False),
    T.StructField("j", T.LongType(), False),
    T.StructField("v", T.DoubleType(), False),
])

BENCH_RUNS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("real_time", T.DoubleType()),
    T.StructField("cpu_time", T.DoubleType()),
    T.StructField("Comm_ms", T.DoubleType()),
    T.StructField("ComputeTime_ms", T.DoubleType()),
    T.StructField("Size", T.DoubleType()),
    T.StructField("Procs", T.DoubleType()),
])

BENCH_FILE = T.StructType([
    T.StructField("context", T.MapType(T.StringType(), T.StringType())),
    T.StructField("benchmarks", T.ArrayType(BENCH_RUNS)),
])
