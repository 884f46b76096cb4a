"""Timed sorting runs that produce result rows for the analytics."""

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BENCH_RUNS
from ..session import cut_lineage
from ..sources import generate as gen
from .sort import NetworkSort, counting_sort, is_sorted, sort_native

SEED = 42


@dataclass(frozen=True)
class Case:
    size: int
    max_value: int
    dist: str
    iterations: int = 1


# The three suites (size, largest value, iterations) over three inputs.
_INPUTS = (gen.SORTED, gen.REVERSE_SORTED, gen.RANDOM)
SMALL = tuple(Case(100, 100, d, 25) for d in _INPUTS)
MEDIUM = tuple(Case(1000, 1000, d, 5) for d in _INPUTS)
LARGE = tuple(Case(5000, 5000, d, 5) for d in _INPUTS)


class _Network:
    def load(self, data):
        self.sorter = NetworkSort().load(data)
        return self

    def execute(self):
        return self.sorter.execute()


class _Plan:
    def __init__(self, plan):
        self.plan = plan

    def load(self, data):
        self.data = data
        return self

    def execute(self):
        return cut_lineage(self.plan(self.data))


SORTERS = {
    "Network": _Network,
    "Counting": lambda: _Plan(lambda d: counting_sort(d, "value")),
    "Native": lambda: _Plan(lambda d: sort_native(
        d.select(F.col("pos").alias("_key"), "value"), "value", "_key")),
}


def case_name(sorter, case: Case):
    return f"{sorter}/{case.dist}/{case.size}/{case.max_value}/iterations:{case.iterations}"


def run_case(spark: SparkSession, sorter: str, case: Case):
    """(name, mean wall ms, mean driver cpu ms). Generation and loading are not timed;
    an unsorted output is an error."""
    wall = cpu = 0.0
    for iteration in range(case.iterations):
        data = cut_lineage(gen.generate(spark, case.size, case.max_value, case.dist, SEED + iteration))
        loaded = SORTERS[sorter]().load(data)
        started, used = time.perf_counter(), time.process_time()
        result = loaded.execute()
        wall += (time.perf_counter() - started) * 1000
        cpu += (time.process_time() - used) * 1000
        check = is_sorted(result, "pos", "value").first()
        if not check.is_sorted or check.n != case.size:
            raise AssertionError(f"{case_name(sorter, case)}: output is not sorted")
    return case_name(sorter, case), wall / case.iterations, cpu / case.iterations


def run_suite(spark: SparkSession, cases, sorters=tuple(SORTERS)) -> DataFrame:
    """Result rows in the schema of benchmark files."""
    rows = [(*run_case(spark, s, c), None, None, float(c.size), 1.0) for c in cases for s in sorters]
    return spark.createDataFrame(rows, BENCH_RUNS)
