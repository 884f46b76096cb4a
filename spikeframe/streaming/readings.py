"""Results kept up to date as readings arrive: per configuration and implementation the last one counts.

Keyed state holds the number of readings and the latest reading by order of `seq`, so repeated,
shuffled or delayed arrivals inside the watermark give the same state. Spark drops readings at or before
the watermark that the previous batch began with. Each batch's changed rows lie in a folder of
their own, named by the batch: a batch that is run again after a failure replaces its own folder.
"""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.bench import CONFIG, runs_from

TIMES = ["real_time", "cpu_time", "comm_time", "compute_time"]
KEYS = [*CONFIG, "impl"]
_STATE = "readings long, seq long, " + ", ".join(f"{c} double" for c in TIMES) + ", procs int"
_OUTPUT = f"size long, max_value long, dist string, impl string, {_STATE}"
_LISTS = ", ".join("{} array<{}>".format(*c.split()) for c in _OUTPUT.split(", "))
_FIELDS = ["readings", "seq", *TIMES, "procs"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: State rows of the stream; a checkpoint keeps the number it began with.
BUCKETS = 512


class LastReading(StatefulProcessor):
    """The state of a bucket of configurations: a list per column, read and written once a batch."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", _LISTS)

    def handleInputRows(self, key, rows, timer_values):
        frame = pd.concat(list(rows), ignore_index=True)
        places = frame.groupby(KEYS, sort=False, dropna=False)["seq"]
        new = frame.loc[places.idxmax(), [*KEYS, "seq", *TIMES, "procs"]]
        new.insert(len(KEYS), "readings", places.transform("size")[new.index])
        state = self.last.get()
        if state is None:
            known = changed = new
        else:
            # what was known stands first: of equal numbers the later arrival counts
            both = pd.concat([pd.DataFrame(dict(zip(new.columns, state))), new], ignore_index=True)
            both["readings"] = both.groupby(KEYS, sort=False, dropna=False)["readings"].transform("sum")
            both["fresh"] = both.index >= len(both) - len(new)
            both["fresh"] = both.groupby(KEYS, sort=False, dropna=False)["fresh"].transform("any")
            known = both.sort_values("seq", kind="stable").drop_duplicates(KEYS, keep="last")
            changed, known = known[known["fresh"]].drop(columns="fresh"), known.drop(columns="fresh")
        self.last.update(tuple(known[c].tolist() for c in known.columns))
        yield changed

    def close(self) -> None:
        pass


def latest_readings(results: DataFrame, time: str, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """Changed rows of a stream of readings; `time` is the event time, `delay` how late a reading may be.

    Configurations share the state of their bucket, so that the cost of a call and of a state row isn't paid for each.
    """
    runs = runs_from(results, keep=(time,)).withWatermark(time, delay)
    return runs.withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(
        LastReading(), outputStructType=_OUTPUT, outputMode="Update", timeMode="EventTime")


def process_available(changes: DataFrame, checkpoint: str, out: str) -> None:
    """Run the stream over what has arrived since its checkpoint; batch folders go to `out`.

    No batch without rows follows, so the next run's readings meet the watermark they would meet in one run.
    """
    spark = changes.sparkSession
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)

    def write(frame, batch):
        frame.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    try:
        query = (changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
                 .foreachBatch(write).trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def current(spark, out: str) -> DataFrame:
    """The latest row of every configuration and implementation over all batches."""
    rows = spark.read.schema(f"{_OUTPUT}, batch long").parquet(out)
    return rows.groupBy(*KEYS).agg(F.max_by(F.struct(*_FIELDS), "batch").alias("r")).select(*KEYS, "r.*")
