"""Structured Streaming: every micro-batch of external spikes is one clock tick."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.external import tick_with_train
from ..operators.network import CompiledNetwork
from ..operators.tick import SEQUENTIAL


def drive(train: DataFrame, net: CompiledNetwork, folder, policy=SEQUENTIAL):
    """Stream writer for ``train(keys, spikes)``.

    The state after batch b is the table ``folder/state/tick=b``. A batch only reads its
    predecessor's table and overwrites its own, so a repeated batch gives the same
    result and a restarted query goes on from the last finished tick.
    """
    spark = net.static.sparkSession

    def on_batch(batch, batch_id):
        before = (net.initial_state() if batch_id == 0
                  else spark.read.parquet(f"{folder}/state/tick={batch_id - 1}"))
        after = tick_with_train(before, net, batch, policy)
        after.write.mode("overwrite").parquet(f"{folder}/state/tick={batch_id}")

    return (train.writeStream.foreachBatch(on_batch)
            .option("checkpointLocation", f"{folder}/progress"))


def states(spark, folder) -> DataFrame:
    """All recorded states with the tick that produced them (1 for the first batch)."""
    return (spark.read.parquet(f"{folder}/state")
            .withColumn("k", F.col("tick") + 1).drop("tick"))
