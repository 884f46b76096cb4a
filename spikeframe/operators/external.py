"""Ticks with spikes from outside: C' = C + St * (Iv * M + STv)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .network import CompiledNetwork
from .tick import SEQUENTIAL, tick


def tick_with_train(state: DataFrame, net: CompiledNetwork, train: DataFrame,
                    policy=SEQUENTIAL) -> DataFrame:
    """One tick, then add ``train(keys, spikes)`` to the neurons that are open."""
    arriving = train.groupBy(*net.keys).agg(F.sum("spikes").cast("bigint").alias("_train"))
    return tick(state, net, policy).join(arriving, net.keys, "left").selectExpr(
        *net.keys, "case when is_open then spikes + coalesce(_train, 0) else spikes end as spikes",
        "timer", "is_open", "pending")


def advance_with_trains(state: DataFrame, net: CompiledNetwork, trains: DataFrame, ticks: int,
                        policy=SEQUENTIAL) -> DataFrame:
    """``trains(k, keys, spikes)``: rows of tick k = 1..ticks join that tick."""
    for k in range(1, ticks + 1):
        state = tick_with_train(state, net, trains.where(F.col("k") == k).drop("k"), policy)
    return state
