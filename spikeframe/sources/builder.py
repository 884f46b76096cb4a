"""Fluent definition of small networks, and its DataFrame counterpart."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scans import slot_numbers
from ..operators.network import Network
from ..schemas import NEURONS, RULES, SYNAPSES


class NetworkBuilder:
    """Neurons are numbered 0..q-1; naming a higher number fills the gap with empty
    neurons, and defining a neuron again replaces it together with its rules."""

    def __init__(self):
        self._spikes, self._rules, self._outputs, self._edges = {}, {}, set(), []
        self._size = 0

    def add_neuron(self, nid, initial_spikes=0):
        self._size = max(self._size, nid + 1)
        self._spikes[nid] = initial_spikes
        self._rules[nid] = []
        self._outputs.discard(nid)
        return self

    def add_rule(self, nid, threshold, consumed, produced, delay=0):
        if nid >= self._size:
            self.add_neuron(nid)
        self._rules.setdefault(nid, []).append((threshold, consumed, produced, delay))
        return self

    def add_synapse(self, source, dest, weight=1):
        self._edges.append((source, dest, weight))
        return self

    def chain_neurons(self, ids):
        for link in zip(ids, ids[1:]):
            self.add_synapse(*link)
        return self

    def mark_output(self, *nids):
        self._outputs.update(nids)
        return self

    def build(self, spark: SparkSession) -> Network:
        neurons = [(n, self._spikes.get(n, 0), n in self._outputs) for n in range(self._size)]
        rules = [(n, i, *r) for n, listed in sorted(self._rules.items()) for i, r in enumerate(listed)]
        return Network(spark.createDataFrame(neurons, NEURONS), spark.createDataFrame(rules, RULES),
                       spark.createDataFrame(self._edges, SYNAPSES))


def network_from_definitions(neuron_log: DataFrame, rule_log: DataFrame, synapses: DataFrame) -> Network:
    """The builder's meaning for definition logs of any size.

    neuron_log(seq, nid, initial_spikes), rule_log(seq, nid, threshold, consumed,
    produced, delay); ``seq`` orders both logs. The last definition of a neuron wins and
    drops the rules logged before it; numbers never defined become empty neurons.
    """
    spark = neuron_log.sparkSession
    last = neuron_log.groupBy("nid").agg(F.max_by("initial_spikes", "seq").alias("initial_spikes"),
                                         F.max("seq").alias("defined"))
    top = (neuron_log.select("nid").unionAll(rule_log.select("nid"))
           .agg(F.coalesce(F.max("nid"), F.lit(-1))).first()[0])
    neurons = (spark.range(top + 1).withColumnRenamed("id", "nid").join(last, "nid", "left")
               .select("nid", F.coalesce("initial_spikes", F.lit(0)).cast("bigint").alias("initial_spikes"),
                       F.lit(False).alias("is_output")))
    kept = rule_log.join(last.select("nid", "defined"), "nid", "left").where(
        F.col("defined").isNull() | (F.col("seq") > F.col("defined")))
    rules = slot_numbers(kept, "nid", "seq", "rule_idx").select(
        "nid", F.col("rule_idx").cast("int").alias("rule_idx"),
        "threshold", "consumed", "produced", "delay")
    return Network(neurons, rules, synapses.select("source_id", "dest_id", "weight"))
