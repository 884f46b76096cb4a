from pyspark.sql import functions as F

from spikeframe import compile_network
from spikeframe.operators.external import advance_with_trains
from spikeframe.sources.builder import NetworkBuilder
from spikeframe.streaming.spike_train import drive, states


def test_micro_batches_are_ticks(spark, tmp_path):
    builder = NetworkBuilder().add_neuron(0).add_neuron(1).add_neuron(2)
    builder.add_rule(0, 2, 2, 1, 1).add_rule(1, 1, 1, 2, 0).chain_neurons([0, 1, 2])
    net = compile_network(builder.build(spark))
    trains = {1: [(0, 3), (0, 1)], 2: [(0, 5), (1, 1)], 3: [(2, 4)], 4: [(0, 1)]}
    rows = [(k, n, s) for k, sent in trains.items() for n, s in sent]
    want = advance_with_trains(net.initial_state(), net,
                               spark.createDataFrame(rows, "k int, nid long, spikes long"), 4)

    def run(upto):
        for k in range(*upto):
            spark.createDataFrame(trains[k], "nid long, spikes long").coalesce(1).write.mode("append").parquet(
                str(tmp_path / "in"))
            source = spark.readStream.schema("nid long, spikes long").option("maxFilesPerTrigger", 1).parquet(
                str(tmp_path / "in"))
            drive(source, net, str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()

    run((1, 3))
    run((3, 5))  # restarted queries go on from the recorded tick
    recorded = states(spark, str(tmp_path / "out"))
    assert recorded.agg(F.max("k")).first()[0] == 4
    got = recorded.where("k = 4").select("nid", "spikes", "timer", "is_open", "pending")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
