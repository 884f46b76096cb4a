"""Partitioning and storage-layout statistics of a network."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import block_rank, block_size, block_start
from ..functions.scans import running_total, slot_numbers
from ..functions.skew import salted_join
from ..session import spread


def row_blocks(spark, n, parts) -> DataFrame:
    """(rank, first, rows): contiguous blocks, remainder to the first ranks."""
    ranks = spark.range(parts).withColumnRenamed("id", "rank")
    return ranks.select("rank", block_start("rank", n, parts).alias("first"),
                        block_size("rank", n, parts).alias("rows"))


def owners(ids: DataFrame, n, parts, column="nid") -> DataFrame:
    return ids.withColumn("rank", block_rank(column, n, parts))


def classified_synapses(synapses: DataFrame, n, parts) -> DataFrame:
    """Synapses with both owners; local when they agree, else exported by the source's
    owner (and imported by the destination's)."""
    ends = synapses.select("source_id", "dest_id", "weight",
                           block_rank("source_id", n, parts).alias("source_rank"),
                           block_rank("dest_id", n, parts).alias("dest_rank"))
    return ends.withColumn("kind", F.when(F.col("source_rank") == F.col("dest_rank"), "local")
                           .otherwise("export"))


def synapse_classes(synapses: DataFrame, n, parts) -> DataFrame:
    return (classified_synapses(synapses, n, parts)
            .groupBy("source_rank", "dest_rank", "kind").agg(F.count(F.lit(1)).alias("n")))


def export_slots(synapses: DataFrame, n, parts) -> DataFrame:
    """Buffer slot of every destination that a rank sends to another rank, numbered in
    destination order within the rank pair."""
    targets = (classified_synapses(synapses, n, parts).where("kind = 'export'")
               .select("source_rank", "dest_rank", "dest_id").distinct())
    return slot_numbers(targets, ["source_rank", "dest_rank"], "dest_id", "slot")


def exchange_volume(synapses: DataFrame, n, parts) -> DataFrame:
    """Per rank pair: synapses crossing, and values sent after combining at the sender."""
    crossing = (classified_synapses(synapses, n, parts).where("kind = 'export'")
                .groupBy("source_rank", "dest_rank", "dest_id").agg(F.count(F.lit(1)).alias("n")))
    return crossing.groupBy("source_rank", "dest_rank").agg(
        F.sum("n").alias("synapses"), F.count(F.lit(1)).alias("values_sent"))


def combined_exports(production: DataFrame, synapses: DataFrame, n, parts) -> DataFrame:
    """Weighted production summed per (source rank, destination) before the exchange."""
    exported = classified_synapses(synapses, n, parts).where("kind = 'export' and weight > 0")
    active = production.where("produced > 0").select(F.col("nid").alias("source_id"), "produced")
    return (salted_join(exported, active, "source_id", ["dest_id"]).groupBy("source_rank", "dest_rank", "dest_id")
            .agg(F.sum(F.col("produced") * F.col("weight")).alias("spikes")))


def out_degrees(neurons: DataFrame, synapses: DataFrame) -> DataFrame:
    counted = synapses.groupBy(F.col("source_id").alias("nid")).agg(F.count(F.lit(1)).alias("degree"))
    return neurons.select("nid").join(counted, "nid", "left").select(
        "nid", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def rule_index(neurons: DataFrame, rules: DataFrame) -> DataFrame:
    """(nid, rule_start, rule_count): where each neuron's rules sit when all rules are
    laid out in neuron order."""
    counted = rules.groupBy("nid").agg(F.count(F.lit(1)).alias("rule_count"))
    full = neurons.select("nid").join(counted, "nid", "left").select(
        "nid", F.coalesce("rule_count", F.lit(0)).cast("bigint").alias("rule_count"))
    return running_total(full, "nid", "rule_count", "rule_start")


def synapse_columns(synapses: DataFrame) -> DataFrame:
    """Cell of every synapse in a padded source-by-position matrix. Synapses are unique
    per (source, destination); only filled cells are rows."""
    return slot_numbers(synapses, "source_id", "dest_id", "slot")


def padding(neurons: DataFrame, synapses: DataFrame) -> DataFrame:
    """One row: width Z of the padded matrix, filled cells, padded cells."""
    degrees = out_degrees(neurons, synapses)
    return degrees.agg(F.max("degree").alias("z"), F.sum("degree").alias("filled"),
                       F.count(F.lit(1)).alias("q")).select(
        "q", "z", "filled", (F.col("q") * F.col("z") - F.col("filled")).alias("padded"))


def storage_sizes(neurons: DataFrame, rules: DataFrame, synapses: DataFrame) -> DataFrame:
    """Elements needed by the sparse, ELL and compressed representations."""
    q, z = F.col("q"), F.col("z")
    m = F.col("m")
    shape = padding(neurons, synapses).select("q", "z", rules.agg(F.count(F.lit(1))).scalar().alias("m"))
    return shape.select(
        "q", "m", "z",
        (m * q + 3 * m + 2 * q + 1).alias("sparse_elements"),
        (m * (2 * z + 5) + 2 * q + 1).alias("ell_elements"),
        (q * (z + 3) + 4 * m + 1).alias("compressed_elements"))


def transition_matrix(rules: DataFrame, synapses: DataFrame, size: int = 0) -> DataFrame:
    """Coordinates (nid, rule_idx, dest, v): -consumed on the rule's own neuron and
    +produced*weight on the neurons it reaches; contributions to one cell add up.

    A loop of weight 0 stands for the own cell, so that cells are complete when synapses are added up and
    the far more numerous cells need no grouping. ``size``: about the number of synapses, see Network.
    """
    own = rules.groupBy("nid", "rule_idx").agg(
        F.sum("consumed").alias("consumed"), F.sum(F.greatest("produced", F.lit(0))).alias("produced"))
    sources = synapses.select(F.col("source_id").alias("nid"))
    ends = synapses.select(F.col("source_id").alias("nid"), F.col("dest_id").alias("dest"), F.col("weight").cast("bigint").alias("weight"))
    loops = rules.select("nid", F.col("nid").alias("dest"), F.lit(0).cast("bigint").alias("weight"))
    edges = spread(ends.unionAll(loops), size, "nid", "dest").groupBy("nid", "dest").agg(F.sum("weight").alias("weight"))
    used = F.when(F.col("nid") == F.col("dest"), F.col("consumed")).otherwise(0)
    return salted_join(edges, own, "nid", ["dest"], sources, size).where("dest = nid OR produced > 0").select(
        "nid", "rule_idx", "dest", (F.col("produced") * F.col("weight") - used).cast("bigint").alias("v"))


def algebraic_step(state: DataFrame, fired: DataFrame, rules: DataFrame, synapses: DataFrame,
                   size: int = 0) -> DataFrame:
    """C' = C + S * M for systems without delays: ``state(nid, spikes)`` and spiking vector
    ``fired(nid, rule_idx)``. S picks one row of M per firing neuron, so only those rows
    are formed and the product is their sum per column."""
    chosen = rules.join(fired.where("rule_idx >= 0"), ["nid", "rule_idx"], "left_semi")
    moved = transition_matrix(chosen, synapses, size).select(F.col("dest").alias("nid"), F.col("v").alias("spikes"))
    return (state.select("nid", "spikes").unionAll(moved)
            .groupBy("nid").agg(F.sum("spikes").cast("bigint").alias("spikes")))
