"""Registered partitioning and layout queries with their SQL oracles."""

from pyspark.sql import functions as F

from ..operators import layout
from ..operators.network import compile_network
from ..operators.packed import simulate_many
from ..operators.simulate import spiking_vector
from ..sources import tables
from ..sources.builder import network_from_definitions
from .recursive import simulation_sql
from .simulation import SHIPMENTS, TRADE

RANKS = 4


def _trade(spark, folder):
    """Network and the size of its id range 0..n-1."""
    return tables.trade_network(spark, folder), 2 * tables.table(spark, folder, "part").count()


def layout_block_ranks(spark, folder):
    """Orders dealt to 7 ranks in contiguous blocks."""
    orders = tables.table(spark, folder, "orders").select(F.col("o_orderkey").alias("nid"))
    n = orders.count()
    dealt = layout.owners(orders, n, 7).groupBy("rank").agg(
        F.min("nid").alias("low"), F.max("nid").alias("high"), F.count(F.lit(1)).alias("n"))
    return dealt.join(layout.row_blocks(spark, n, 7), "rank").select("rank", "low", "high", "n", "first", "rows")


def layout_synapse_classes(spark, folder):
    network, n = _trade(spark, folder)
    return layout.synapse_classes(network.synapses, n, RANKS)


def layout_export_slots(spark, folder):
    network, n = _trade(spark, folder)
    return layout.export_slots(network.synapses, n, RANKS)


def layout_exchange_volume(spark, folder):
    network, n = _trade(spark, folder)
    return layout.exchange_volume(network.synapses, n, RANKS)


def layout_combined_exports(spark, folder):
    network, n = _trade(spark, folder)
    production = network.neurons.select("nid", F.col("initial_spikes").alias("produced"))
    return layout.combined_exports(production, network.synapses, n, RANKS)


def layout_out_degrees(spark, folder):
    network, _ = _trade(spark, folder)
    return layout.out_degrees(network.neurons, network.synapses)


def layout_rule_index(spark, folder):
    network, _ = _trade(spark, folder)
    return layout.rule_index(network.neurons, network.rules)


def layout_synapse_columns(spark, folder):
    network, _ = _trade(spark, folder)
    return layout.synapse_columns(network.synapses)


def layout_padding(spark, folder):
    network, _ = _trade(spark, folder)
    return layout.padding(network.neurons, network.synapses)


def layout_storage_sizes(spark, folder):
    network, _ = _trade(spark, folder)
    return layout.storage_sizes(network.neurons, network.rules, network.synapses)


def layout_transition_matrix(spark, folder):
    network, _ = _trade(spark, folder)
    return layout.transition_matrix(network.rules, network.synapses, network.size)


def snp_algebraic_step(spark, folder):
    """One delay-free tick as vector-matrix arithmetic."""
    network = tables.without_delays(tables.trade_network(spark, folder))
    net = compile_network(network)
    state = net.initial_state()
    return layout.algebraic_step(state, spiking_vector(state, net), network.rules, network.synapses, network.size)


def snp_many_visits(spark, folder):
    """Six ticks of one small network per user."""
    return simulate_many(tables.visit_networks(spark, folder), 6)


def snp_definitions(spark, folder):
    """Builder semantics on logs: finished orders redefine their customer's neuron, every
    order adds a rule, later definitions drop earlier rules."""
    orders = tables.table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    defined = orders.where("o_orderstatus = 'F'").selectExpr(
        "o_orderkey * 2 as seq", "o_custkey as nid", "o_orderkey % 4 as initial_spikes")
    rules = orders.selectExpr("o_orderkey * 2 + 1 as seq", "o_custkey as nid",
                              "cast(o_orderkey % 5 + 1 as int) as threshold", "1 as consumed",
                              "1 as produced", "0 as delay")
    none = spark.createDataFrame([], "source_id long, dest_id long, weight int")
    network = network_from_definitions(defined, rules, none)
    return network.neurons.select("nid", "initial_spikes").join(
        network.rules.select("nid", "rule_idx", "threshold"), "nid", "left")


QUERIES = {f.__name__: f for f in (
    layout_block_ranks, layout_synapse_classes, layout_export_slots, layout_exchange_volume,
    layout_combined_exports, layout_out_degrees, layout_rule_index, layout_synapse_columns,
    layout_padding, layout_storage_sizes, layout_transition_matrix, snp_algebraic_step,
    snp_many_visits, snp_definitions)}

_BOUNDS = f"""WITH {SHIPMENTS},
n AS (SELECT 2 * count(*) AS n FROM part),
ranks AS (SELECT r, r * (n // {RANKS}) + least(r, n % {RANKS}) AS lo,
                 (r + 1) * (n // {RANKS}) + least(r + 1, n % {RANKS}) AS hi
          FROM n, range({RANKS}) t(r)),
placed AS (SELECT s.*, a.r AS source_rank, b.r AS dest_rank FROM synapses s
           JOIN ranks a ON s.source_id >= a.lo AND s.source_id < a.hi
           JOIN ranks b ON s.dest_id >= b.lo AND s.dest_id < b.hi)"""
_DELAY_FREE = TRADE.replace("s_suppkey % 3 AS delay", "0 AS delay").replace(
    "p_size % 5 + 2, 1, p_size % 2", "p_size % 5 + 2, 1, 0").format(weight="count(*)")
_VISITS = """c AS (SELECT user_id AS sys, count(*) FILTER (event_type = 'view') AS a,
  count(*) FILTER (event_type = 'click') AS b, count(*) FILTER (event_type = 'purchase') AS c,
  count(*) FILTER (event_type = 'signup') AS d, count(*) FILTER (event_type = 'error') AS e
  FROM events GROUP BY user_id),
neurons AS (SELECT sys, CAST(unnest(range(5)) AS BIGINT) AS nid,
                   unnest([a, b, c, d, e]) AS initial_spikes FROM c),
rules AS (SELECT sys, nid, 0 AS rule_idx, 12 AS threshold, 5 AS consumed, 2 AS produced, nid % 3 AS delay
          FROM neurons UNION ALL SELECT sys, nid, 1, 1, 1, 1, 0 FROM neurons),
synapses AS (SELECT sys, nid AS source_id, (nid + 1) % 5 AS dest_id, 1 + initial_spikes % 3 AS weight
             FROM neurons)"""

ORACLES = {
    "layout_block_ranks": """
WITH n AS (SELECT count(*) AS n FROM orders),
ranks AS (SELECT r, r * (n // 7) + least(r, n % 7) AS lo,
                 (r + 1) * (n // 7) + least(r + 1, n % 7) AS hi FROM n, range(7) t(r))
SELECT r AS rank, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) AS n,
       lo AS first, hi - lo AS rows
FROM orders JOIN ranks ON o_orderkey >= lo AND o_orderkey < hi GROUP BY r, lo, hi""",
    "layout_synapse_classes": f"""{_BOUNDS}
SELECT source_rank, dest_rank, CASE WHEN source_rank = dest_rank THEN 'local' ELSE 'export' END AS kind,
       count(*) AS n FROM placed GROUP BY 1, 2, 3""",
    "layout_export_slots": f"""{_BOUNDS}
SELECT source_rank, dest_rank, dest_id,
       row_number() OVER (PARTITION BY source_rank, dest_rank ORDER BY dest_id) - 1 AS slot
FROM (SELECT DISTINCT source_rank, dest_rank, dest_id FROM placed WHERE source_rank <> dest_rank)""",
    "layout_exchange_volume": f"""{_BOUNDS}
SELECT source_rank, dest_rank, count(*) AS synapses, count(DISTINCT dest_id) AS values_sent
FROM placed WHERE source_rank <> dest_rank GROUP BY 1, 2""",
    "layout_combined_exports": f"""{_BOUNDS}
SELECT source_rank, dest_rank, dest_id, CAST(sum(initial_spikes * weight) AS BIGINT) AS spikes
FROM placed JOIN neurons ON nid = source_id
WHERE source_rank <> dest_rank AND initial_spikes > 0 GROUP BY 1, 2, 3""",
    "layout_out_degrees": f"""WITH {SHIPMENTS}
SELECT nid, count(source_id) AS degree FROM neurons LEFT JOIN synapses ON source_id = nid GROUP BY nid""",
    "layout_rule_index": f"""WITH {SHIPMENTS},
c AS (SELECT n.nid, count(r.nid) AS rule_count FROM neurons n LEFT JOIN rules r ON r.nid = n.nid GROUP BY n.nid)
SELECT nid, rule_count, CAST(coalesce(sum(rule_count) OVER (
         ORDER BY nid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rule_start
FROM c""",
    "layout_synapse_columns": f"""WITH {SHIPMENTS}
SELECT source_id, dest_id, CAST(weight AS INTEGER) AS weight,
       row_number() OVER (PARTITION BY source_id ORDER BY dest_id) - 1 AS slot FROM synapses""",
    "layout_padding": f"""WITH {SHIPMENTS},
d AS (SELECT nid, count(source_id) AS degree FROM neurons LEFT JOIN synapses ON source_id = nid GROUP BY nid)
SELECT count(*) AS q, max(degree) AS z, CAST(sum(degree) AS BIGINT) AS filled,
       CAST(count(*) * max(degree) - sum(degree) AS BIGINT) AS padded FROM d""",
    "layout_storage_sizes": f"""WITH {SHIPMENTS},
s AS (SELECT (SELECT count(*) FROM neurons) AS q, (SELECT count(*) FROM rules) AS m,
             (SELECT max(c) FROM (SELECT count(*) AS c FROM synapses GROUP BY source_id)) AS z)
SELECT q, m, z, m * q + 3 * m + 2 * q + 1 AS sparse_elements,
       m * (2 * z + 5) + 2 * q + 1 AS ell_elements, q * (z + 3) + 4 * m + 1 AS compressed_elements FROM s""",
    "layout_transition_matrix": f"""WITH {SHIPMENTS},
t AS (SELECT nid, rule_idx, nid AS dest, -consumed AS v FROM rules
      UNION ALL SELECT r.nid, rule_idx, dest_id, produced * weight FROM rules r
      JOIN synapses ON source_id = r.nid WHERE produced > 0)
SELECT nid, CAST(rule_idx AS INTEGER) AS rule_idx, dest, CAST(sum(v) AS BIGINT) AS v FROM t GROUP BY ALL""",
    "snp_algebraic_step": simulation_sql(
        _DELAY_FREE, 1, "SELECT CAST(nid AS BIGINT) AS nid, spikes FROM st WHERE k = 1"),
    "snp_many_visits": simulation_sql(
        _VISITS, 6, "SELECT sys, nid, spikes, timer, is_open, pending FROM st WHERE k = 6", scope="sys"),
    "snp_definitions": """
WITH d AS (SELECT o_custkey AS nid, max(o_orderkey * 2) AS at, arg_max(o_orderkey % 4, o_orderkey) AS s
           FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
r AS (SELECT o_custkey AS nid, CAST(o_orderkey % 5 + 1 AS INTEGER) AS threshold, o_orderkey * 2 + 1 AS seq
      FROM orders LEFT JOIN d ON d.nid = o_custkey WHERE d.at IS NULL OR o_orderkey * 2 + 1 > d.at),
k AS (SELECT nid, threshold, CAST(row_number() OVER (PARTITION BY nid ORDER BY seq) - 1 AS INTEGER) AS rule_idx FROM r),
n AS (SELECT unnest(range((SELECT max(o_custkey) + 1 FROM orders))) AS nid)
SELECT n.nid, coalesce(d.s, 0) AS initial_spikes, k.rule_idx, k.threshold
FROM n LEFT JOIN d ON d.nid = n.nid LEFT JOIN k ON k.nid = n.nid""",
}
