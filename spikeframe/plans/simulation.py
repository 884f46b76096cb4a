"""Registered simulation queries with their SQL oracles."""

from pyspark.sql import functions as F

from ..operators.external import advance_with_trains
from ..operators.network import compile_network
from ..operators.simulate import advance, spiking_vector, trace
from ..operators.tick import INHIBITORY, REOPEN, SEQUENTIAL
from ..sources import tables
from .recursive import simulation_sql

TRADE = """neurons AS (
  SELECT s_suppkey * 2 AS nid, s_suppkey % 7 AS initial_spikes, false AS is_output FROM supplier
  UNION ALL
  SELECT p_partkey * 2 + 1, p_size % 3, p_size > 25 FROM part),
rules AS (
  SELECT s_suppkey * 2 AS nid, 0 AS rule_idx, 4 AS threshold, 3 AS consumed, 2 AS produced,
         s_suppkey % 3 AS delay FROM supplier
  UNION ALL SELECT s_suppkey * 2, 1, 1, 1, 1, 0 FROM supplier
  UNION ALL SELECT p_partkey * 2 + 1, 0, p_size % 5 + 3, p_size % 5 + 2, 1, p_size % 2 FROM part
  UNION ALL SELECT p_partkey * 2 + 1, 1, 2, 2, 1, 0 FROM part),
pairs AS (
  SELECT l_suppkey * 2 AS s, l_partkey * 2 + 1 AS p, {weight} AS w
  FROM lineitem GROUP BY 1, 2),
synapses AS (
  SELECT s AS source_id, p AS dest_id, w AS weight FROM pairs
  UNION ALL SELECT p, s, 1 FROM pairs)"""
SHIPMENTS = TRADE.format(weight="count(*)")
RETURNS = TRADE.format(weight="sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END)")

MARKET = """neurons AS (
  SELECT c_custkey AS nid, c_custkey % 5 AS initial_spikes, c_acctbal < 0 AS is_output FROM customer
  UNION ALL SELECT -1 - n_nationkey, 0, false FROM nation),
rules AS (
  SELECT c_custkey AS nid, 0 AS rule_idx, 3 AS threshold, 2 AS consumed, 1 AS produced,
         length(c_mktsegment) % 3 AS delay FROM customer
  UNION ALL SELECT c_custkey, 1, 1, 1, 1, 0 FROM customer
  UNION ALL SELECT -1 - n_nationkey, 0, 10, 10, 1, n_regionkey % 2 FROM nation
  UNION ALL SELECT -1 - n_nationkey, 1, 4, 1, 0, 0 FROM nation),
synapses AS (
  SELECT c_custkey AS source_id, -1 - c_nationkey AS dest_id, 1 AS weight FROM customer
  UNION ALL SELECT -1 - c_nationkey, c_custkey, 2 FROM customer)"""

CHAIN = """neurons AS (
  SELECT o_orderkey AS nid, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 0 END AS initial_spikes,
         o_orderstatus = 'O' AS is_output FROM orders),
rules AS (
  SELECT o_orderkey AS nid, 0 AS rule_idx, 1 AS threshold, 1 AS consumed, 1 AS produced,
         CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 0 END AS delay FROM orders),
synapses AS (
  SELECT * FROM (SELECT lag(o_orderkey) OVER (ORDER BY o_orderkey) AS source_id,
                        o_orderkey AS dest_id, 1 AS weight FROM orders)
  WHERE source_id IS NOT NULL)"""

USERS = """neurons AS (SELECT DISTINCT user_id AS nid, 0 AS initial_spikes FROM events),
rules AS (SELECT nid, 0 AS rule_idx, 9 AS threshold, 4 AS consumed, 3 AS produced, nid % 2 AS delay
          FROM neurons UNION ALL SELECT nid, 1, 2, 1, 1, 0 FROM neurons),
synapses AS (
  SELECT * FROM (SELECT lag(nid) OVER (ORDER BY nid) AS source_id, nid AS dest_id, 1 AS weight FROM neurons)
  WHERE source_id IS NOT NULL),
train AS (SELECT list_position(['view', 'click', 'purchase', 'signup', 'error'], event_type) AS k,
                 user_id AS nid, count(*) AS spikes FROM events GROUP BY 1, 2)"""

STATE = "CAST(nid AS BIGINT) AS nid, spikes, timer, is_open, pending"


def _state(df):
    return df.select("nid", "spikes", "timer", "is_open", F.col("pending").cast("bigint").alias("pending"))


def _run(network, ticks, policy=SEQUENTIAL):
    net = compile_network(network)
    return advance(net.initial_state(), net, ticks, policy)


def snp_step_trade(spark, folder):
    return _state(_run(tables.trade_network(spark, folder), 5))


def snp_inhibitory_sequential(spark, folder):
    return _state(_run(tables.trade_network(spark, folder, inhibit_returns=True), 4))


def snp_inhibitory_applied(spark, folder):
    return _state(_run(tables.trade_network(spark, folder, inhibit_returns=True), 4, INHIBITORY))


def snp_emit_on_reopen(spark, folder):
    return _state(_run(tables.trade_network(spark, folder, inhibit_returns=True), 4, REOPEN))


def snp_trace_market(spark, folder):
    net = compile_network(tables.market_network(spark, folder))
    states = trace(net.initial_state(), net, 5)
    return states.select("k", "nid", "spikes", "timer", "is_open",
                         F.col("pending").cast("bigint").alias("pending"))


def snp_chain_orders(spark, folder):
    return _state(_run(tables.order_chain_network(spark, folder), 6))


def snp_outputs_market(spark, folder):
    network = tables.market_network(spark, folder)
    marked = network.neurons.where("is_output").select("nid")
    return _run(network, 3).select("nid", "spikes").join(marked, "nid")


def snp_spiking_vector(spark, folder):
    net = compile_network(tables.trade_network(spark, folder))
    return spiking_vector(advance(net.initial_state(), net, 2), net)


def snp_external_spikes(spark, folder):
    """Five ticks with external spikes joining every tick."""
    net = compile_network(tables.user_chain_network(spark, folder))
    return _state(advance_with_trains(net.initial_state(), net, tables.event_trains(spark, folder), 5))


def snp_rule_counts(spark, folder):
    """Total rules, neurons, synapses and outputs of the loaded network."""
    n = tables.trade_network(spark, folder)
    sizes = n.neurons.agg(F.count(F.lit(1)).alias("neurons"),
                          F.count_if("is_output").alias("outputs"))
    return sizes.select("neurons", "outputs",
                        n.rule_count().scalar().alias("total_rules"),
                        n.synapses.agg(F.count(F.lit(1))).scalar().alias("synapses"))


QUERIES = {f.__name__: f for f in (
    snp_step_trade, snp_inhibitory_sequential, snp_inhibitory_applied, snp_emit_on_reopen,
    snp_trace_market, snp_chain_orders, snp_outputs_market, snp_spiking_vector, snp_external_spikes,
    snp_rule_counts)}

ORACLES = {
    "snp_step_trade": simulation_sql(SHIPMENTS, 5, f"SELECT {STATE} FROM st WHERE k = 5"),
    "snp_inhibitory_sequential": simulation_sql(RETURNS, 4, f"SELECT {STATE} FROM st WHERE k = 4"),
    "snp_inhibitory_applied": simulation_sql(RETURNS, 4, f"SELECT {STATE} FROM st WHERE k = 4",
                                             inhibit_now=True),
    "snp_emit_on_reopen": simulation_sql(RETURNS, 4, f"SELECT {STATE} FROM st WHERE k = 4",
                                         reopen=True, inhibit_now=True),
    "snp_trace_market": simulation_sql(MARKET, 5, f"SELECT k, {STATE} FROM st"),
    "snp_chain_orders": simulation_sql(CHAIN, 6, f"SELECT {STATE} FROM st WHERE k = 6"),
    "snp_outputs_market": simulation_sql(MARKET, 3, """
SELECT CAST(st.nid AS BIGINT) AS nid, st.spikes FROM st JOIN neurons n ON n.nid = st.nid
WHERE st.k = 3 AND n.is_output"""),
    "snp_spiking_vector": simulation_sql(SHIPMENTS, 2, """
SELECT CAST(st.nid AS BIGINT) AS nid, CAST(coalesce(min(r.rule_idx), -1) AS INTEGER) AS rule_idx
FROM st LEFT JOIN rules r ON r.nid = st.nid AND (st.is_open OR st.timer = 1)
  AND st.spikes >= r.threshold WHERE st.k = 2 GROUP BY st.nid"""),
    "snp_external_spikes": simulation_sql(USERS, 5, f"SELECT {STATE} FROM st WHERE k = 5", train=True),
    "snp_rule_counts": f"""WITH {SHIPMENTS}
SELECT (SELECT count(*) FROM neurons) AS neurons,
       (SELECT count(*) FROM neurons WHERE is_output) AS outputs,
       (SELECT count(*) FROM rules) AS total_rules,
       (SELECT count(*) FROM synapses) AS synapses""",
}
