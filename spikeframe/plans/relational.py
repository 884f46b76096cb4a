"""Network questions as plain relational queries over the tables, with their SQL oracles."""

from pyspark.sql import functions as F

from ..operators.chains import list_positions
from ..operators.intervals import interval_totals
from ..sources.tables import chain, table

# Rules (threshold, consumed, produced) in order of priority.
RULES = ((9000, 5000, 3), (5000, 2500, 2), (1000, 1000, 1), (0, 0, 0))


def _fired(spark, folder):
    """Every supplier's first rule whose threshold its balance reaches."""
    rules = F.array(*[F.struct(F.lit(k).alias("rule_idx"), F.lit(t).alias("threshold"), F.lit(c).alias("consumed"),
                               F.lit(p).alias("produced")) for k, (t, c, p) in enumerate(RULES)])
    spikes = F.floor("s_acctbal")
    return table(spark, folder, "supplier").select("s_suppkey", spikes.alias("spikes"), F.get(F.filter(
        rules, lambda r: r["threshold"] <= spikes), F.lit(0)).alias("rule"))


def net_first_rule(spark, folder):
    """The rule each supplier fires and what is left; nothing where no threshold is reached."""
    return _fired(spark, folder).select(
        "s_suppkey", "spikes", "rule.rule_idx", (F.col("spikes") - F.coalesce("rule.consumed", F.lit(0))).alias("left"),
        F.coalesce("rule.produced", F.lit(0)).alias("produced"))


def net_propagated(spark, folder):
    """Suppliers' production along their shipments, weighted by quantity, to parts of even size."""
    edges = (table(spark, folder, "lineitem").groupBy("l_suppkey", "l_partkey")
             .agg(F.sum("l_quantity").cast("bigint").alias("weight")))
    open_parts = table(spark, folder, "part").where("p_size % 2 = 0").select("p_partkey")
    made = _fired(spark, folder).where("rule.produced > 0").select(
        F.col("s_suppkey").alias("l_suppkey"), "rule.produced")
    arrived = edges.join(made, "l_suppkey").groupBy("l_partkey").agg(
        F.sum(F.col("weight") * F.col("produced")).alias("arriving"), F.count(F.lit(1)).alias("senders"))
    return arrived.join(open_parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")


def net_chain_edges(spark, folder):
    """Orders in key order as a chain: who feeds whom."""
    orders = table(spark, folder, "orders").select((F.col("o_orderkey") * 7).alias("nid"))
    return chain(orders.select("nid", F.col("nid").alias("pos")))


def net_shipment_edges(spark, folder):
    """Supplier to part edges with parallel ones combined, and the share of each in its sender's weight."""
    edges = (table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("source_id"),
                                                      F.col("l_partkey").alias("dest_id"))
             .agg(F.count(F.lit(1)).alias("parallel"), F.sum("l_quantity").cast("bigint").alias("weight")))
    sent = edges.groupBy("source_id").agg(F.sum("weight").alias("total"))
    return edges.join(sent, "source_id").select(
        "source_id", "dest_id", "parallel", "weight", F.round(F.col("weight") / F.col("total"), 6).alias("share"))


def net_chain_positions(spark, folder):
    """Places in the orders' chain, found from its edges alone; the suppliers' ring has none."""
    ring = table(spark, folder, "supplier").select((-1 - F.col("s_suppkey")).alias("dest_id"), (
        -1 - (F.col("s_suppkey") + 1) % table(spark, folder, "supplier").agg(F.count(F.lit(1))).scalar()).alias("source_id"))
    edges = net_chain_edges(spark, folder).select("source_id", "dest_id")
    return list_positions(edges.unionByName(ring))


def net_events_in_windows(spark, folder):
    """Events of a month that fall into each order's window (in seconds); windows last from seconds to hours."""
    points = table(spark, folder, "events").select(F.col("event_id"), (
        F.unix_seconds(F.col("ts").cast("timestamp")) % 2592000).alias("second"), "value")
    start = (F.col("o_orderkey") * 7919) % 2592000
    windows = table(spark, folder, "orders").select(
        "o_orderkey", start.alias("opens"), (start + F.floor(F.col("o_totalprice") / 40)).alias("closes"))
    return interval_totals(points, "second", windows, "opens", "closes", ["o_orderkey"], {
        "events": ("count", "second"), "first_event": ("min", "event_id"), "last_second": ("max", "second")})


QUERIES = {f.__name__: f for f in (
    net_first_rule, net_propagated, net_chain_edges, net_shipment_edges, net_chain_positions, net_events_in_windows)}

_FIRED = """WITH s AS (SELECT s_suppkey, CAST(floor(s_acctbal) AS BIGINT) AS spikes FROM supplier),
r AS (SELECT * FROM (VALUES {}) t(rule_idx, threshold, consumed, produced)),
f AS (SELECT s.*, r.* FROM s LEFT JOIN r ON threshold <= spikes
      QUALIFY row_number() OVER (PARTITION BY s_suppkey ORDER BY rule_idx) = 1)""".format(
    ", ".join(f"({k}, {t}, {c}, {p})" for k, (t, c, p) in enumerate(RULES)))
_EDGES = """e AS (SELECT l_suppkey, l_partkey, count(*) AS parallel, CAST(sum(l_quantity) AS BIGINT) AS weight
  FROM lineitem GROUP BY 1, 2)"""

ORACLES = {
    "net_first_rule": f"""{_FIRED}
SELECT s_suppkey, spikes, rule_idx, spikes - coalesce(consumed, 0) AS "left", coalesce(produced, 0) AS produced FROM f""",
    "net_propagated": f"""{_FIRED}, {_EDGES}
SELECT l_partkey, CAST(sum(weight * produced) AS BIGINT) AS arriving, count(*) AS senders
FROM e JOIN f ON s_suppkey = l_suppkey AND produced > 0
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size % 2 = 0) GROUP BY 1""",
    "net_chain_edges": """
SELECT source_id, dest_id, 1 AS weight FROM (
  SELECT lag(o_orderkey * 7) OVER (ORDER BY o_orderkey) AS source_id, o_orderkey * 7 AS dest_id FROM orders)
WHERE source_id IS NOT NULL""",
    "net_shipment_edges": f"""WITH {_EDGES}
SELECT l_suppkey AS source_id, l_partkey AS dest_id, parallel, weight,
       round(weight / sum(weight) OVER (PARTITION BY l_suppkey), 6) AS share FROM e""",
    "net_chain_positions": """
SELECT CAST(o_orderkey * 7 AS BIGINT) AS nid, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, false AS in_cycle FROM orders
UNION ALL SELECT -1 - s_suppkey, NULL, true FROM supplier""",
    "net_events_in_windows": """
WITH p AS (SELECT event_id, epoch_us(ts) // 1000000 % 2592000 AS second FROM events),
w AS (SELECT o_orderkey, o_orderkey * 7919 % 2592000 AS opens, opens + CAST(floor(o_totalprice / 40) AS BIGINT) AS closes FROM orders)
SELECT o_orderkey, count(*) AS events, min(event_id) AS first_event, max(second) AS last_second
FROM p JOIN w ON second BETWEEN opens AND closes GROUP BY o_orderkey""",
}
