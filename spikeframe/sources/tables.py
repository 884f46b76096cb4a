"""Parquet tables and the networks derived from them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scans import previous_value
from ..operators.network import Network
from ..session import spread


def table(spark: SparkSession, folder, name) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _rules(neurons: DataFrame, *rules) -> DataFrame:
    """Rules given per neuron as (threshold, consumed, produced, delay) SQL expressions;
    their order is their priority."""
    listed = [F.struct(F.lit(i).alias("rule_idx"),
                       *[F.expr(str(e)).cast("int").alias(c) for e, c in
                         zip(rule, ("threshold", "consumed", "produced", "delay"))])
              for i, rule in enumerate(rules)]
    return neurons.select("nid", F.inline(F.array(*listed)))


def _neurons(df: DataFrame) -> DataFrame:
    return df.select("nid", F.col("initial_spikes").cast("bigint").alias("initial_spikes"),
                     F.col("is_output"))


def trade_network(spark, folder, inhibit_returns=False) -> Network:
    """Suppliers (even ids) and parts (odd ids). A supplier feeds the parts it ships,
    weighted by its number of shipments; a part feeds back with weight 1."""
    supplier = table(spark, folder, "supplier").select(
        (F.col("s_suppkey") * 2).alias("nid"), (F.col("s_suppkey") % 7).alias("initial_spikes"),
        F.lit(False).alias("is_output"), (F.col("s_suppkey") % 3).alias("wait"))
    part = table(spark, folder, "part").select(
        (F.col("p_partkey") * 2 + 1).alias("nid"), (F.col("p_size") % 3).alias("initial_spikes"),
        (F.col("p_size") > 25).alias("is_output"), F.col("p_size"))
    shipped = table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") * 2).alias("s"), (F.col("l_partkey") * 2 + 1).alias("p"), "l_returnflag")
    weight = (F.when(F.col("l_returnflag") == "R", -1).otherwise(1) if inhibit_returns
              else F.lit(1))
    n = shipped.count()  # read from the files' footers
    pairs = (spread(shipped, n, "s", "p").groupBy("s", "p")
             .agg(F.sum(weight).cast("int").alias("w")))
    ends = F.array(F.struct(F.col("s").alias("source_id"), F.col("p").alias("dest_id"),
                            F.col("w").alias("weight")),
                   F.struct(F.col("p").alias("source_id"), F.col("s").alias("dest_id"),
                            F.lit(1).alias("weight")))
    rules = (_rules(supplier, (4, 3, 2, "wait"), (1, 1, 1, 0))
             .unionAll(_rules(part, ("p_size % 5 + 3", "p_size % 5 + 2", 1, "p_size % 2"), (2, 2, 1, 0))))
    return Network(_neurons(supplier).unionAll(_neurons(part)), rules, pairs.select(F.inline(ends)), size=2 * n)


def market_network(spark, folder) -> Network:
    """Customers, then nations (negative ids): every customer feeds its nation and the
    nation feeds its customers, so nations are hubs that grow with the data."""
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("nid"), (F.col("c_custkey") % 5).alias("initial_spikes"),
        (F.col("c_acctbal") < 0).alias("is_output"), "c_nationkey",
        F.length("c_mktsegment").alias("seg"))
    nation = table(spark, folder, "nation").select(
        (-1 - F.col("n_nationkey")).cast("bigint").alias("nid"), F.lit(0).alias("initial_spikes"),
        F.lit(False).alias("is_output"), "n_regionkey")
    feeds = customer.select("nid", (-1 - F.col("c_nationkey")).cast("bigint").alias("hub"))
    both = F.array(F.struct(F.col("nid").alias("source_id"), F.col("hub").alias("dest_id"),
                            F.lit(1).alias("weight")),
                   F.struct(F.col("hub").alias("source_id"), F.col("nid").alias("dest_id"),
                            F.lit(2).alias("weight")))
    rules = (_rules(customer, (3, 2, 1, "seg % 3"), (1, 1, 1, 0))
             .unionAll(_rules(nation, (10, 10, 1, "n_regionkey % 2"), (4, 1, 0, 0))))
    return Network(_neurons(customer).unionAll(_neurons(nation)), rules, feeds.select(F.inline(both)))


def chain(ids: DataFrame, position="pos", nid="nid") -> DataFrame:
    """Synapses ids[i] -> ids[i+1] with weight 1, for unique integer positions."""
    linked = previous_value(ids, position, nid, "source_id")
    return (linked.where("source_id is not null")
            .select("source_id", F.col(nid).alias("dest_id"), F.lit(1).alias("weight")))


def order_chain_network(spark, folder) -> Network:
    """All orders in key order as one chain; urgent orders start with spikes."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("nid"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 2).otherwise(0).alias("initial_spikes"),
        (F.col("o_orderstatus") == "O").alias("is_output"),
        F.when(F.col("o_orderstatus") == "P", 2).otherwise(0).alias("wait"))
    links = chain(orders.select("nid", F.col("nid").alias("pos")))
    return Network(_neurons(orders), _rules(orders, (1, 1, 1, "wait")), links)


def without_delays(network: Network) -> Network:
    return Network(network.neurons, network.rules.withColumn("delay", F.lit(0)),
                   network.synapses, network.scope, network.size)


# Event types in the order of their neuron number.
EVENT_TYPES = ("view", "click", "purchase", "signup", "error")


def visit_networks(spark, folder) -> Network:
    """One five-neuron ring per user: a neuron per event type, charged with the user's
    number of such events."""
    counted = table(spark, folder, "events").groupBy(F.col("user_id").alias("sys")).agg(
        *[F.count_if(F.col("event_type") == t).alias(t) for t in EVENT_TYPES])
    cells = F.array(*[F.struct(F.lit(i).cast("bigint").alias("nid"), F.col(t).alias("initial_spikes"))
                      for i, t in enumerate(EVENT_TYPES)])
    charged = counted.select("sys", F.inline(cells))
    neurons = charged.select("sys", "nid", "initial_spikes", (F.col("nid") == 4).alias("is_output"))
    rules = charged.selectExpr("sys", "nid", """inline(array(
        named_struct('rule_idx', 0, 'threshold', 12, 'consumed', 5, 'produced', 2, 'delay', cast(nid % 3 as int)),
        named_struct('rule_idx', 1, 'threshold', 1, 'consumed', 1, 'produced', 1, 'delay', 0)))""")
    synapses = charged.selectExpr("sys", "nid as source_id", "(nid + 1) % 5 as dest_id",
                                  "cast(1 + initial_spikes % 3 as int) as weight")
    return Network(neurons, rules, synapses, ("sys",))


def event_results(spark, folder) -> DataFrame:
    """Events read as benchmark readings: the type names the implementation, the user the
    configuration; some names are malformed, some implementations unknown, some metrics missing."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", "props")
    return events.selectExpr(
        "event_id as seq",
        """case when user_id % 29 = 7 then concat('broken_', event_id)
                else concat_ws('/',
                  case when user_id % 23 = 3 then 'OtherSnp' else
                  case event_type when 'view' then 'CpuSnp' when 'click' then 'CudaSnp'
                       when 'purchase' then 'SparseCudaSnp' when 'signup' then 'NaiveCudaMpiSnp'
                       else 'CudaMpiSnp' end end,
                  case when user_id % 17 = 5 then 'AnArrangementWithAVeryLongName' else
                  element_at(array('Random', 'Sorted', 'Reverse'), cast(user_id % 3 as int) + 1) end,
                  100 * (user_id div 3 + 1), 100 * (user_id div 3 + 1), 'iterations:5') end as name""",
        "value as real_time", "value * 2 as cpu_time",
        """case when event_type in ('signup', 'error') and user_id % 4 <> 0
                then cast(regexp_extract(props, '"k": ([0-9]+)', 1) as double) * 0.0625 end as Comm_ms""",
        "case when event_type in ('signup', 'error') then value * 0.5 end as ComputeTime_ms",
        "case when event_type in ('signup', 'error') then 4 end as Procs", "props")


def user_chain_network(spark, folder) -> Network:
    """Users of the events in id order as a chain that starts without spikes."""
    users = table(spark, folder, "events").select(F.col("user_id").alias("nid")).distinct()
    users = users.select("nid", F.lit(0).alias("initial_spikes"), F.lit(False).alias("is_output"))
    links = chain(users.select("nid", F.col("nid").alias("pos")))
    return Network(_neurons(users), _rules(users, (9, 4, 3, "nid % 2"), (2, 1, 1, 0)), links)


def event_trains(spark, folder) -> DataFrame:
    """External spikes (k, nid, spikes): a user's events of the k-th type arrive in tick k."""
    kind = F.expr("array_position(array({}), event_type)".format(
        ", ".join(f"'{t}'" for t in EVENT_TYPES)))
    return (table(spark, folder, "events").groupBy(kind.alias("k"), F.col("user_id").alias("nid"))
            .agg(F.count(F.lit(1)).alias("spikes")))
