"""Registered sorting and workload-generation queries with their SQL oracles."""

from functools import reduce

from pyspark.sql import functions as F

from ..functions.columns import MIX_FIRST, MIX_PRIME, MIX_SECOND
from ..functions.scans import ranked
from ..operators import sort
from ..sources import generate as gen
from ..sources.tables import table


def _balances(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", "c_nationkey", F.floor("c_acctbal").alias("value"))


def _quantities(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_quantity").cast("bigint").alias("value"))


def sort_native_balances(spark, folder):
    return sort.sort_native(_balances(spark, folder), "value", "c_custkey").select(
        "pos", "c_custkey", "value")


def sort_counting_quantities(spark, folder):
    return sort.counting_sort(_quantities(spark, folder), "value")


def sort_network_orders(spark, folder):
    """Every order's line quantities in ascending order."""
    return sort.sort_groups(_quantities(spark, folder), "l_orderkey", "value")


def sort_group_limits(spark, folder):
    """Groups with NULL keys and NULL values, half of them above the group limit."""
    rows = table(spark, folder, "customer").select(
        F.when(F.col("c_nationkey") % 7 != 3, F.col("c_nationkey")).alias("c_nationkey"),
        F.when(F.col("c_custkey") % 5 != 2, F.floor(F.col("c_acctbal") / 100)).alias("value"))
    return sort.sort_groups(rows, "c_nationkey", "value", group_limit=7)


def sort_network_nations(spark, folder):
    """Negative values too."""
    hundreds = table(spark, folder, "customer").select(
        "c_nationkey", F.floor(F.col("c_acctbal") / 100).alias("value"))
    return sort.sort_groups(hundreds, "c_nationkey", "value")


def sort_counting_nations(spark, folder):
    return sort.counting_sort_groups(_balances(spark, folder), "c_nationkey", "value")


def sort_network_sizes(spark, folder):
    """Shape of the sorting network that each order would get."""
    return sort.network_sizes(_quantities(spark, folder), "l_orderkey", "value")


def sort_is_sorted(spark, folder):
    """Are orders sorted by price? And are their ranked prices?"""
    prices = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("pos"), F.floor("o_totalprice").alias("value"))
    done = sort.sort_native(prices.select(F.col("pos").alias("key"), "value"), "value", "key")
    return (sort.is_sorted(prices, "pos", "value").withColumn("input", F.lit("stored"))
            .unionByName(sort.is_sorted(done, "pos", "value").withColumn("input", F.lit("ranked"))))


GEN_SEED, GEN_POOL = 42, 100


def gen_distributions(spark, folder):
    """The orders' whole prices in six arrangements."""
    prices = ranked(table(spark, folder, "orders").select("o_orderkey", F.floor("o_totalprice").alias("value")),
                    ["o_orderkey"], "pos").select("pos", "value")
    return reduce(lambda a, b: a.unionByName(b), [
        gen.arrange(prices, d, GEN_POOL, GEN_SEED).withColumn("dist", F.lit(d)) for d in gen.DISTRIBUTIONS])


def gen_demo_matrix(spark, folder):
    """Twelve columns for each part, filled by the demo rule from the part's own key."""
    return gen.demo_rows(table(spark, folder, "part").select(F.col("p_partkey").alias("i")), 12)


QUERIES = {f.__name__: f for f in (
    sort_native_balances, sort_counting_quantities, sort_network_orders, sort_network_nations,
    sort_counting_nations, sort_group_limits, sort_network_sizes, sort_is_sorted, gen_distributions, gen_demo_matrix)}


def _mix_sql(x, seed):
    a = f"((({x}) % {MIX_PRIME}) * {MIX_FIRST} + {seed * MIX_SECOND + 1}) % {MIX_PRIME}"
    b = f"(({a}) * ({a}) + {MIX_SECOND}) % {MIX_PRIME}"
    return f"((({b}) * ({b}) + {MIX_FIRST}) % {MIX_PRIME})"


def _ranked_sql(key, value, source, partition=""):
    over = f"PARTITION BY {partition} ORDER BY {value}" if partition else f"ORDER BY {value}"
    return f"SELECT {key}row_number() OVER ({over}) - 1 AS pos, {value} AS value FROM {source}"


_SEED = GEN_SEED


def _staged_sql(source, stages):
    """`source` with columns added one after the other, each from those before it."""
    for name, expression in stages:
        source = f"(SELECT *, {expression} AS {name} FROM {source})"
    return source


def _permuted_sql(source):
    """One step of the keyed permutation from (pos, x, n) of `source`."""
    stages = [("high", "ceil(sqrt(n::DOUBLE))::BIGINT"), ("wide", "(n + high - 1) // high"), ("r0", "x // wide"), ("c0", "x % wide")]
    for k in range(gen.FEISTEL_ROUNDS):
        for to, by, size, seed in ((f"r{k}", f"c{k}", "high", _SEED + 2 * k), (f"c{k}", f"r{k + 1}", "wide", _SEED + 2 * k + 1)):
            stages += [(f"{to}a", f"(({by} % {MIX_PRIME}) * {MIX_FIRST} + {seed * MIX_SECOND + 1}) % {MIX_PRIME}"),
                       (f"{to}b", f"({to}a * {to}a + {MIX_SECOND}) % {MIX_PRIME}"),
                       (f"{to}m", f"({to}b * {to}b + {MIX_FIRST}) % {MIX_PRIME}"),
                       (f"{to[0]}{k + 1}", f"({to} + {to}m) % {size}")]
    last = gen.FEISTEL_ROUNDS
    return f"SELECT pos, r{last} * wide + c{last} AS x, n FROM {_staged_sql(source, stages)}"


_ORACLE_GEN = f"""
WITH RECURSIVE base AS (SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS pos,
                     CAST(floor(o_totalprice) AS BIGINT) AS value FROM orders),
n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM orders),
walk AS ({_permuted_sql("(SELECT pos, pos AS x, n FROM base, n)")}
  UNION ALL {_permuted_sql("(SELECT pos, x, n FROM walk WHERE x >= n)")}),
ordered AS (SELECT row_number() OVER (ORDER BY value) - 1 AS pos, value FROM base),
swaps AS (SELECT pos // 10 AS step, {_mix_sql("pos // 10", _SEED + 2)} % n AS x, {_mix_sql("pos // 10", _SEED + 3)} % n AS y
          FROM base, n WHERE pos % 10 = 9),
visits AS (SELECT step, x AS entered, y AS leaves FROM swaps WHERE x <> y UNION ALL SELECT step, y, x FROM swaps WHERE x <> y),
later AS (SELECT entered AS p, step, lead(step) OVER (PARTITION BY entered ORDER BY step) AS next FROM visits),
moves AS (SELECT v.step, entered, leaves, next FROM visits v JOIN later l ON l.p = v.leaves AND l.step = v.step),
trace AS (SELECT entered AS start, leaves, next FROM moves
            QUALIFY row_number() OVER (PARTITION BY entered ORDER BY step) = 1
          UNION ALL SELECT t.start, m.leaves, m.next FROM trace t JOIN moves m ON m.entered = t.leaves AND m.step = t.next),
nearly AS (SELECT coalesce(leaves, pos) AS pos, value FROM ordered LEFT JOIN (SELECT * FROM trace WHERE next IS NULL) ON start = pos)
SELECT 'Random' AS dist, x AS pos, value FROM walk JOIN base USING (pos) WHERE x < n
UNION ALL SELECT 'Sorted', pos, value FROM ordered
UNION ALL SELECT 'Reverse', n - 1 - pos, value FROM ordered, n
UNION ALL SELECT 'NearlySorted', pos, value FROM nearly
UNION ALL SELECT 'FewUnique', pos, value % {GEN_POOL} FROM base
UNION ALL SELECT 'Uniform', pos, (SELECT value FROM base WHERE pos = 0) FROM base"""

ORACLES = {
    "sort_native_balances": """
SELECT row_number() OVER (ORDER BY value, c_custkey) - 1 AS pos, c_custkey, value
FROM (SELECT c_custkey, CAST(floor(c_acctbal) AS BIGINT) AS value FROM customer)""",
    "sort_counting_quantities": _ranked_sql(
        "", "q", "(SELECT CAST(l_quantity AS BIGINT) AS q FROM lineitem)"),
    "sort_network_orders": _ranked_sql(
        "l_orderkey, ", "q", "(SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem)", "l_orderkey"),
    "sort_network_nations": _ranked_sql(
        "c_nationkey, ", "q", "(SELECT c_nationkey, CAST(floor(c_acctbal / 100) AS BIGINT) AS q FROM customer)",
        "c_nationkey"),
    "sort_counting_nations": _ranked_sql(
        "c_nationkey, ", "q", "(SELECT c_nationkey, CAST(floor(c_acctbal) AS BIGINT) AS q FROM customer)",
        "c_nationkey"),
    "sort_network_sizes": """
SELECT l_orderkey, CAST(3 * n AS INTEGER) AS neurons, CAST(n + n * n AS INTEGER) AS rules,
       CAST(n * n + n * (n + 1) // 2 AS INTEGER) AS synapses,
       CAST(hi + o + 3 AS INTEGER) AS ticks, o AS "offset"
FROM (SELECT l_orderkey, count(*) AS n, CAST(max(l_quantity) AS BIGINT) AS hi,
             greatest(0, -CAST(min(l_quantity) AS BIGINT)) AS o FROM lineitem GROUP BY l_orderkey)""",
    "sort_is_sorted": """
WITH p AS (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS v FROM orders),
s AS (SELECT 'stored' AS input, v, lag(v) OVER (ORDER BY o_orderkey) AS u FROM p
      UNION ALL SELECT 'ranked', v, lag(v) OVER (ORDER BY v, o_orderkey) FROM p)
SELECT input, count(*) AS n, count(*) FILTER (v < u) AS descents,
       count(*) FILTER (v < u) = 0 AS is_sorted FROM s GROUP BY input""",
    "gen_distributions": _ORACLE_GEN,
    "gen_demo_matrix": """
SELECT CAST(p_partkey AS BIGINT) AS i, j, ((p_partkey * 12 + j) % 10) * CAST(0.1 AS DOUBLE) AS v
FROM part, (SELECT unnest(range(12)) AS j)""",
    "sort_group_limits": """
SELECT k AS c_nationkey, row_number() OVER (PARTITION BY k ORDER BY v NULLS FIRST) - 1 AS pos, v AS value
FROM (SELECT CASE WHEN c_nationkey % 7 <> 3 THEN c_nationkey END AS k,
             CASE WHEN c_custkey % 5 <> 2 THEN CAST(floor(c_acctbal / 100) AS BIGINT) END AS v FROM customer)""",
}
