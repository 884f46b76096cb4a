"""Registered queries on order: selection and inversions, with their SQL oracles."""

from pyspark.sql import functions as F

from ..operators import inversions, quantiles
from ..sources.tables import table

PERMILLES = (1, 100, 250, 500, 750, 900, 1000)


def sort_selected_prices(spark, folder):
    """Quantiles of line prices (in cents) per return flag, by counting passes."""
    cents = table(spark, folder, "lineitem").select("l_returnflag", F.round(F.col("l_extendedprice") * 100).alias("cents"))
    return quantiles.kth_values(cents, "l_returnflag", "cents", PERMILLES)


def sort_inversions(spark, folder):
    """How far each priority's orders are from ascending prices in order of their keys, by pairs in the wrong order."""
    return inversions.inversions(table(spark, folder, "orders"), "o_orderpriority", "o_orderkey", "o_totalprice")


def sort_customer_inversions(spark, folder):
    """The same for each customer's orders: very many small groups."""
    return inversions.inversions(table(spark, folder, "orders"), "o_custkey", "o_orderkey", "o_totalprice")


QUERIES = {f.__name__: f for f in (sort_selected_prices, sort_inversions, sort_customer_inversions)}


def _inversions_sql(group):
    # the same count by pairs: only the oracle may do that
    return f"""
SELECT o.{group}, n, coalesce(c, 0)::BIGINT AS inversions
FROM (SELECT {group}, count(*) AS n FROM orders GROUP BY 1) o LEFT JOIN (
  SELECT a.{group}, count(*) AS c FROM orders a JOIN orders b
    ON a.{group} = b.{group} AND a.o_orderkey < b.o_orderkey AND a.o_totalprice > b.o_totalprice GROUP BY 1) p
  ON p.{group} = o.{group}"""


ORACLES = {
    "sort_selected_prices": f"""
WITH v AS (SELECT l_returnflag, round(l_extendedprice * 100)::BIGINT AS value,
             row_number() OVER (PARTITION BY l_returnflag ORDER BY round(l_extendedprice * 100)) AS k,
             count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT l_returnflag, permille, k, value FROM v, (SELECT unnest({list(PERMILLES)})::INTEGER AS permille)
WHERE k = greatest((permille * n + 999) // 1000, 1)""",
    "sort_inversions": _inversions_sql("o_orderpriority"),
    "sort_customer_inversions": _inversions_sql("o_custkey"),
}
