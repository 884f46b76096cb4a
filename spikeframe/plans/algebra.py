"""Registered matrix queries with their SQL oracles.

Embeddings are scaled to whole numbers, so sums do not depend on their order.
"""

from pyspark.sql import functions as F

from ..operators import matrix, semiring
from ..session import scratch_folder, written
from ..sources.tables import table

WIDTH, LABELS = 64, 10


def _vectors(spark, folder):
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("double"))
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("i"), scaled.alias("row"), "label")


def _label_sums(vectors):
    """(dimension, label) coordinates: 64 x 10."""
    return (vectors.select("label", F.posexplode("row").alias("d", "v"))
            .groupBy(F.col("d").cast("bigint").alias("i"), F.col("label").cast("bigint").alias("j"))
            .agg(F.sum("v").alias("v")))


def _whole(cells):
    return cells.select("i", "j", F.col("v").cast("bigint").alias("v"))


def _shipments(spark, folder, condition):
    return (table(spark, folder, "lineitem").where(condition)
            .groupBy(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"))
            .agg(F.sum("l_quantity").alias("v")))


def mat_multiply_outer(spark, folder):
    """Embeddings transposed times embeddings: 64 x 64, the long side is summed away."""
    vectors = _vectors(spark, folder).select("i", "row")
    return _whole(matrix.multiply_outer(vectors, None, WIDTH, WIDTH))


def mat_multiply_rows(spark, folder):
    """Embeddings times per-label sums: every vector against ten small columns."""
    vectors = _vectors(spark, folder)
    product = matrix.multiply_rows(vectors.select("i", "row"), _label_sums(vectors), WIDTH, LABELS)
    return _whole(matrix.to_cells(product))


def mat_multiply_block(spark, folder):
    vectors = _vectors(spark, folder)
    m = vectors.agg(F.max("i") + 1).first()[0] or 0
    cells = matrix.to_cells(vectors.select("i", "row"))
    product = matrix.multiply_block(cells, _label_sums(vectors), m, LABELS, WIDTH)
    return _whole(matrix.densify(product, m, LABELS))


def mat_multiply_sparse(spark, folder):
    """Supplier x part quantities times part x brand sizes."""
    brands = table(spark, folder, "part").select(
        F.col("p_partkey").alias("i"), F.substring("p_brand", 7, 9).cast("bigint").alias("j"),
        F.col("p_size").cast("double").alias("v"))
    parts = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("k"))
    return _whole(matrix.multiply_join(_shipments(spark, folder, "true"), brands, parts))


def mat_hadamard(spark, folder):
    return _whole(matrix.hadamard(_shipments(spark, folder, "l_returnflag = 'R'"),
                                  _shipments(spark, folder, "l_linestatus = 'O'")))


def mat_add(spark, folder):
    return _whole(matrix.add(_shipments(spark, folder, "l_returnflag = 'R'"),
                             _shipments(spark, folder, "l_linestatus = 'O'")))


def mat_add_float(spark, folder):
    """The sum in single precision, of quarters that it holds exactly."""
    quarter = [_shipments(spark, folder, c).withColumn("v", F.col("v") / 4) for c in (
        "l_returnflag = 'R'", "l_linestatus = 'O'")]
    return matrix.add(*quarter, element="float").select("i", "j", F.col("v").cast("double").alias("v"))


def mat_elementwise_rows(spark, folder):
    """V + V * V on row arrays."""
    vectors = _vectors(spark, folder).select("i", "row")
    squares = matrix.elementwise_rows(vectors, vectors, "hadamard")
    return _whole(matrix.to_cells(matrix.elementwise_rows(vectors, squares, "add")))


def mat_approx_equal(spark, folder):
    """Do the small-side and the block strategy agree on the whole product?"""
    return matrix.approx_equal(mat_multiply_rows(spark, folder), mat_multiply_block(spark, folder))


def mat_densify(spark, folder):
    """Orders per customer and status as a full grid."""
    counted = (table(spark, folder, "orders")
               .groupBy(F.col("o_custkey").alias("i"),
                        (F.expr("instr('FOP', o_orderstatus)") - 1)
                        .cast("bigint").alias("j"))
               .agg(F.count(F.lit(1)).cast("double").alias("v")))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("i"))
    return _whole(matrix.fill_rows(counted, customers, 3))


def mat_corner(spark, folder):
    """Display text of the embeddings' top-left corner."""
    cells = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v"))
    return matrix.corner(cells.select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v")))


def mat_product_check(spark, folder):
    """Random sign vectors accept the supplier product and find one changed cell of it."""
    place = scratch_folder(spark, "product-check")
    left = written(_shipments(spark, folder, "l_quantity > 25"), f"{place}/left")
    right = written(matrix.transpose(_shipments(spark, folder, "l_quantity <= 25")), f"{place}/right")
    # made once: it is searched for its first cell and read by both checks
    product = written(matrix.multiply_join(left, right), f"{place}/product")
    through = written(matrix.signed_product(left, right, 16), f"{place}/through")
    first = product.agg(F.min(F.struct("i", "j")).alias("cell")).scalar()
    changed = product.withColumn("v", F.when(F.struct("i", "j") == first, F.col("v") + 1).otherwise(F.col("v")))
    true, false = (matrix.product_holds(left, right, c, 16, through=through) for c in (product, changed))
    return true.agg(F.sum("wrong_rows").alias("wrong_rows"), F.count(F.lit(1)).alias("vectors")).select(
        F.lit("product").alias("checked"), "vectors", (F.col("wrong_rows") == 0).alias("accepted")).union(false.agg(
            F.count(F.lit(1)).alias("vectors"), F.sum("wrong_rows").alias("wrong_rows")).select(
            F.lit("changed"), "vectors", F.col("wrong_rows") == 0))


HOPS = 4


def _ways(spark, folder):
    """Shipments of large quantities that came back, both ways: suppliers have even numbers, parts odd ones."""
    sent = table(spark, folder, "lineitem").where("l_quantity >= 48 AND l_returnflag = 'R'").select(
        (F.col("l_suppkey") * 2).alias("i"), (F.col("l_partkey") * 2 + 1).alias("j"), F.floor("l_extendedprice").cast("double").alias("v"))
    return sent.union(sent.select("j", "i", "v").toDF("i", "j", "v"))


def mat_cheapest_ways(spark, folder):
    """Least cost between suppliers and parts over at most HOPS shipments."""
    return _whole(semiring.within_hops(_ways(spark, folder), HOPS, "min_plus"))


def mat_reachable(spark, folder):
    """How many suppliers and parts each supplier or part reaches over at most HOPS shipments."""
    return semiring.within_hops(_ways(spark, folder), HOPS, "or_and").groupBy("i").agg(F.count(F.lit(1)).alias("reached"))


QUERIES = {f.__name__: f for f in (
    mat_multiply_outer, mat_multiply_rows, mat_multiply_block, mat_multiply_sparse, mat_hadamard,
    mat_add, mat_add_float, mat_elementwise_rows, mat_approx_equal, mat_product_check, mat_cheapest_ways, mat_reachable, mat_densify, mat_corner)}

_CELLS = """WITH x AS (
  SELECT vec_id AS i, label, unnest(range(64)) AS d, unnest(embedding) AS e FROM embeddings),
q AS (SELECT i, label, d, CAST(floor(CAST(e AS DOUBLE) * 1000) AS BIGINT) AS v FROM x),
c AS (SELECT d, label, sum(v) AS v FROM q GROUP BY d, label)"""
_PRODUCT = f"""{_CELLS}
SELECT q.i, CAST(c.label AS BIGINT) AS j, CAST(sum(q.v * c.v) AS BIGINT) AS v
FROM q JOIN c ON c.d = q.d GROUP BY q.i, c.label"""
_PAIR = """WITH r AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem
  WHERE l_returnflag = 'R' GROUP BY 1, 2),
o AS (SELECT l_suppkey AS i, l_partkey AS j, sum(l_quantity) AS v FROM lineitem
  WHERE l_linestatus = 'O' GROUP BY 1, 2)"""

_WAYS = """WITH sent AS (
  SELECT CAST(l_suppkey * 2 AS BIGINT) AS i, CAST(l_partkey * 2 + 1 AS BIGINT) AS j, CAST(floor(l_extendedprice) AS BIGINT) AS v
  FROM lineitem WHERE l_quantity >= 48 AND l_returnflag = 'R'),
e AS (SELECT i, j, min(v) AS v FROM (FROM sent UNION ALL SELECT j, i, v FROM sent) GROUP BY i, j),
w0 AS (SELECT DISTINCT i, i AS j, 0::BIGINT AS v FROM e)""" + "".join(f""",
w{k + 1} AS (SELECT i, j, min(v) AS v FROM (
  FROM w{k} UNION ALL SELECT w{k}.i, e.j, w{k}.v + e.v FROM w{k} JOIN e ON e.i = w{k}.j) GROUP BY i, j)""" for k in range(HOPS))

ORACLES = {
    "mat_multiply_outer": f"""{_CELLS}
SELECT a.d AS i, b.d AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v
FROM q a JOIN q b ON a.i = b.i GROUP BY a.d, b.d""",
    "mat_multiply_rows": _PRODUCT,
    "mat_multiply_block": _PRODUCT,
    "mat_multiply_sparse": """
SELECT l_suppkey AS i, CAST(substr(p_brand, 7) AS BIGINT) AS j,
       CAST(sum(l_quantity * p_size) AS BIGINT) AS v
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2""",
    "mat_hadamard": f"""{_PAIR}
SELECT i, j, CAST(r.v * o.v AS BIGINT) AS v FROM r JOIN o USING (i, j)""",
    "mat_add": f"""{_PAIR}
SELECT i, j, CAST(coalesce(r.v, 0) + coalesce(o.v, 0) AS BIGINT) AS v FROM r FULL JOIN o USING (i, j)""",
    "mat_add_float": f"""{_PAIR}
SELECT i, j, CAST(CAST((coalesce(r.v, 0) + coalesce(o.v, 0)) / 4 AS FLOAT) AS DOUBLE) AS v FROM r FULL JOIN o USING (i, j)""",
    "mat_elementwise_rows": f"{_CELLS} SELECT i, d AS j, v + v * v AS v FROM q",
    "mat_approx_equal": f"""SELECT count(*) * {LABELS} AS cells, CAST(0 AS BIGINT) AS unmatched,
       CAST(0 AS DOUBLE) AS max_diff, true AS is_equal FROM embeddings""",
    "mat_densify": """
SELECT c_custkey AS i, CAST(s.j AS BIGINT) AS j, count(o_orderkey) AS v
FROM customer CROSS JOIN (VALUES (0, 'F'), (1, 'O'), (2, 'P')) s(j, status)
LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = s.status GROUP BY 1, 2""",
    "mat_corner": """
SELECT i, j, printf('%.2f', CAST(e AS DOUBLE)) AS shown
FROM (SELECT vec_id AS i, unnest(range(64)) AS j, unnest(embedding) AS e FROM embeddings) WHERE i < 5 AND j < 5""",
    # what the check must say of any tables with at least one product cell
    "mat_product_check": """
SELECT * FROM (VALUES ('product', 16::BIGINT, true), ('changed', 16::BIGINT, false)) t(checked, vectors, accepted)
WHERE (SELECT count(*) FROM lineitem) > 0""",
    "mat_cheapest_ways": f"{_WAYS} SELECT i, j, v FROM w{HOPS}",
    "mat_reachable": f"{_WAYS} SELECT i, count(*) AS reached FROM w{HOPS} GROUP BY i",
}
