"""Chains followed to their ends by pointer jumping: about log2(longest chain) joins, however long it is."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import delete_folder, scratch_folder, written


def follow(links: DataFrame) -> DataFrame:
    """node, last, steps of every node of `links` (node, next; NULL: an end).

    Each round every node that has not reached an end points to where its pointer points, so pointers
    double their reach. Every node has one successor here; chains that run into one another are
    allowed, as finished nodes leave the joins. A node that reaches no end lies on a cycle or leads
    to one: `last` and `steps` are NULL. Rounds are written, so a lost executor repeats one at most.
    """
    spark, root = links.sparkSession, scratch_folder(links.sparkSession, "chains")
    far = written(links.select("node", F.coalesce("next", "node").alias("at"), F.col("next").isNotNull().cast("long").alias("steps"),
                               F.col("next").isNull().alias("ended")), f"{root}/0", "ended")
    done, far, k = far.where("ended"), far.where("NOT ended"), 0
    while True:
        ahead = done.union(far).select(F.col("node").alias("at"), F.col("at").alias("then"), F.col("steps").alias("more"), "ended")
        jumped = written(far.drop("ended").join(ahead.hint("merge"), "at").select(
            "node", F.col("then").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), "ended"), f"{root}/{k + 1}", "ended")
        reached = jumped.where("ended")
        # a way to an end passes all shorter distances: once none is reached, what is left can't reach any
        if reached.isEmpty():
            break
        delete_folder(spark, f"{root}/{k}/ended=false")
        done, far, k = done.union(reached), jumped.where("NOT ended"), k + 1
    lost = far.select("node", F.lit(None).cast("long").alias("last"), F.lit(None).cast("long").alias("steps"))
    return done.select("node", F.col("at").alias("last"), "steps").union(lost)


def list_positions(edges: DataFrame, source="source_id", dest="dest_id") -> DataFrame:
    """nid, pos, in_cycle: each node's 0-based place in its chain, counted from the chain's first node."""
    nodes = edges.select(F.col(source).alias("nid")).union(edges.select(F.col(dest).alias("nid"))).distinct()
    back = nodes.join(edges.select(F.col(dest).alias("nid"), F.col(source).alias("next")), "nid", "left")
    return follow(back.withColumnRenamed("nid", "node")).select(
        F.col("node").alias("nid"), F.col("steps").alias("pos"), F.col("last").isNull().alias("in_cycle"))
