"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinis.session import materialize


def _to_least(pairs: DataFrame) -> DataFrame:
    """Adds to each (u, v) the least node ``m`` among u and its listed neighbours.

    The centre of a large star has an edge to every member.  The second join
    key gives the minima a shuffle of their own; only then may adaptive
    execution split the centre's edges over several tasks.
    """
    least = pairs.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m")).withColumn("_k", F.xxhash64("_u"))
    pairs = pairs.withColumn("_h", F.xxhash64("u"))
    return pairs.join(least, (pairs["u"] == least["_u"]) & (pairs["_h"] == least["_k"])) \
        .select("u", "v", F.least("u", "_m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node below the least one."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang every node and its smaller neighbours below the least of them."""
    star = _to_least(edges)
    return star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
        .union(star.where("u <> m").select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) of comparable nodes -> (node, component), component the least node.

    Only nodes with an edge to another node are listed; a component's least
    node is listed too.  Every round writes its edges to the shared folder,
    which cuts the lineage; rounds grow with the logarithm of the longest
    path.  Self loops, repeated edges and null ends do no harm.
    """
    now = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(now)
    while before[0]:
        now = materialize(_small_star(_large_star(now)), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    # a star: every node points at the least node of its component
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
