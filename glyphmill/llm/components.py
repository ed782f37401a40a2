"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on it, so no neighbour list is ever
gathered; a node that a third of all links touch is a skewed join key, which
adaptive execution splits.  The links are cut from their lineage by a checkpoint
in the shared folder after each round; only two numbers reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def _on_least(links: DataFrame, node: str, least: DataFrame) -> DataFrame:
    """Join links with the least neighbour of a node.

    The join key is the negated node: the grouped side is then dealt out anew, and a
    join of two such exchanges is one that adaptive execution can split at a hot key.
    """
    return links.withColumn("k", -F.col(node)).join(least.select((-F.col(node)).alias("k"), "m"), "k").drop("k")


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Hang the (larger or smaller) neighbours of each node on its least neighbour.

    ``links`` has (hi, lo) with hi > lo.
    """
    if larger:
        both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return _on_least(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")), "u", least).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = _on_least(links, "hi", least)
    return moved.where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(least.select("hi", F.col("m").alias("lo")))


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with a link to another; component is the least node reachable.

    Rows with a null end and links of a node to itself say nothing and are left out.
    """
    pairs = links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    pairs = cut_lineage(pairs)
    before = None
    for _ in range(max_rounds):
        pairs = cut_lineage(_star(_star(pairs, larger=True), larger=False).distinct())
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        # At a fixed point every node hangs on the least of its component.
        if before == tuple(mark):
            return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        before = tuple(mark)
    raise RuntimeError("components did not settle")
