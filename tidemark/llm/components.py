"""Connected components of a graph of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut


def components(edges: DataFrame, cut: Cut) -> DataFrame:
    """node, component_id (smallest node reachable) for every node of ``edges`` (a, b: long), loops and repeats allowed.

    In each round every node points to its smallest neighbour, pointers are
    followed twice, and links are carried over to where their ends point; links
    within one node and repeats go. The smallest node of a component always points
    to itself, so when no link is left, all its nodes have been led there. The
    links shrink by a constant factor a round at least; minima are taken on the
    map side, so a node with very many links sends few rows.
    """
    links = cut(edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b").distinct())
    nodes = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("n"), F.col("b").alias("p")).unionByName(links.select(F.col("b").alias("n"), F.col("a").alias("p")))
        to = cut(both.groupBy("n").agg(F.min("p").alias("p")).select("n", F.least("n", "p").alias("p")))
        far = to
        for _ in range(2):
            step = far.select(F.col("n").alias("m"), F.col("p").alias("q"))
            far = far.join(step, F.col("p") == F.col("m"), "left").select("n", F.coalesce("q", "p").alias("p"))
        to, old = cut(far), to
        cut.drop(old)
        a, b = (to.select(F.col("n").alias(x), F.col("p").alias(f"p{x}")) for x in "ab")
        after = cut(links.join(a, "a").join(b, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
        if nodes is None:
            nodes, links, old = to.select(F.col("n").alias("node"), F.col("p").alias("at")), after, links
        else:
            moved = nodes.join(to, F.col("at") == F.col("n"), "left").select("node", F.coalesce("p", "at").alias("at"))
            nodes, links, old = cut(moved), after, links
        cut.drop(old)
    if nodes is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
    return nodes.select("node", F.col("at").alias("component_id"))
