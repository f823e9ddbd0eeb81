"""Connected components by alternating large and small stars, with every round in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._shared import forget, hot_join, stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node of its component.

    Nodes are of any type that has an order; null nodes are left out, loops count as nodes on their own. Each round
    links nodes to smaller neighbours (Kiveris and others 2014), so the number of rounds grows with the logarithm of
    the number of nodes. A round shuffles a row for each edge twice; sums are made before the shuffle, and the rows of a
    node of many neighbours are joined to its minimum where they are (:func:`hot_join`). A round's table is deleted when
    the next one is written.
    """
    pairs = edges.select(F.col(a).alias("p"), F.col(b).alias("q")).where("p is not null and q is not null")
    given = stored(pairs.select(F.greatest("p", "q").alias("x"), F.least("p", "q").alias("y")).distinct(), "edges")
    nodes = given.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    now, mark, old = given.where("x != y"), None, None
    while True:
        # Each edge stands at both ends; ends' numbers of edges say whether a node is a hub.
        ends = now.select(F.explode(F.array("x", "y")).alias("u"), F.xxhash64("x", "y").cast("decimal(38,0)").alias("h"))
        degrees = ends.groupBy("u").agg(F.count("*").alias("n"), F.sum("h").alias("h"))
        seen = degrees.agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.max("n").alias("most")).first()
        if seen == mark or not seen["n"]:
            break
        mark, total, most = seen, seen["n"] // 2, seen["most"]
        # Large star: every larger neighbour of a node goes to the node's smallest neighbour.
        both = now.union(now.select(F.col("y"), F.col("x"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        big = hot_join(both.where("v > u"), low, "u", "n", total, largest=most).select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        # Small star: a node's smaller neighbours and itself go to the smallest of them; it has one from each neighbour at most.
        low = big.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("n"))
        small = hot_join(big, low, "x", "n", total, largest=most).select(F.explode(F.array(F.struct("x", F.col("m").alias("y")), F.struct(F.col("y").alias("x"), F.col("m").alias("y")))).alias("e")).select("e.*").where("x != y").distinct()
        now = stored(small, "edges")
        if old is not None:
            forget(old)
        old = now
    return nodes.join(now.select(F.col("x").alias("node"), F.col("y").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
