"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazette.session import stored


def _hooked(links: DataFrame, larger: bool) -> DataFrame:
    """Each node's neighbours hang on its smallest neighbour or itself.

    The minimum per node is combined in the map tasks, and is joined back to the links by a plain equi-join, which
    adaptive execution splits where one node has a large share of all links.
    """
    if larger:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = near.join(least, "a")
    if larger:
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    return (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of links (a, b), where root is the least node that links reach.

    Every round is a written table in the shared folder, so a lost executor costs that round at most. The number
    of rounds grows with the logarithm of a component's size; without a fixed point after `rounds` it raises.
    Null ends and links of a node with itself are left out. An empty table gives an empty table.
    """
    links = stored(links.select("a", "b").filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    for _ in range(rounds):
        after = stored(_hooked(_hooked(links, True), False), "links")
        marks = [x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"))
                 for x in (links, after)]
        before, now = (m.first() for m in marks)
        links = after
        if before == now:
            break
    else:
        raise RuntimeError("the components did not settle")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
