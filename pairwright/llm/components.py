"""Connected groups of a link table, by alternating star contraction in Spark.

Each round rewrites the links twice. The large star hangs every larger neighbour of a node
on the smallest node in reach; the small star does the same with the smaller neighbours.
Links never multiply, and after a number of rounds logarithmic in the longest chain every
node hangs on the smallest node of its group. All steps are group minima and joins on a
node, so a group may be of any size; a hub is split by adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.durable import settled

ROUNDS = 60  # far above what a chain of 2**40 nodes needs


def _hung(pairs: DataFrame, with_self: bool) -> DataFrame:
    """Each neighbour ``b`` of a node ``a`` hung on the smallest node around ``a``."""
    lowest = pairs.groupBy("a").agg(F.min("b").alias("low")).select(
        "a", F.least("a", "low").alias("low")
    )
    joined = pairs.join(lowest, "a")
    hung = joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
    if with_self:
        hung = hung.unionByName(lowest.select("a", F.col("low").alias("b")))
    return hung.filter(F.col("a") != F.col("b")).distinct()


def _mark(links: DataFrame) -> tuple:
    """A digest of a set of links, one row whatever their number."""
    mixed: Column = F.xxhash64("a", "b")
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(mixed)).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node that has a link; root is the smallest node reachable.

    ``links`` has the two columns ``a`` and ``b`` (long), in any direction, repeats and
    self-links allowed. A node without a link to another does not appear. Links with a null
    end are no links. An empty table gives an empty table.
    """
    links = settled(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = _mark(links)
    for _ in range(ROUNDS):
        if not mark[0]:
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("low")).select(
            "a", F.least("a", "low").alias("low")
        )
        large = (
            both.join(lowest, "a")
            .filter(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
            .distinct()
        )
        links = settled(_hung(large, with_self=True))
        before, mark = mark, _mark(links)
        if mark == before:
            break
    else:
        raise RuntimeError("links did not settle into groups")
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root"))
    )
