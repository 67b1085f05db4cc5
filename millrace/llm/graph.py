"""Connected components of link tables, by contraction with DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of long ids -> (node, root) for every node with a link; root is the least id of the component.

    Each round hangs every node on its least neighbour, follows the pointers to their ends by doubling, and
    relabels the links; a round at least halves what is left of a component.  Rounds are cut by stored tables.
    Links from a node to itself and repeated links say nothing; null ends are dropped; without links no node has a row.
    """
    left = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found = None
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        while True:
            up = stored(up, "pointers")
            ends = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            # a node that is no root's end still has somewhere to go
            moved = up.join(ends, "root").where("next <> root")
            if moved.isEmpty():
                break
            up = up.join(ends, "root").select("node", F.col("next").alias("root"))
        ends = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = up if found is None else stored(found.join(ends, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        a, b = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = left.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        left = stored(left.distinct(), "links")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
    return found
