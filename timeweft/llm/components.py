"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``src, dst``): root is the least node of its component.

    Large-star links each node's greater neighbours to its least one, small-star links its
    lesser neighbours to the least; both use a minimum for each node (pre-aggregated before the
    shuffle) and a join that adaptive execution can split at a hub. The edges are checkpointed
    after every round; rounds grow with the logarithm of the number of nodes.
    """
    hi, lo = F.greatest("src", "dst"), F.least("src", "dst")
    edges = cut(edges.filter("src <> dst").select(hi.alias("src"), lo.alias("dst")).distinct())
    mark = None
    while True:
        both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("n"), F.least("src", "m").alias("m"))
        large = both.filter("dst > src").join(least, F.col("src") == F.col("n")).select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        # Greater neighbours of a node whose least neighbour is the node itself keep their edge to it.
        large = large.filter("src <> dst").distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("n"), "m")
        small = large.join(least, F.col("src") == F.col("n"))
        small = small.select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")), F.struct("src", F.col("m").alias("dst")))).alias("e"))
        edges = cut(small.select("e.src", "e.dst").filter("src <> dst").distinct())
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst")), F.sum(F.xxhash64("dst", "src").cast("decimal(20,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return roots.union(edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())
