"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.session import staged


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of the undirected edges; the root is the smallest node that it reaches.

    Each round links the neighbours of a node to its smallest neighbour, first the larger ones, then the
    smaller ones, until every component is a star; the number of rounds grows with the logarithm of the
    component's size. Minima are partial aggregates and the joins may be split when a node is hot. Rounds
    are written to the shared folder, so that neither the plan nor a lost executor reaches further back.
    Edges with a null end, loops and repeated edges change nothing; no edges give no rows.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    links = edges.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    links = staged(links, "links")
    before = _signature(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")
        )
        links = staged(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        after = _signature(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
