"""Connected components of an edge table whose nodes are values of any ordered type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.session import staged, unstaged


def component_roots(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``a, b`` edges; the root is the smallest node that is reachable.

    A round offers every node the root of each neighbour, then lets roots follow their own roots, so the number of
    rounds grows slowly with the longest chain. Rounds are written to the shared folder and read again; minima are
    partial aggregates. Loops and repeated edges change nothing; nodes without an edge are not listed.
    """
    links = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = staged(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "roots")
    while True:
        near = links.join(roots, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        lower = roots.join(near, F.col("node") == F.col("a")).select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        above = roots.select(F.col("node").alias("r"), F.col("root").alias("beyond"))
        after = staged(lower.join(above, F.col("root") == F.col("r")).select("node", "was", F.least("root", "beyond").alias("root")), "roots")
        moved = after.filter(F.col("root") != F.col("was")).limit(1).count()
        unstaged(roots)
        roots = after.select("node", "root")
        if not moved:
            unstaged(links)
            return roots
