"""Connected components of a link table, by hooking to the smallest neighbour and contracting.

Each round halves the nodes at least, so rounds grow with the logarithm of the longest chain. Links never
reach the driver; every round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_kept, keep


def components(links: DataFrame) -> DataFrame:
    """(id, root) for each id of ``links`` (a, b): root is the smallest id that is reachable. Loops, repeated
    links and nulls are allowed; null links are ignored. A hub's links are only ever aggregated by partial
    minimum or joined, never gathered."""
    spark = links.sparkSession
    edges = keep(spark, links.filter("a < b or b < a").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not edges.isEmpty():
        links_now, roots_now = edges, roots
        both = edges.union(edges.select("b", "a"))
        parent = keep(spark, both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "parents")
        while True:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("above"))
            jumped = keep(spark, parent.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"), (F.col("above") < F.col("root")).alias("moved")), "parents")
            drop_kept(parent)
            parent = jumped.select("id", "root")
            if jumped.filter("moved").isEmpty():
                break
        if roots is None:
            roots = parent
        else:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("above"))
            roots = roots.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"))
        written = keep(spark, roots, "roots")
        for end in ("a", "b"):
            edges = edges.join(parent.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}")), end)
        left = keep(spark, edges.select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).filter("a < b").distinct(), "links")
        drop_kept(links_now, parent, *[r for r in (roots_now,) if r is not None])
        edges, roots = left, written
    drop_kept(edges)
    return roots if roots is not None else spark.createDataFrame([], "id long, root long")
