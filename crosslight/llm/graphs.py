"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """Smallest node of each linked node's component: node, root. `links` has columns a and b.

    Every round takes the smallest root among a node's neighbours and then the root of that root, so
    the rounds grow with the logarithm of a component's width. Each round is cut off in the shared folder.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    roots = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = roots.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = cut(lower.join(jump, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"), "was"))
        roots = new.select("node", "root")
        if new.where("root <> was").limit(1).count() == 0:
            return roots
