"""Connected components over links, for ids that stand for the same request."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the checkpoint folder and cut off from the plan that made them.

    A folder of this machine does only for a local master; a cluster without spark.checkpoint.dir is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return df.checkpoint()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node of each node's component: node, root. A link of a node with itself keeps a lone node, and takes no part in the rounds.

    A round takes the smallest root of a node's neighbours and then the root of that root, so rounds
    grow with the logarithm of a component's width.
    """
    every = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).union(links.select(b, a)).distinct())
    both = every.where("a <> b")
    roots = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("near", "node").alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = roots.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = cut(lower.join(jump, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"), "was"))
        roots = new.select("node", "root")
        if new.where("root <> was").limit(1).count() == 0:
            break
    lone = every.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(lone.join(roots, "node", "left_anti"))
