"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import anew, checkpoint


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b) but the roots; a root is the smallest node that can be reached.

    Every round halves the distance to the root, and is cut off by a checkpoint.  A star's
    centre may have any number of nodes: its minimum is taken before the shuffle, and the
    join with it can be split.  Null ends and loops are ignored.
    """
    now = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(anew(least, "u"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(least, "u")
        small = pairs.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        now = checkpoint(small.distinct())
        before, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
