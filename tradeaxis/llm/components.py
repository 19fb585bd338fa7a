"""Connected components of a link table, by minimum labels and pointer jumping, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradeaxis.session import staged


def components(links: DataFrame) -> DataFrame:
    """``(v, root)`` for every vertex of ``links (a, b)``; the root is the component's least vertex.

    Every round takes the least label of the neighbours and then the label's own label, so the rounds grow
    with the logarithm of the longest path. Each round is written to the shared folder: lineage stays short
    and both sides of the next join are scans that adaptive execution can split.
    """
    both = staged(links.select(F.col("a").alias("v"), F.col("b").alias("to")).union(links.select("b", "a")), "links")
    labels = staged(both.groupBy("v").agg(F.min("to").alias("m")).select("v", F.least("v", "m").alias("root")), "labels")
    while True:
        jumped = _jump(labels)
        near = both.join(jumped.withColumnsRenamed({"v": "to", "root": "r"}), "to").groupBy("v").agg(F.min("r").alias("r"))
        nearer = jumped.join(near, "v", "left").select("v", F.least("root", F.coalesce("r", "root")).alias("root"))
        after = staged(nearer, "labels")
        if after.join(labels.withColumnRenamed("root", "was"), "v").filter(F.col("root") != F.col("was")).isEmpty():
            return after
        labels = after


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: only the roots they touch are worked on again."""
    a = roots.withColumnsRenamed({"v": "a", "root": "ra"})
    b = roots.withColumnsRenamed({"v": "b", "root": "rb"})
    between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    top = components(between.distinct())
    moved = roots.join(top.select(F.col("v").alias("root"), F.col("root").alias("to")), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
    return staged(moved.unionByName(top.join(roots.select("v"), "v", "left_anti")), "labels")


def _jump(labels: DataFrame) -> DataFrame:
    up = labels.select(F.col("v").alias("root"), F.col("root").alias("up"))
    return labels.join(up, "root", "left").select("v", F.coalesce("up", "root").alias("root"))
