"""Connected components of a link table, by contraction.

Each round gives every node a priority (a hash of node and round), points it
at its neighbour of lowest priority (or at itself), lets pointers jump once
and rewrites the links between the nodes pointed at; loops and repeats fall
away.  Priorities are random in effect, so chains shrink by a constant factor
a round as stars do, and the rounds grow with the logarithm of the largest
component.  Each round goes through a checkpoint in the shared folder, so
lost executors never replay earlier rounds.  Nothing is collected: only
whether links remain reaches the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.session import ensure_checkpoint_dir


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; nodes are connected exactly if they share a root.

    A root is some member of its component.  Null ends, loops and repeated
    links are ignored.  Isolated nodes have no row; the caller keeps them as
    their own root.
    """
    edges = checkpoint(links.select(F.col(a).alias("a"), F.col(b).alias("b"))
                       .filter("a is not null and b is not null and a <> b")
                       .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while edges.limit(1).count():
        def ranked(node: str, seed: int = len(steps)) -> Column:
            return F.struct(F.xxhash64(F.col(node), F.lit(seed)).alias("h"), F.col(node).alias("node"))

        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.min(ranked("b")).alias("m")) \
            .select(F.col("a").alias("node"), F.least(ranked("a"), F.col("m"))["node"].alias("up"))
        grand = parent.select(F.col("node").alias("up"), F.col("up").alias("root"))
        jumped = checkpoint(parent.join(grand, "up").select("node", "root"))
        steps.append(jumped)
        left = jumped.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = jumped.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = checkpoint(edges.join(left, "a").join(right, "b").filter("ra <> rb")
                           .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    if not steps:
        return links.select(F.col(a).alias("node"), F.col(a).alias("root")).limit(0)

    def follow(found: DataFrame, step: DataFrame) -> DataFrame:
        nxt = step.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        return found.join(nxt, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))

    return reduce(follow, steps[1:], steps[0])
