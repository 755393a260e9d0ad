"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, gathered


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node that has a link; ``component`` is its smallest reachable node.

    Alternating large-star and small-star steps: each one hangs the neighbours
    of a node below the least of them, with a min that is combined before the
    shuffle and a join that Spark can split where a node is hot.  Every round
    is checkpointed; it ends when a round changes no link.  A few links stay in one partition: rounds over them
    would else write more small files than data.

    Links with a null end and links from a node to itself are ignored; an empty
    table gives an empty one.  Raises ``RuntimeError`` if ``rounds`` don't do.
    """
    tree = cut(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull())
        .toDF("u", "v", "whole").where("whole and u <> v").select("u", "v").distinct()
    )
    tree, few = gathered(tree)
    together = (lambda df: df.coalesce(1)) if few else (lambda df: df)
    seen = _signature(tree)
    for _ in range(rounds):
        if seen[0] == 0:
            break
        both = together(tree.union(tree.select("v", "u")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(least.select("u", F.least("u", "m").alias("m")), "u")
            .where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        tree = cut(together(small.union(least.toDF("u", "v"))).distinct())
        now = _signature(tree)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    roots = tree.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return together(tree.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots))


def _signature(tree: DataFrame) -> tuple:
    row = tree.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
