"""Reachability by semi-naive iteration: each round joins only what the last round found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.session import cut


def reachable(seeds: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(seed, node, depth): all nodes reached from each seed, the seed itself at depth 0; cycles are fine.

    seeds: (seed); edges: (src, dst). Nulls are left out. Raises if max_rounds are not enough.
    """
    steps = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct()
    frontier = cut(seeds.filter(F.col("seed").isNotNull()).select("seed", F.col("seed").alias("node")).distinct())
    found = frontier.withColumn("depth", F.lit(0))
    for depth in range(1, max_rounds + 1):
        step = frontier.join(steps, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(found.select("seed", "node"), ["seed", "node"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier.withColumn("depth", F.lit(depth)))
        if depth % 10 == 0:
            found = cut(found)
    raise RuntimeError(f"no end after {max_rounds} rounds")


def instances_of(membership: DataFrame, subclass: DataFrame, classes: list[str]) -> DataFrame:
    """(qid) that are members of a class or of any of its subclasses. membership: (qid, cls); subclass: (child, parent)."""
    roots = membership.sparkSession.createDataFrame([(c,) for c in classes], "seed string")
    under = reachable(roots, subclass.select(F.col("parent").alias("src"), F.col("child").alias("dst"))).select(F.col("node").alias("cls")).distinct()
    return membership.join(under, "cls", "left_semi").select("qid").distinct()
