"""Train, validation and test splits that keep related records together.

Records that share a mention or an answer are linked; hash-to-min finds the connected groups: every node tells its cluster to the least node it
knows and learns that node in return, until nothing changes. Groups are assigned by weighted rendezvous hashing, so that a group's
split depends on its own number and the weights only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.operators.skew import plan_load, skew_join
from anchorline.session import cut, pick, release

SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def mention_key(mention: Column) -> Column:
    """A mention without a trailing bracketed qualifier, in lower case, without white space; null if nothing is left."""
    bare = F.regexp_replace(mention, r"(?U)[\s\x{200B}\x{FEFF}]*(?:\([^()]*\)|\[[^\[\]]*\])[\s\x{200B}\x{FEFF}]*$", "")
    return F.nullif(F.lower(F.regexp_replace(bare, r"(?U)[\s\x{200B}\x{FEFF}]+", "")), F.lit(""))


def _least_sharer(rows: DataFrame, key: str, out: str) -> DataFrame:
    """rows with the least instance_id that has the same key; null keys get null."""
    least = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("instance_id").alias(out))
    return skew_join(rows, least, key, "left")


def hash_to_min(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable from each node of edges (a, b); self edges are fine, null ends are left out.

    Clusters are kept as rows (v, u), u in the cluster of v, so that none has to fit into a task; nodes with large clusters are split by load in the
    join with their minimum. Every round is cut. Takes O(log n) rounds in practice; raises if max_rounds are not enough.
    """
    both = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    v, u = F.col("a").alias("v"), F.col("b").alias("u")
    state = both.select(v, u).unionByName(both.select(F.col("b").alias("v"), F.col("a").alias("u")))
    ends = both.select(F.col("a").alias("v")).unionByName(both.select(F.col("b").alias("v")))
    state = cut(state.unionByName(ends.select("v", F.col("v").alias("u"))).distinct())
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h"))
    before = state.agg(mark).first()[0]
    for _ in range(max_rounds):
        plan = plan_load(state, "v", total=before["n"])
        if plan.heavy:
            told = skew_join(state, state.groupBy("v").agg(F.min("u").alias("m")), "v", plan=plan)
        else:  # no cluster is above a task's share
            told = state.withColumn("m", F.min("u").over(Window.partitionBy("v")))
        # the least node learns the cluster, the cluster's nodes learn the least node
        old, state = state, cut(told.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.*").distinct())
        release(old)
        now = state.agg(mark).first()[0]
        if now == before:
            return state.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))
        before = now
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def groups(instances: DataFrame) -> DataFrame:
    """(instance_id, group_id, group_size) of each distinct non-null instance_id; group_id is the least instance_id of the group.

    Copies of an instance are one; if they differ in mention or answer, all their values link. Null or empty mentions and null answers link nothing.
    """
    rows = pick(instances, "instance_id", "mention", "answer").filter(F.col("instance_id").isNotNull()).select("instance_id", mention_key(F.col("mention")).alias("mention"), "answer").distinct()
    rows = cut(_least_sharer(_least_sharer(cut(rows), "mention", "m"), "answer", "a"))
    # a mention or answer is stood for by the least instance that has it, so the graph has as many nodes as there are mentions and answers
    known = F.array_distinct(F.flatten(F.array(F.collect_set("m"), F.collect_set("a"))))
    nodes = cut(rows.groupBy("instance_id").agg(known.alias("nodes")).select("instance_id", "nodes", F.coalesce(F.array_min("nodes"), F.col("instance_id")).alias("rep")))
    edges = nodes.select(F.col("rep").alias("a"), F.explode("nodes").alias("b")).distinct()
    parts = hash_to_min(edges)
    found = skew_join(nodes.select("instance_id", "rep"), parts.withColumnRenamed("node", "rep"), "rep", "left")
    placed = cut(found.select("instance_id", F.coalesce("component", "rep").alias("group_id")))
    sizes = placed.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size"))
    return skew_join(placed, sizes, "group_id").select("instance_id", "group_id", "group_size")


def rendezvous(key: Column, weights: dict[str, float], seed: int = 6) -> Column:
    """The split with the largest -weight / ln(h), h being a hash of key and split in (0, 1): splits get keys in proportion to weight."""
    scores = []
    for name, weight in sorted(weights.items()):
        if weight > 0:
            digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(name), F.lit(str(seed)))), 1, 13)
            h = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
            scores.append(F.struct((F.lit(-float(weight)) / F.log(h)).alias("score"), F.lit(name).alias("name")))
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["name"]


def assign(grouped: DataFrame, weights: dict[str, float] = SPLITS) -> DataFrame:
    """grouped with its split."""
    return grouped.withColumn("split", rendezvous(F.col("group_id"), weights))
