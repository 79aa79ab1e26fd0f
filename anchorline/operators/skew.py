"""Per-key results although a handful of keys hold most rows.

Fragment-replicate by estimated load: one map-side-combined count gives each key's load; keys above the target load of a task
are split into shards in proportion to their load, the others are gathered into bins by a hash; shards and bins are then packed
onto tasks, longest first, so that every task gets nearly the same number of rows. A matching side is replicated only to the shards of
its key. The list of split keys is bounded: at most (rows / target) keys can exceed the target, which is a small multiple of the
number of tasks.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.session import bounded, parallelism

TASK = "__task"
#: Bins for light keys a task, so that the packing has small pieces to even out.
BINS_PER_TASK = 4


def pack(loads: dict, tasks: int) -> dict:
    """Longest-processing-time packing: piece -> task; of equally loaded tasks the one with fewer pieces is next."""
    heap = [(0.0, 0, t) for t in range(tasks)]
    heapq.heapify(heap)
    out = {}
    for piece, load in sorted(loads.items(), key=lambda kv: (-kv[1], str(kv[0]))):
        total, n, task = heapq.heappop(heap)
        out[piece] = task
        heapq.heappush(heap, (total + load, n + 1, task))
    return out


@dataclass
class LoadPlan:
    """Where the rows of each key go. heavy: key -> tasks of its shards; bins: task of each hash bin of light keys."""

    tasks: int
    bins: list[int]
    heavy: dict = field(default_factory=dict)

    def light_bin(self, key: Column, spread: Column | None = None) -> Column:
        """Bin of a light key. Null keys match nothing, so their rows may go anywhere and are divided by spread."""
        at = F.xxhash64(key) if spread is None else F.when(key.isNull(), F.xxhash64(spread)).otherwise(F.xxhash64(key))
        return F.pmod(at, F.lit(len(self.bins))).cast("int")

    def _bin_task(self, key: Column, spread: Column | None = None) -> Column:
        # folded to one constant by the optimizer; an array of literals would be as long as there are bins in the generated code
        return F.element_at(F.split(F.lit(",".join(map(str, self.bins))), ",").cast("array<int>"), self.light_bin(key, spread) + 1)

    def frame(self, df: DataFrame, key: str) -> DataFrame:
        """The split keys as rows (key, tasks): one for each heavy key, see the bound above."""
        schema = f"`{key}` {df.schema[key].dataType.simpleString()}, __tasks array<int>"
        return df.sparkSession.createDataFrame([(k, v) for k, v in self.heavy.items()], schema)

    def route(self, df: DataFrame, key: str, spread: Column) -> DataFrame:
        """df with its task. spread: what a heavy key's rows are divided by; rows with equal spread stay together."""
        if not self.heavy:
            return df.withColumn(TASK, self._bin_task(F.col(key), spread))
        out = df.join(F.broadcast(self.frame(df, key)), key, "left")
        shard = F.pmod(F.xxhash64(spread, F.lit(7)), F.size("__tasks")).cast("int")
        return out.withColumn(TASK, F.when(F.col("__tasks").isNull(), self._bin_task(F.col(key), spread)).otherwise(F.element_at("__tasks", shard + 1))).drop("__tasks")

    def replicate(self, df: DataFrame, key: str) -> DataFrame:
        """The matching side: each row once for every task that holds rows of its key."""
        if not self.heavy:
            return df.withColumn(TASK, self._bin_task(F.col(key)))
        out = df.join(F.broadcast(self.frame(df, key)), key, "left")
        own = F.coalesce(F.array_distinct("__tasks"), F.array(self._bin_task(F.col(key))))
        return out.withColumn(TASK, F.explode(own)).drop("__tasks")


def plan_load(df: DataFrame, key: str, tasks: int | None = None, total: int | None = None) -> LoadPlan:
    """Count rows a key (combined on the map side), split keys above the target load, pack shards and bins onto tasks.

    total: the rows of df with a key where that is known, which saves a job. Null keys have no load: their rows are spread evenly anyway. An
    empty df is fine.
    """
    tasks = tasks or parallelism(df.sparkSession)
    n_bins = tasks * BINS_PER_TASK
    plan = LoadPlan(tasks, [b % tasks for b in range(n_bins)])
    loads = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    known = total is not None
    loads = loads if known else loads.persist()
    try:
        total = total if known else loads.agg(F.sum("__n")).first()[0] or 0
        target = max(1.0, total / n_bins)
        big = F.col("__n") > target
        # one row a bin; at most total / target keys are above the target, so the lists hold no more than n_bins keys together
        by_bin = loads.groupBy(plan.light_bin(F.col(key)).alias("__bin")).agg(F.sum(F.when(~big, F.col("__n"))).alias("light"), F.collect_list(F.when(big, F.struct(F.col(key).alias("k"), F.col("__n").alias("n")))).alias("heavy"))
        rows = by_bin.collect()
    finally:
        if not known:
            loads.unpersist()
    light = {r["__bin"]: r["light"] or 0 for r in rows}
    pieces: dict = {("bin", b): float(light.get(b, 0)) for b in range(n_bins)}
    for k, n in (h for r in rows for h in r["heavy"]):
        shards = min(tasks, max(2, -(-n // int(max(1, target)))))
        pieces |= {("key", k, i): n / shards for i in range(shards)}
    at = pack(pieces, tasks)
    plan.bins = [at["bin", b] for b in range(n_bins)]
    for piece, task in at.items():
        if piece[0] == "key":
            plan.heavy.setdefault(piece[1], []).append(task)
    return plan


def plan_pairs(rows: DataFrame, key: str, value: str, one_in: int = 16) -> LoadPlan:
    """The plan for the distinct (key, value) pairs of rows, which are what is routed, however often a pair is repeated.

    Loads are estimated from the pairs whose hash falls into one of one_in classes, so that planning moves a small part of the pairs. The
    estimate decides where rows go, never what is counted.
    """
    some = rows.filter(F.pmod(F.xxhash64(key, value, F.lit(3)), F.lit(one_in)) == 0).select(key, value).distinct()
    return plan_load(some, key)


def balanced_distinct_counts(df: DataFrame, key: str, value: str, maxima: list[str], plan: LoadPlan | None = None) -> DataFrame:
    """Per key: rows, distinct non-null values and the largest non-null of each of maxima; null keys are left out.

    The distinct pairs of a split key are divided by value, so shards hold disjoint values and their counts add up. Rows and maxima
    are combined on the map side to one row a key: that is the matching side, which is replicated to the shards of its key only. Other columns of
    df are not read. An empty df gives no rows.
    """
    rows = df.filter(F.col(key).isNotNull()).select(key, value, *maxima)
    plan = plan or plan_pairs(rows, key, value)
    # copies of one (key, value) are combined on the map side, so that they are a single row before anything is routed
    pairs = rows.select(key, value).distinct()
    sent = plan.route(pairs, key, F.col(value)).repartitionById(plan.tasks, F.col(TASK))
    part = sent.groupBy(TASK, key).agg(F.count(value).alias("__d"))
    facts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.max(m).alias(m) for m in maxima])
    known = plan.replicate(facts, key).repartitionById(plan.tasks, F.col(TASK))
    both = part.join(known, [TASK, key])
    return both.groupBy(key).agg(F.max("__n").alias("n_rows"), F.sum("__d").alias("n_distinct"), *[F.max(m).alias(f"max_{m}") for m in maxima])


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", plan: LoadPlan | None = None) -> DataFrame:
    """Equi join on one key whose rows on the left are skewed; right is replicated to the shards of the split keys only.

    how is inner or left. The columns of right besides the key must not clash with those of left. Null keys never match; with
    how="left" they are kept. Either side may be empty. A split key's rows are divided by a hash of the whole row, so that a task that is run
    again sends every row where it went before; equal rows stay together and should be combined beforehand if there are many. If no key is
    above a task's share an inner join is left to the engine.
    """
    plan = plan or plan_load(left, key)
    if how == "inner" and not plan.heavy:
        return left.join(right, key)
    a = plan.route(left, key, F.xxhash64(*left.columns)).repartitionById(plan.tasks, F.col(TASK))
    b = plan.replicate(right.filter(F.col(key).isNotNull()), key).repartitionById(plan.tasks, F.col(TASK))
    return a.join(b, [TASK, key], how).drop(TASK)


def safe_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right by a broadcast if right was measured and is small, else by skew_join. right should be cut or cheap."""
    return left.join(F.broadcast(right), key, how) if bounded(right) else skew_join(left, right, key, how)
