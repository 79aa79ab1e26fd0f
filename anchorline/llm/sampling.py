"""Samples whose categories have given proportions.

Each row gets a hash priority for each sample; the sample of a category is the quota of rows with the least priorities. A category's reservoir
holds the rows whose priority lies under a bound. Reservoirs of parts of the rows merge by union, as the bound doesn't depend on the part. One pass over the rows
fills the reservoirs of all samples and categories: the number of rows tells how many rows a target can ask for, and the bound lies as far above that share
of the category as chance can make necessary. What was found is then trimmed to the feasible quotas: rows that are surely in stay as they are, and
only those near the bound, whose number grows with the square root of the quota, are ranked one by one. No task holds a category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.operators.skew import safe_join
from anchorline.session import broadcast_if_bounded, cut, pick

OTHER = "OTHER"
#: Standard deviations that a bound keeps from the quota, and rows for small quotas. Whatever chance does, the result is exact: see reservoirs.
SIGMAS, SPARE = 6.0, 30.0
SEED = 20


def clean_type(c: Column) -> Column:
    """Trimmed and upper-cased; null if nothing is left."""
    return F.nullif(F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit(""))


def typed_instances(instances: DataFrame, kb: DataFrame) -> DataFrame:
    """(instance_id, type), one row per distinct non-null instance_id.

    The type is that of the answer's entity, OTHER if the answer is null or unknown or its type null or blank. Where copies of an instance or an entity
    disagree, the least value counts. Frequent answers are split over tasks.
    """
    instances, kb = pick(instances, "instance_id", "answer"), pick(kb, "qid", "type")
    one = instances.filter(F.col("instance_id").isNotNull()).groupBy("instance_id").agg(F.min("answer").alias("answer"))
    types = kb.filter(F.col("qid").isNotNull()).groupBy(F.col("qid").alias("answer")).agg(F.min(clean_type(F.col("type"))).alias("type"))
    one, types = cut(one), cut(types)
    return safe_join(one, types, "answer", "left").select("instance_id", F.coalesce("type", F.lit(OTHER)).alias("type"))


def priority(seed: int) -> Column:
    """32 hexadecimal digits that order the rows of a sample at random, the same in any engine."""
    return F.md5(F.concat_ws(":", F.col("sample_id").cast("string"), F.col("instance_id").cast("string"), F.lit(str(seed))))


def _wanted(targets: DataFrame) -> DataFrame:
    """The distinct rows of targets with the type they mean."""
    rows = pick(targets, "sample_id", "type", "target_share", "sample_frac", "min_rows").distinct()
    return rows.withColumn("__type", F.coalesce(clean_type(F.col("type")), F.lit(OTHER)))


def asked_rows(targets: DataFrame, n_total: int) -> DataFrame:
    """_wanted with target_rows = target_share * sample_frac * n_total, and capacity, the rows that meet the target and the minimum.

    A null share, fraction or minimum asks for nothing.
    """
    rows = F.coalesce(F.col("target_share") * F.col("sample_frac") * F.lit(n_total), F.lit(0.0))
    out = _wanted(targets).withColumn("n_total", F.lit(n_total).cast("long")).withColumn("target_rows", rows)
    least = F.coalesce("min_rows", F.lit(0))
    return out.withColumn("capacity", F.greatest(F.ceil("target_rows"), least).cast("long")).withColumn("rounded", F.greatest(F.round("target_rows"), least).cast("long"))


def reservoirs(typed: DataFrame, asked: DataFrame, counts: DataFrame, seed: int = SEED) -> DataFrame:
    """(sample_id, type, instance_id, priority, sure): the reservoirs of all categories of all samples, cut; a null sample_id is a sample of its own.

    counts: (type, available). A reservoir that stays short of its capacity holds every row of its category. sure: among the rounded quota
    whatever the others are. If chance leaves a reservoir short or marks too many rows as sure, which happens less than once in 10^8 reservoirs, those
    reservoirs are filled again without bounds.
    """
    goal = asked.groupBy("sample_id", F.col("__type").alias("type")).agg(F.max("capacity").alias("capacity"), F.max("rounded").alias("rounded"))
    n, q, c = F.col("available"), F.least("available", "rounded"), F.least("available", "capacity")
    low = (q - F.lit(SIGMAS) * F.sqrt(q) - F.lit(SPARE)) / n
    high = (c + F.lit(SIGMAS) * F.sqrt(c) + F.lit(SPARE)) / n
    bounds = cut(goal.join(broadcast_if_bounded(counts), "type").select("sample_id", "type", low.alias("low"), high.alias("high"), c.alias("least"), q.alias("most")))

    def fill(bounds: DataFrame) -> DataFrame:
        at = F.conv(F.substring("priority", 1, 13), 16, 10).cast("double") / float(1 << 52)
        rows = safe_join(typed, bounds, "type").withColumn("priority", priority(seed)).withColumn("at", at).filter("at < high")
        return cut(rows.select("sample_id", "type", "instance_id", "priority", (F.col("at") < F.col("low")).alias("sure")))

    filled = fill(bounds)
    sizes = _sizes(filled)
    same = F.col("sample_id").eqNullSafe(F.col("__s")) & (F.col("type") == F.col("__t"))
    checked = bounds.join(broadcast_if_bounded(sizes.withColumnsRenamed({"sample_id": "__s", "type": "__t"})), same, "left")
    unlucky = cut(checked.filter((F.coalesce("held", F.lit(0)) < F.col("least")) | (F.coalesce("n_sure", F.lit(0)) > F.col("most"))).select("sample_id", "type", F.lit(0.0).alias("low"), F.lit(2.0).alias("high")))
    if unlucky.isEmpty():
        return filled
    again = fill(unlucky)
    out = unlucky.select(F.col("sample_id").alias("__s"), F.col("type").alias("__t"))
    return cut(filled.join(broadcast_if_bounded(out), same, "left_anti").unionByName(again))


def _sizes(filled: DataFrame) -> DataFrame:
    return filled.groupBy("sample_id", "type").agg(F.count(F.lit(1)).alias("held"), F.count_if("sure").alias("n_sure"))


def category_report(asked: DataFrame, filled: DataFrame, counts: DataFrame) -> DataFrame:
    """Per row of targets what was asked for, what there is, and the feasible quota.

    quota is the larger of target_rows (rounded) and min_rows, but no more than there is; exhausted if the reservoir stayed short of either.
    Repeated target rows are one.
    """
    sizes = _sizes(filled).select(F.col("sample_id").alias("__s"), F.col("type").alias("__t"), "held")
    same = F.col("sample_id").eqNullSafe(F.col("__s")) & (F.col("__type") == F.col("__t"))
    there = counts.select(F.col("type").alias("__c"), "available")
    joined = asked.join(broadcast_if_bounded(sizes), same, "left").join(broadcast_if_bounded(there), F.col("__type") == F.col("__c"), "left")
    held = F.coalesce("held", F.lit(0))
    return (
        joined.withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("quota", F.least("available", "rounded"))
        .withColumn("exhausted", (held < F.col("target_rows")) | (held < F.coalesce("min_rows", F.lit(0))))
        .select("sample_id", "type", "target_share", "target_rows", "min_rows", "n_total", "available", "quota", "exhausted")
    )


def trim(filled: DataFrame, report: DataFrame) -> DataFrame:
    """(sample_id, instance_id, type): of each reservoir exactly quota rows, those with the least priorities; a null sample_id is reported but not drawn."""
    keys = ["sample_id", "type"]
    quotas = report.select("sample_id", F.coalesce(clean_type(F.col("type")), F.lit(OTHER)).alias("type"), "quota").groupBy(*keys).agg(F.max("quota").alias("quota"))
    rest = quotas.join(_sizes(filled), keys).select(*keys, "quota", (F.col("quota") - F.col("n_sure")).alias("rest"))
    rows = filled.join(broadcast_if_bounded(cut(rest)), keys)
    out = ["sample_id", "instance_id", "type"]
    ranked = rows.filter(~F.col("sure")).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("priority", "instance_id")))
    return rows.filter(F.col("sure") & (F.col("quota") > 0)).select(*out).unionByName(ranked.filter("rank <= rest").select(*out))


def matched_sample(instances: DataFrame, kb: DataFrame, targets: DataFrame, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The sample and the report of what could not be met.

    Of the sample exactly quota rows per sample and type, uniform, the same on every run. Empty inputs give an empty sample.
    """
    typed = cut(typed_instances(instances, kb))
    counts = cut(typed.groupBy("type").agg(F.count(F.lit(1)).alias("available")))
    n_total = counts.agg(F.coalesce(F.sum("available"), F.lit(0))).first()[0]
    asked = cut(asked_rows(targets, n_total))
    filled = reservoirs(typed, asked, counts, seed)
    report = cut(category_report(asked, filled, counts))
    return trim(filled, report), report


def unmet(instances: DataFrame, kb: DataFrame, targets: DataFrame) -> DataFrame:
    """(sample_id, type) of the targets whose reservoirs stayed short."""
    return matched_sample(instances, kb, targets)[1].filter("exhausted").select("sample_id", "type")
