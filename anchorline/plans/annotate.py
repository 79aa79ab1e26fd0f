"""Agreement of annotators and the time they take, all in long form: (annotator, instance_id, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.operators.quantiles import quantiles
from anchorline.session import broadcast_if_bounded


def labels(states: DataFrame) -> DataFrame:
    """One label per annotator and instance: value[0][0].name as given; annotators without an id go by their folder.

    Entries without a label are left out. Of several exports the latest counts, on a tie the greater label.
    """
    who = F.coalesce(F.nullif("user_id", F.lit("")), "folder")
    rows = states.select(who.alias("annotator"), "exported_at", F.explode("instance_id_to_label_to_value").alias("instance_id", "value"))
    given = F.try_element_at(F.try_element_at("value", F.lit(1)), F.lit(1))["name"]
    kept = rows.select("annotator", "instance_id", "exported_at", given.alias("label")).filter(F.col("label").isNotNull())
    return kept.groupBy("annotator", "instance_id").agg(F.max(F.struct("exported_at", "label")).alias("g")).select("annotator", "instance_id", "g.label")


def clean(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def votes(long: DataFrame) -> DataFrame:
    """Per instance: votes, YES and NO votes, majority, disagreement, unanimity, margin. Other labels count as votes only."""
    out = long.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_votes"), F.count_if(F.col("label") == "YES").alias("n_yes"), F.count_if(F.col("label") == "NO").alias("n_no"))
    yes, no = F.col("n_yes"), F.col("n_no")
    disagree = (yes > 0) & (no > 0)
    return (
        out.withColumn("is_multi", F.col("n_votes") >= 2)
        .withColumn("disagree", disagree)
        .withColumn("majority", F.when(yes > no, "YES").when(no > yes, "NO").otherwise("TIE"))
        .withColumn("unanimous", ~disagree)
        .withColumn("margin", F.abs(yes - no))
    )


def fragile(voted: DataFrame) -> DataFrame:
    return voted.filter(F.col("is_multi") & (F.col("margin") <= 1)).select("instance_id", "n_votes", "margin")


def rates(long: DataFrame, digits: int | None = 1) -> DataFrame:
    """Per annotator: counts, YES and NO rates in percent, and their signed gap to the pooled rates: bias_yes, bias_no.

    With digits the rates are rounded, and the gap of the rounded rate to the unrounded pooled one is rounded again; None leaves all as they are.
    """
    per = long.groupBy("annotator").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == "YES").alias("yes"), F.count_if(F.col("label") == "NO").alias("no"))
    pooled = per.agg(F.sum("n"), F.sum("yes"), F.sum("no")).first()
    n = max(pooled[0] or 0, 1)
    rounded = (lambda c: c) if digits is None else (lambda c: F.bround(c, digits))
    out = per.withColumn("yes_rate", rounded(100 * F.col("yes") / F.col("n"))).withColumn("no_rate", rounded(100 * F.col("no") / F.col("n")))
    return out.withColumn("bias_yes", rounded(F.col("yes_rate") - F.lit(100 * (pooled[1] or 0) / n))).withColumn("bias_no", rounded(F.col("no_rate") - F.lit(100 * (pooled[2] or 0) / n)))


def label_table(long: DataFrame) -> DataFrame:
    """Per annotator: YES, NO, other labels and instances that the annotator didn't label."""
    total = long.select("instance_id").distinct().count()
    per = long.groupBy("annotator").agg(F.count_if(F.col("label") == "YES").alias("yes"), F.count_if(F.col("label") == "NO").alias("no"), F.count(F.lit(1)).alias("n"))
    return per.withColumn("other", F.col("n") - F.col("yes") - F.col("no")).withColumn("missing", F.lit(total) - F.col("n")).drop("n")


def shared(long: DataFrame, *extra: str) -> DataFrame:
    """(instance_id, a, b, label_a, label_b): labels of two annotators a < b of one instance. An instance has few annotators."""
    x = long.select("instance_id", *extra, F.col("annotator").alias("a"), F.col("label").alias("label_a"))
    y = long.select("instance_id", F.col("annotator").alias("b"), F.col("label").alias("label_b"))
    return x.join(y, "instance_id").filter("a < b")


def kappa(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Cohen's kappa per group of shared labels; null with fewer than two or where both gave one label only."""
    cells = pairs.groupBy(*by, "label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy(*by).agg(F.sum("n").alias("n_common"), F.sum(F.when(F.col("label_a") == F.col("label_b"), F.col("n")).otherwise(0)).alias("same"))
    rows = cells.groupBy(*by, F.col("label_a").alias("label")).agg(F.sum("n").alias("na"))
    cols = cells.groupBy(*by, F.col("label_b").alias("label")).agg(F.sum("n").alias("nb"))
    chance = rows.join(cols, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    kinds = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("ka")).join(cols.groupBy(*by).agg(F.count(F.lit(1)).alias("kb")), by)
    out = totals.join(kinds, by).join(chance, by, "left")
    po = F.col("same") / F.col("n_common")
    pe = F.coalesce("chance", F.lit(0)) / (F.col("n_common") * F.col("n_common"))
    value = F.when((F.col("n_common") >= 2) & (F.col("ka") * F.col("kb") > 1), F.try_divide(po - pe, 1 - pe))
    return out.select(*by, "n_common", value.alias("kappa"))


def kappa_matrix(agreement: DataFrame, long: DataFrame) -> DataFrame:
    """(a, b, kappa) in both directions with 1 on the diagonal; agreement as from kappa by a and b."""
    there = agreement.select("a", "b", "kappa")
    back = agreement.select(F.col("b").alias("a"), F.col("a").alias("b"), "kappa")
    own = long.select("annotator").filter("annotator is not null").distinct().select(F.col("annotator").alias("a"), F.col("annotator").alias("b"), F.lit(1.0).alias("kappa"))
    return there.unionByName(back).unionByName(own)


def to_items(long: DataFrame, items: DataFrame) -> DataFrame:
    """long with the columns of its items, which have unique instance_ids; raises KeyError if a label belongs to no item."""
    lost = long.join(items.select("instance_id"), "instance_id", "left_anti").select("instance_id").limit(1).collect()
    if lost:
        raise KeyError(lost[0]["instance_id"])
    return long.join(items, "instance_id")


def overview(voted: DataFrame) -> DataFrame:
    """(measure, value, n, rate): YES votes among YES and NO votes overall, then the instances of each majority and each category, nulls being left out."""
    total = voted.agg(F.coalesce(F.sum("n_yes"), F.lit(0)).alias("n"), F.try_divide(100.0 * F.sum("n_yes"), F.sum("n_yes") + F.sum("n_no")).alias("rate"))
    out = total.select(F.lit("yes_rate").alias("measure"), F.lit("all").alias("value"), "n", "rate")
    for c in ("majority", "category"):
        one = voted.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(one.select(F.lit(c).alias("measure"), "value", "n", F.lit(None).cast("double").alias("rate")))
    return out


def confusion(pairs: DataFrame) -> DataFrame:
    """Per pair of annotators and label of the first: how often the second gave each label."""
    return pairs.groupBy("a", "b", "label_a").pivot("label_b", ["YES", "NO", "UNCERTAIN"]).agg(F.count(F.lit(1))).na.fill(0)


def category_summary(voted: DataFrame) -> DataFrame:
    """Per non-null category: instances, those with several votes, the YES rate and the share of unanimous ones, in percent."""
    g = voted.filter(F.col("category").isNotNull()).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_multi").alias("n_multi"), F.sum("n_yes").alias("y"), F.sum("n_no").alias("o"), F.count_if(F.col("is_multi") & F.col("unanimous")).alias("u")
    )
    return g.select("category", "n", "n_multi", F.try_divide(100.0 * F.col("y"), F.col("y") + F.col("o")).alias("yes_rate"), F.try_divide(100.0 * F.col("u"), F.col("n_multi")).alias("agreement"))


def decision_times(states: DataFrame) -> DataFrame:
    """(annotator, instance_id, t_raw): seconds from the first load of an instance to the first change after it, where there is one.

    Every export counts by itself; of equal rows one is kept.
    """
    who = F.coalesce(F.nullif("user_id", F.lit("")), "folder")
    rows = states.select(who.alias("annotator"), F.explode("instance_id_to_behavioral_data").alias("instance_id", "log")).select("annotator", "instance_id", F.col("log.interactions").alias("log"))
    events = lambda cond: F.transform(F.filter("log", cond), lambda e: e["timestamp"])
    t0 = F.array_min(events(lambda e: (e["event_type"] == "navigation") & (e["target"] == "instance_load")))
    timed = rows.withColumn("t0", t0).withColumn("changes", events(lambda e: e["event_type"] == "annotation_change"))
    after = F.array_min(F.filter("changes", lambda t: t >= F.col("t0")))
    return timed.select("annotator", "instance_id", (after - F.col("t0")).alias("t_raw")).filter(F.col("t_raw").isNotNull()).distinct()


def cap(times: DataFrame, method: str = "tukey") -> DataFrame:
    """times with t: t_raw cut at Q3 + 1.5 IQR (tukey), at the 95th percentile (p95), or as it is (none); is_outlier tells what was cut."""
    if method == "none":
        return times.withColumn("t", F.col("t_raw")).withColumn("is_outlier", F.lit(False))
    q1, q3, p95 = quantiles(times, "t_raw", {"q1": 0.25, "q3": 0.75, "p95": 0.95}).first()
    bound = None if q1 is None else (q3 + 1.5 * (q3 - q1) if method == "tukey" else p95)
    limit = F.lit(bound).cast("double")
    return times.withColumn("t", F.least(F.col("t_raw"), limit)).withColumn("is_outlier", F.coalesce(F.col("t_raw") > limit, F.lit(False)))


def timing_summary(times: DataFrame) -> DataFrame:
    """Per annotator and category, per annotator, and overall, the latter two marked ALL; null categories count in the totals only."""
    who, what, every = F.col("annotator").alias("annotator"), F.col("category").alias("category"), F.lit("ALL")
    levels = F.array(F.struct(F.lit(0).alias("level"), who, what), F.struct(F.lit(1).alias("level"), who, every.alias("category")), F.struct(F.lit(2).alias("level"), every.alias("annotator"), every.alias("category")))
    rows = times.select("t", F.explode(levels).alias("k")).select("t", "k.*").filter((F.col("level") > 0) | F.col("category").isNotNull())
    keys = ["level", "annotator", "category"]
    plain = rows.groupBy(*keys).agg(F.count("t").alias("n"), F.avg("t").alias("mean"), F.stddev_samp("t").alias("std"))
    middle = quantiles(rows, "t", {"median": 0.5}, keys)
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    out = plain.alias("p").join(middle.alias("m"), same, "left").select("p.annotator", "p.category", "n", "mean", "std", "median")
    # the overall row is there for an empty table too
    return out if not times.isEmpty() else times.agg(F.lit("ALL").alias("annotator"), F.lit("ALL").alias("category"), F.count("t").alias("n"), F.avg("t").alias("mean"), F.stddev_samp("t").alias("std"), F.avg("t").alias("median"))


def box_stats(times: DataFrame, by: list[str]) -> DataFrame:
    """Per group of non-null keys: n, mean, std, quartiles, the whiskers (the least and the largest time within 1.5 IQR of the quartiles) and the maximum."""
    rows = times.filter(F.col("t").isNotNull()).dropna(subset=by)
    quarts = quantiles(rows, "t", {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    near = rows.join(broadcast_if_bounded(quarts), by)
    inside = F.col("t").between(F.col("q1") - reach, F.col("q3") + reach)
    return near.groupBy(*by, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"), F.avg("t").alias("mean"), F.stddev_samp("t").alias("std"), F.min(F.when(inside, F.col("t"))).alias("whisker_low"), F.max(F.when(inside, F.col("t"))).alias("whisker_high"), F.max("t").alias("max")
    )


def timing_matrix(times: DataFrame, categories: list[str]) -> DataFrame:
    """Mean time per annotator (rows) and category (columns), with margins ALL."""
    cube = times.filter(F.col("category").isNotNull()).cube("annotator", "category").agg(F.avg("t").alias("mean"), F.grouping("category").alias("gc"), F.grouping("annotator").alias("ga"))
    rows = cube.select(F.when(F.col("ga") == 1, "ALL").otherwise(F.col("annotator")).alias("annotator"), F.when(F.col("gc") == 1, "ALL").otherwise(F.col("category")).alias("category"), "mean")
    return rows.groupBy("annotator").pivot("category", [*categories, "ALL"]).agg(F.first("mean"))
