"""One label per item from annotators who disagree, with a measure of agreement and each annotator's reliability.

Confidence-aware truth discovery: start from the majority, then alternate between weighing annotators and choosing the label that minimises the weighted
distance. An annotator's weight is the chi-squared quantile of their number of labels over their summed distance from the truths, that is the inverse of
the upper confidence bound of their error variance: whoever gave few labels gets little weight, however right they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.operators.skew import LoadPlan, plan_load, skew_join
from anchorline.session import bounded, cut, pick, release

#: Standard normal quantile of the two-sided 95 % interval.
Z = 1.959963984540054
#: Pseudo errors of every annotator, so that weights stay finite.
SMOOTH = 0.5


def annotator_labels(states: DataFrame) -> DataFrame:
    """(user_id, instance_id, label) with one label per annotator and instance.

    The annotator is user_id, or folder where that is null or empty. A label is value[0][0].name, trimmed and upper-cased; entries without one and keys
    that are no number are skipped. The export with the latest exported_at counts, a null one as the earliest; on a tie the greater label.
    """
    who = F.coalesce(F.nullif("user_id", F.lit("")), "folder")
    name = F.try_element_at(F.try_element_at("value", F.lit(1)), F.lit(1))["name"]
    rows = pick(states, "user_id", "folder", "exported_at", "instance_id_to_label_to_value").select(who.alias("user_id"), "exported_at", F.explode("instance_id_to_label_to_value").alias("key", "value"))
    label = F.nullif(F.upper(F.regexp_replace(name, r"(?U)^\s+|\s+$", "")), F.lit(""))
    flat = rows.select("user_id", F.expr("try_cast(trim(key) AS BIGINT)").alias("instance_id"), F.struct(F.coalesce("exported_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), label.alias("label")).alias("given"))
    kept = flat.filter(F.col("given.label").isNotNull() & F.col("instance_id").isNotNull())
    return kept.groupBy("user_id", "instance_id").agg(F.max("given").alias("given")).select("user_id", "instance_id", F.col("given.label").alias("label"))


def _chi_square_low(n: Column) -> Column:
    """The 2.5 % quantile of chi-squared with n degrees of freedom (Wilson and Hilferty), above 0."""
    v = F.lit(2.0) / (F.lit(9.0) * n)
    return n * F.pow(F.greatest(F.lit(0.05), 1 - v - Z * F.sqrt(v)), 3)


def majority(labels: DataFrame, min_labels: int) -> DataFrame:
    """Per item: n_labels, the share of the most frequent label, and that label if it is single and there are min_labels or more."""
    votes = labels.groupBy("instance_id", "label").agg(F.count(F.lit(1)).alias("n"))
    top = votes.groupBy("instance_id").agg(F.sum("n").alias("n_labels"), F.max(F.struct("n", "label")).alias("top"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"), F.max("n").alias("m"), F.collect_list("n").alias("ns"))
    single = F.size(F.filter("ns", lambda x: x == F.col("m"))) == 1
    return top.select("instance_id", "n_labels", (F.col("m") / F.col("n_labels")).alias("share"), F.try_divide("same", F.col("n_labels") * (F.col("n_labels") - 1)).alias("pair_agreement"), F.when(single & (F.col("n_labels") >= min_labels), F.col("top.label")).alias("majority"))


class _Labels:
    """The labels, joined again and again by item and by annotator; how a frequent key is split is planned once."""

    def __init__(self, labels: DataFrame) -> None:
        self.rows = labels
        self.plans: dict[str, LoadPlan] = {}

    def joined(self, right: DataFrame, key: str) -> DataFrame:
        if bounded(right):
            return self.rows.join(F.broadcast(right), key)
        if key not in self.plans:
            self.plans[key] = plan_load(self.rows, key)
        return skew_join(self.rows, right, key, plan=self.plans[key])


def discover(states: DataFrame, max_rounds: int = 50, min_labels: int = 3) -> tuple[DataFrame, DataFrame]:
    """(items, annotators).

    items: instance_id, label, n_labels, confidence (the weighted share of label), pair_agreement (share of label pairs that agree, null for one label),
    majority, settled. annotators: user_id, n_labels, n_judged (labels of items with a majority), n_agree (of these, equal to it), errors (labels that aren't
    the item's), weight. A tie in weight gives the greater label. No labels give empty results. The label of an item that few share and of
    annotators with a long tail of few labels still counts.

    The iteration starts from the majority and ends when no item's label changes, so that labels and weights belong together; weights are rounded to
    millionths and added as decimals, which makes the end exact and the same on every run. Items whose label still changes in the last
    of max_rounds are not settled. One state is carried along: each item's label now and at the start, and each annotator's distance from either; the
    record against the start, which is what a majority is asked for, is thus read from the same rows as the weights.
    """
    labels = cut(annotator_labels(states))
    by = _Labels(labels)
    first = cut(majority(labels, min_labels))
    state = cut(first.select("instance_id", F.col("majority").alias("label"), "majority", F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("settled")))
    people = None
    for _ in range(max_rounds):
        against = by.joined(state.select("instance_id", F.col("label").alias("truth"), "majority"), "instance_id")
        differs, agrees = F.col("label") != F.col("truth"), F.col("label") == F.col("majority")
        record = against.groupBy("user_id").agg(
            F.count(F.lit(1)).alias("n_labels"), F.count("majority").alias("n_judged"), F.coalesce(F.sum(agrees.cast("long")), F.lit(0)).alias("n_agree"), F.count_if(differs).alias("errors")
        )
        weight = F.round(_chi_square_low(F.col("n_labels")) / (F.col("errors") + SMOOTH), 6).cast("decimal(18,6)")
        people = cut(record.withColumn("weight", weight))
        votes = by.joined(people.select("user_id", "weight"), "user_id").groupBy("instance_id", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("instance_id").agg(F.max(F.struct("w", "label")).alias("top"), F.sum("w").alias("all"))
        was = state.withColumnRenamed("label", "was").drop("confidence", "settled")
        now = best.join(was, "instance_id").select("instance_id", F.col("top.label").alias("label"), "majority", F.try_divide(F.col("top.w").cast("double"), F.col("all").cast("double")).alias("confidence"), F.col("top.label").eqNullSafe(F.col("was")).alias("settled"))
        old, state = state, cut(now)
        release(old)
        if state.filter(~F.col("settled")).isEmpty():
            break
    items = state.join(first.drop("majority"), "instance_id")
    return items.select("instance_id", "label", "n_labels", "confidence", "pair_agreement", "majority", "settled"), people.withColumn("weight", F.col("weight").cast("double"))


def unreliable(annotators: DataFrame, below_percent: int = 60) -> DataFrame:
    """Annotators who agree with the majority in less than that share of their judged labels; without judged labels they are no case.

    The consensus that is asked for here is the majority of three or more, so the record against the start of the iteration counts, not that
    against its end, in which a few sound annotators may have outvoted many poor ones.
    """
    return annotators.filter(F.col("n_agree") * 100 < F.col("n_judged") * below_percent).select("user_id")
