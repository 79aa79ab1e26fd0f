"""Exact quantiles without holding a column in one task.

Values are counted per group and distinct value, range-sorted, and numbered by running sums inside each partition plus the sums of the partitions
before it; the one or two values whose numbers a quantile falls between are then picked out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anchorline.session import broadcast_if_bounded, cut, parallelism


def quantiles(df: DataFrame, value: str, wanted: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Per group (or over all rows): one column for each of wanted, the quantile with linear interpolation between neighbours.

    Null values don't count. Groups without values are left out; without `by` an empty df gives one row of nulls. A null group is a group.
    """
    by = by or []
    keys = [F.struct(*by).alias("__g")] if by else [F.lit(0).alias("__g")]
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    distinct = rows.groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__n"))
    parts = parallelism(df.sparkSession)
    placed = cut(distinct.repartitionByRange(parts, "__g", "__v").sortWithinPartitions("__g", "__v").withColumn("__p", F.spark_partition_id()))
    sums = placed.groupBy("__g", "__p").agg(F.sum("__n").alias("__s"))  # at most groups + partitions rows
    before = F.coalesce(F.sum("__s").over(Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("__g", "__p", before.alias("__before"), F.sum("__s").over(Window.partitionBy("__g")).alias("__all"))
    inside = Window.partitionBy("__p", "__g").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("__n").over(inside)
    # struct keys compare null-safe as a whole, so null groups meet their offsets
    numbered = placed.withColumn("__upto", upto).join(broadcast_if_bounded(cut(offsets)), ["__g", "__p"]).withColumn("__upto", F.col("__upto") + F.col("__before"))
    first, last = F.col("__upto") - F.col("__n"), F.col("__upto") - 1
    out = []
    for name, q in wanted.items():
        at = F.lit(q) * (F.col("__all") - 1)
        low, high = F.floor(at), F.ceil(at)
        a = F.max(F.when((first <= low) & (low <= last), F.col("__v")))
        b = F.max(F.when((first <= high) & (high <= last), F.col("__v")))
        share = F.max(at - low)
        out.append((a * (1 - share) + b * share).alias(name))
    if not by:
        return numbered.agg(*out)
    return numbered.groupBy("__g").agg(*out).select(*[F.col(f"__g.{c}").alias(c) for c in by], *wanted)
