"""Work that is done in parts and resumed: pending items, merges in which the later value wins, redirects, unions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pending(all_items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of all_items whose key isn't among the done ones; null keys are left out."""
    return all_items.filter(F.col(key).isNotNull()).join(done.select(key).distinct(), key, "left_anti")


def merge_last(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old updated by new: a key of new replaces that of old. Both have unique keys and the same columns."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def union_distinct(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def resolve(titles: DataFrame, normal: DataFrame, redirects: DataFrame, target: DataFrame) -> DataFrame:
    """Look titles up through spelling and redirect tables, keyed by the title that was asked for.

    normal and redirects: (src, dst); target: (title, ...). A title that leads nowhere is kept with nulls.
    """
    step1 = titles.join(normal.select(F.col("src").alias("title"), F.col("dst").alias("n")), "title", "left").withColumn("t1", F.coalesce("n", "title"))
    step2 = step1.join(redirects.select(F.col("src").alias("t1"), F.col("dst").alias("r")), "t1", "left").withColumn("t2", F.coalesce("r", "t1"))
    return step2.select("title", "t2").join(target.withColumnRenamed("title", "t2"), "t2", "left").withColumnRenamed("t2", "resolved")
