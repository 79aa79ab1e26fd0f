"""Descriptive statistics over a knowledge base and its instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.functions import strings as S
from anchorline.operators.quantiles import quantiles
from anchorline.session import cut


def counts(df: DataFrame, by: str | Column, alias: str) -> DataFrame:
    return df.groupBy((F.col(by) if isinstance(by, str) else by).alias(alias)).agg(F.count(F.lit(1)).alias("n"))


def top(df: DataFrame, by: str, first: str, n: int) -> DataFrame:
    """The n most frequent non-null values; of equally frequent ones that which was seen first."""
    seen = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
    out = seen.orderBy(F.desc("n"), "first", by)
    return out.limit(n) if n else out


def category_frequency(entries: DataFrame, least: int = 1) -> DataFrame:
    """Per category: entries and their share in percent of all entries; entries without categories count in the share only."""
    total = entries.count()
    rows = entries.select("entry_id", F.explode(F.array_distinct("categories")).alias("category")).filter(F.col("category").isNotNull())
    return rows.groupBy(S.strip_category_prefix(F.col("category")).alias("category")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).withColumn("percent", 100.0 * F.col("n") / F.lit(total))


def category_totals(entries: DataFrame) -> DataFrame:
    """One row: entries, those without any category and their share in percent, and the number of categories."""
    held = F.filter(F.coalesce("categories", F.array().cast("array<string>")), lambda c: c.isNotNull())
    one = entries.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(held) == 0).alias("uncategorised"))
    names = entries.select(F.explode(held).alias("c")).select(S.strip_category_prefix(F.col("c")).alias("c")).distinct().agg(F.count(F.lit(1)).alias("n_categories"))
    return one.withColumn("n_categories", F.lit(names.first()[0]).cast("long")).select("n", "uncategorised", F.coalesce(F.try_divide(100.0 * F.col("uncategorised"), F.col("n")), F.lit(0.0)).alias("uncategorised_pct"), "n_categories")


def list_stage(df: DataFrame, lists: list[str], texts: list[str]) -> DataFrame:
    """Per column the rows, the share in percent that isn't empty, and the mean length of lists (null for texts), rows without a list counting as 0."""
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)))
    parts = [F.struct(F.lit(c).alias("stage"), (size(c) > 0).alias("held"), size(c).cast("double").alias("size")) for c in lists]
    parts += [F.struct(F.lit(c).alias("stage"), S.filled(F.col(c)).alias("held"), F.lit(None).cast("double").alias("size")) for c in texts]
    rows = df.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), (100.0 * F.count_if("held") / F.count(F.lit(1))).alias("held_pct"), F.avg("size").alias("mean_size"))


def completeness(kb: DataFrame) -> DataFrame:
    """One row: entities and the percentage that have each text or list; nulls for an empty table."""
    share = lambda c: F.try_divide(100.0 * F.count_if(c), F.count(F.lit(1)))
    have = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return kb.agg(
        F.count(F.lit(1)).alias("n"), share(S.filled(F.col("desc"))).alias("desc_pct"), share(S.filled(F.col("intro"))).alias("intro_pct"),
        share(S.filled(F.col("infobox_img"))).alias("infobox_pct"), share(have("page_imglist")).alias("page_images_pct"), share(have("commons_imglist")).alias("commons_images_pct"),
    )


def summary(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Long form: one row per measure with count, mean, median, maximum and distinct values of the non-null values. The median is exact."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), c.cast("double").alias("value")) for k, c in columns.items()])).alias("m")).select("m.*")
    v = F.col("value")
    values = stacked.groupBy("measure", "value").agg(F.count(v).alias("n"), F.sum(v).alias("s"))
    plain = values.groupBy("measure").agg(F.sum("n").alias("n"), F.try_divide(F.sum("s"), F.sum("n")).alias("mean"), F.max(v).alias("max"), F.count(v).alias("n_distinct"))
    middle = quantiles(stacked, "value", {"median": 0.5}, ["measure"])
    return plain.join(middle, "measure", "left").select("measure", "n", "mean", "median", "max", "n_distinct")


def bucket(c: Column, edges: list[tuple[int, int | None, str]]) -> Column:
    out = F.when(F.lit(False), "")
    for low, high, name in edges:
        out = out.when((c >= low) & (c <= high) if high is not None else c >= low, name)
    return out


def bucket_counts(df: DataFrame, value: Column, edges: list[tuple[int, int | None, str]]) -> DataFrame:
    """Rows per bucket, empty buckets included; values in no bucket aren't counted."""
    spine = df.sparkSession.createDataFrame([(name,) for *_, name in edges], "bucket string")
    got = df.select(bucket(value, edges).alias("bucket")).filter(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    return spine.join(got, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, clip_percentile: float | None = None) -> DataFrame:
    """(bin, n): bins are closed below and open above but for the last; values outside aren't counted, nor those beyond the percentile."""
    rows = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    if clip_percentile is not None:
        bound = quantiles(rows, "v", {"b": clip_percentile}).first()["b"]
        rows = rows.filter(F.col("v") <= F.lit(bound))
    width = (high - low) / bins
    at = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("int")
    return rows.filter(F.col("v").between(low, high)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def ecdf(df: DataFrame, value: str, key: str) -> DataFrame:
    """(key, value, y): y is the share of rows up to and with this one, in the order of value and key.

    Rows are range-partitioned; only one count a partition is looked at together, so no task sorts everything.
    """
    rows = df.select(key, F.col(value).alias("value")).filter(F.col("value").isNotNull())
    placed = cut(rows.repartitionByRange("value", key).sortWithinPartitions("value", key).withColumn("pid", F.spark_partition_id()))
    sizes = placed.groupBy("pid").agg(F.count(F.lit(1)).alias("c"))  # one row a partition
    before = sizes.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("c").over(Window.partitionBy()))
    rank = F.row_number().over(Window.partitionBy("pid").orderBy("value", key))
    return placed.withColumn("rank", rank).join(F.broadcast(before), "pid").select(key, "value", ((F.col("rank") + F.col("before")) / F.col("all")).alias("y"))


def pool_types(instances: DataFrame, kb: DataFrame) -> DataFrame:
    """(instance_id, n_types, answer_is_majority) over the text candidates that are in kb.

    The majority type is the most frequent one, of equally frequent ones that of the earliest candidate. kb: unique qid, type.
    """
    rows = instances.select("instance_id", "answer", F.posexplode("text_candidates").alias("pos", "qid")).join(kb.select("qid", "type"), "qid")
    by_type = rows.groupBy("instance_id", "type").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    per = by_type.groupBy("instance_id").agg(F.count(F.lit(1)).alias("n_types"), F.max_by("type", F.struct("n", -F.col("pos"))).alias("majority"))
    answers = instances.select("instance_id", "answer").join(kb.select(F.col("qid").alias("answer"), F.col("type").alias("answer_type")), "answer", "left")
    return per.join(answers, "instance_id").select("instance_id", F.col("n_types"), F.coalesce(F.col("majority").eqNullSafe(F.col("answer_type")) & F.col("answer_type").isNotNull(), F.lit(False)).alias("answer_is_majority"))


def word_frequency(df: DataFrame, text: str, stopwords: tuple[str, ...] = (), distinct: bool = False) -> DataFrame:
    rows = df.select(text).distinct() if distinct else df
    return rows.select(F.explode(S.word_tokens(F.col(text), stopwords)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
