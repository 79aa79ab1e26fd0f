"""Queries of the descriptive statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.functions import strings as S
from anchorline.plans import stats
from anchorline.registry import query
from anchorline.session import read_table

_ONE = "i as (select distinct instance_id, mention, image, answer, text_candidates, visual_candidates from instances)"


def _instances(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "instances").distinct()


@query("""with m as (select entry_id, list_distinct(any_value(categories)) c from mention_entries group by 1), t as (select count(*) n from m)
select regexp_replace(c, '^Category:', '') category, count(*) n, 100.0 * count(*) / (select n from t) percent from (select unnest(c) c from m) where c is not null group by 1 having count(*) >= 2""")
def category_frequency(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "mention_entries").groupBy("entry_id").agg(F.first("categories").alias("categories"))
    return stats.category_frequency(m, 2)


@query("""with m as (select entry_id, list_filter(coalesce(any_value(categories), []), lambda c: c is not null) c from mention_entries group by 1)
select count(*) n, cast(count_if(len(c) = 0) as bigint) uncategorised, 100.0 * count_if(len(c) = 0) / count(*) uncategorised_pct, (select count(distinct regexp_replace(x, '^Category:', '')) from (select unnest(c) x from m)) n_categories from m""")
def category_totals(spark: SparkSession, d: str) -> DataFrame:
    """Entries, those without any category, and the number of categories."""
    return stats.category_totals(read_table(spark, d, "mention_entries").groupBy("entry_id").agg(F.first("categories").alias("categories")))


_STAGES = " union all ".join(
    [f"""select '{c}' stage, count(*) n, 100.0 * count_if(coalesce(len({c}), 0) > 0) / count(*) held_pct, avg(coalesce(len({c}), 0)) mean_size from entity_kb""" for c in ("page_imglist", "commons_imglist")]
    + [f"""select '{c}', count(*), 100.0 * count_if(coalesce(length({c}), 0) > 0) / count(*), null from entity_kb""" for c in ("intro", "infobox_img")]
)


@query(_STAGES)
def stage_summaries(spark: SparkSession, d: str) -> DataFrame:
    """What each stage of collection brought: lists with their mean length, and texts."""
    return stats.list_stage(read_table(spark, d, "entity_kb"), ["page_imglist", "commons_imglist"], ["intro", "infobox_img"])


@query("select nullif(trim(type), '') as type, count(*) n from (select distinct qid, type from entity_kb) group by 1")
def kb_type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entities per type, the null type included."""
    return stats.counts(read_table(spark, d, "entity_kb").select("qid", "type").distinct(), F.nullif(F.trim("type"), F.lit("")), "type")


_PCT = "100.0 * sum(cast(coalesce({} > 0, false) as int)) / count(*)"


@query(f"""select count(*) n, {_PCT.format('length("desc")')} desc_pct, {_PCT.format("length(intro)")} intro_pct, {_PCT.format("length(infobox_img)")} infobox_pct,
{_PCT.format("len(page_imglist)")} page_images_pct, {_PCT.format("len(commons_imglist)")} commons_images_pct from entity_kb""")
def kb_type_completeness(spark: SparkSession, d: str) -> DataFrame:
    return stats.completeness(read_table(spark, d, "entity_kb"))


@query(f"""with {_ONE}, m as (select unnest([{{'measure': 'text', 'v': cast(len(text_candidates) as double)}}, {{'measure': 'visual', 'v': len(visual_candidates)}}, {{'measure': 'width', 'v': image.width}}, {{'measure': 'uses', 'v': image.n_used_by}}]) x from i)
select x.measure measure, count(x.v) n, avg(x.v) mean, quantile_cont(x.v, 0.5) median, max(x.v) as max, count(distinct x.v) n_distinct from m group by 1""")
def size_summary(spark: SparkSession, d: str) -> DataFrame:
    # size() of a null is null under ANSI
    return stats.summary(_instances(spark, d), {"text": F.size("text_candidates"), "visual": F.size("visual_candidates"), "width": F.col("image.width"), "uses": F.col("image.n_used_by")})


@query(f"with {_ONE} select mention, count(*) n, min(instance_id) as first from i where mention is not null group by 1 order by n desc, first, mention limit 50")
def top_mentions(spark: SparkSession, d: str) -> DataFrame:
    return stats.top(_instances(spark, d), "mention", "instance_id", 50)


@query(f"with {_ONE} select image.license license, count(*) n, min(instance_id) as first from i where image.license is not null group by 1 order by n desc, first, license limit 8")
def license_top8(spark: SparkSession, d: str) -> DataFrame:
    return stats.top(_instances(spark, d).select("instance_id", "image.license"), "license", "instance_id", 8)


def _spine(names: list[str], body: str) -> str:
    return f"with {_ONE}, b as ({body}), s as (select unnest({names}) bucket) select s.bucket bucket, count(b.bucket) n from s left join b on s.bucket = b.bucket group by 1"


@query(_spine(["1", "2", "3", "4-5", "6+"], "select case when c <= 3 then cast(c as varchar) when c <= 5 then '4-5' else '6+' end bucket from (select count(*) c from i where mention is not null group by mention)"))
def instances_per_mention_buckets(spark: SparkSession, d: str) -> DataFrame:
    per = stats.counts(_instances(spark, d).filter("mention is not null"), "mention", "mention")
    return stats.bucket_counts(per, F.col("n"), [(1, 1, "1"), (2, 2, "2"), (3, 3, "3"), (4, 5, "4-5"), (6, None, "6+")])


@query(_spine(["1", "2", "3", "4+"], r"select case when c <= 3 then cast(c as varchar) else '4+' end bucket from (select len(list_filter(regexp_split_to_array(mention, '[\s\x{a0}]+'), lambda w: w <> '')) c from i where mention is not null) where c >= 1"))
def word_count_buckets(spark: SparkSession, d: str) -> DataFrame:
    return stats.bucket_counts(_instances(spark, d), S.word_count(F.col("mention")), [(1, 1, "1"), (2, 2, "2"), (3, 3, "3"), (4, None, "4+")])


@query(_spine(["2", "3", "4", "5", "6+"], "select case when c <= 5 then cast(c as varchar) else '6+' end bucket from (select len(visual_candidates) c from i) where c >= 2"))
def visual_size_buckets(spark: SparkSession, d: str) -> DataFrame:
    return stats.bucket_counts(_instances(spark, d), F.size("visual_candidates"), [(2, 2, "2"), (3, 3, "3"), (4, 4, "4"), (5, 5, "5"), (6, None, "6+")])


_TYPES = f"""with {_ONE}, kb as (select qid, coalesce(min(nullif(upper(trim(type)), '')), 'OTHER') as type from entity_kb where qid is not null group by 1),
r as (select instance_id, unnest(text_candidates) q, generate_subscripts(text_candidates, 1) - 1 pos from i), t as (select instance_id, kb.type as type, count(*) n, min(pos) pos from r join kb on q = qid group by all),
p as (select instance_id, count(*) n_types, arg_max(type, n * 1000000 - pos) majority from t group by 1)
"""


def _pool_types(spark: SparkSession, d: str) -> DataFrame:
    kb = read_table(spark, d, "entity_kb").filter("qid is not null").groupBy("qid").agg(F.coalesce(F.min(F.nullif(F.upper(F.trim("type")), F.lit(""))), F.lit("OTHER")).alias("type"))
    return stats.pool_types(_instances(spark, d), kb)


@query(_TYPES + "select n_types, count(*) n from p group by 1")
def pool_homogeneity(spark: SparkSession, d: str) -> DataFrame:
    return stats.counts(_pool_types(spark, d), "n_types", "n_types")


@query(_TYPES + "select p.instance_id instance_id, n_types, coalesce(majority = kb.type, false) answer_is_majority from p join i using (instance_id) left join kb on answer = qid")
def answer_is_majority(spark: SparkSession, d: str) -> DataFrame:
    return _pool_types(spark, d)


@query("""with v as (select l_extendedprice x from lineitem), b as (select quantile_cont(x, 0.99) b from v)
select cast(least(floor(x / 5000.0), 19) as int) bin, count(*) n from v, b where x <= b and x between 0 and 100000 group by 1""")
def histogram_fixed(spark: SparkSession, d: str) -> DataFrame:
    return stats.histogram(read_table(spark, d, "lineitem"), "l_extendedprice", 0.0, 100000.0, 20, 0.99)


@query(f"with {_ONE} select instance_id, image.width / image.height aspect, image.width * image.height / 1e6 megapixels from i where image.width > 0 and image.height > 0")
def aspect_megapixel(spark: SparkSession, d: str) -> DataFrame:
    w, h = F.col("image.width"), F.col("image.height")
    return _instances(spark, d).filter((w > 0) & (h > 0)).select("instance_id", (w / h).alias("aspect"), (w.cast("long") * h / 1e6).alias("megapixels"))


@query("select o_orderkey, o_totalprice as value, row_number() over (order by o_totalprice, o_orderkey) / count(*) over () y from orders where o_totalprice is not null")
def ecdf(spark: SparkSession, d: str) -> DataFrame:
    return stats.ecdf(read_table(spark, d, "orders"), "o_totalprice", "o_orderkey")


@query("select distinct q.qid qid from (select unnest(used_by) qid from image_data) q where qid is not null")
def distinct_users(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "image_data").select(F.explode("used_by").alias("qid")).distinct().filter("qid is not null")


@query("select count(distinct im.url) n_images from (select unnest(page_imglist) im from entity_kb)")
def distinct_image_count(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "entity_kb").select(F.explode("page_imglist").alias("im")).agg(F.count_distinct("im.url").alias("n_images"))


@query("""select count(*) n, 100.0 * sum(cast(coalesce(len(used_by) > 0, false) as int)) / count(*) used_pct, avg(len(used_by)) mean_users, max(len(used_by)) max_users from image_data""".replace("max(len(used_by))", "cast(max(len(used_by)) as int)"))
def image_stage_summary(spark: SparkSession, d: str) -> DataFrame:
    n = F.size("used_by")
    return read_table(spark, d, "image_data").agg(F.count(F.lit(1)).alias("n"), (100.0 * F.count_if(F.coalesce(n > 0, F.lit(False))) / F.count(F.lit(1))).alias("used_pct"), F.avg(n).alias("mean_users"), F.max(n).alias("max_users"))
