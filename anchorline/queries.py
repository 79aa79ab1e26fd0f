"""Queries of the core by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from anchorline.operators import nested, usage
from anchorline.registry import ORACLE, QUERIES, query
from anchorline.session import read_table

__all__ = ["ORACLE", "QUERIES"]

_IMAGES_SQL = """
with e as (select entry_id, unnest(ambiguities) e, generate_subscripts(ambiguities, 1) - 1 entity_idx from mention_entries),
i as (select entry_id, entity_idx, e.qid qid, 'page_imglist' img_list, unnest(e.page_imglist) im, generate_subscripts(e.page_imglist, 1) - 1 image_idx from e
      union all
      select entry_id, entity_idx, e.qid, 'commons_imglist', unnest(e.commons_imglist), generate_subscripts(e.commons_imglist, 1) - 1 from e)
"""


@query(_IMAGES_SQL + """
select distinct entry_id, qid, img_list, im.url url from i
where im.url <> '' and qid is not null and not coalesce(list_contains(im.used_by, qid), false)""")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Images that don't name the entity they are listed under."""
    return nested.unnamed_images(spark.read.schema(nested.LINK_SCHEMA).parquet(f"{d}/mention_entries.parquet"))


@query("""select distinct entry_id, mention, n_entities, n_visual_ambiguities, n_grounded_entities, cast(coalesce(len(categories), 0) as int) n_categories
from mention_entries""")
def p3_entries(spark: SparkSession, d: str) -> DataFrame:
    return nested.entries(read_table(spark, d, "mention_entries"))


@query(_IMAGES_SQL + """
select distinct entry_id, cast(entity_idx as int) entity_idx, e.qid qid, e.name as name, e."desc" as "desc", e.intro intro, e.type as type, e.infobox_img infobox_img,
e.url_wikipedia url_wikipedia from e where e is not null""")
def p3_entities(spark: SparkSession, d: str) -> DataFrame:
    return nested.entities(read_table(spark, d, "mention_entries"))


@query(_IMAGES_SQL + """
select distinct entry_id, cast(entity_idx as int) entity_idx, qid, img_list, cast(image_idx as int) image_idx, im.url url, im.n_used_by n_used_by,
im.is_infobox is_infobox, im.width width, im.height height, im.mime mime, im.license license,
case when qid is not null then coalesce(list_contains(im.used_by, qid), false) end names_entity from i where im is not null""")
def p3_images(spark: SparkSession, d: str) -> DataFrame:
    return nested.images(read_table(spark, d, "mention_entries"))


@query(_IMAGES_SQL + """
, u as (select entry_id, entity_idx, qid, img_list, image_idx, im.url url, unnest(im.used_by) user_qid, generate_subscripts(im.used_by, 1) - 1 user_idx from i)
select distinct entry_id, cast(entity_idx as int) entity_idx, qid, img_list, cast(image_idx as int) image_idx, url, cast(user_idx as int) user_idx, user_qid
from u where user_qid is not null""")
def p3_image_users(spark: SparkSession, d: str) -> DataFrame:
    return nested.image_users(read_table(spark, d, "mention_entries"))


_USAGE_SQL = """select url, count(*) n_rows, count(distinct qid) n_entities, max(n_used_by) n_reported, max(n_used_by) <> count(distinct qid) differs
from image_usage where url is not null group by url"""


@query(f"select url from ({_USAGE_SQL}) where differs")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Images whose reported use count isn't the number of entities that use them."""
    return usage.usage_by_url(read_table(spark, d, "image_usage")).filter("differs").select("url")


@query(_USAGE_SQL)
def p4_usage(spark: SparkSession, d: str) -> DataFrame:
    return usage.usage_by_url(read_table(spark, d, "image_usage"))


from anchorline import queries_annotation, queries_knowledge, queries_split, queries_stats, queries_text  # noqa: E402,F401
