"""Deeply nested mention entries as related flat tables.

Each table is one projection: nested transform calls attach the keys and list positions of all ancestors, flatten joins the
arrays of a level, and a single inline emits the rows. Nothing is exploded step by step, so no intermediate row repeats the
text of its parents. A level that is null or empty emits no rows for its children; null elements emit none either but keep
their position, so positions always refer to the source list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.session import pick

LISTS = ("page_imglist", "commons_imglist")
ENTITY_FIELDS = ("name", "desc", "intro", "type", "infobox_img", "url_wikipedia")
IMAGE_FIELDS = ("n_used_by", "is_infobox", "width", "height", "mime", "license")
_LINK = "array<struct<url:string,used_by:array<string>>>"
#: What unnamed_images reads of the table. Catalyst doesn't prune fields inside lambdas, so the scan is given the columns it needs.
LINK_SCHEMA = f"entry_id bigint, ambiguities array<struct<qid:string,page_imglist:{_LINK},commons_imglist:{_LINK}>>"


def _each(items: Column, row: Callable[[Column, Column], Column]) -> Column:
    """row(element, position) for each element that isn't null."""
    return F.filter(F.transform(items, lambda x, i: F.when(x.isNotNull(), row(x, i))), lambda x: x.isNotNull())


def _join(arrays: Column) -> Column:
    return F.flatten(F.filter(arrays, lambda x: x.isNotNull()))


def _entity_keys(e: Column, i: Column) -> list[Column]:
    return [F.col("entry_id").alias("entry_id"), i.alias("entity_idx"), e["qid"].alias("qid")]


def _per_image(row: Callable[[Column, Column, str, Column, Column], Column]) -> Column:
    """row(entity, its position, list, image, its position) over all images of an entry; the value of row is an array."""

    def images(e: Column, i: Column) -> Column:
        def of(name: str) -> Column:
            return _join(F.transform(e[name], lambda im, k: F.when(im.isNotNull(), row(e, i, name, im, k))))

        return _join(F.array(*map(of, LISTS)))

    return _join(F.transform("ambiguities", images))


def entries(df: DataFrame) -> DataFrame:
    """One row per entry; copies of an entry are one row. Columns of df that aren't named here are left out."""
    rows = pick(df, "entry_id", "mention", "categories", "n_entities", "n_visual_ambiguities", "n_grounded_entities")
    return rows.select("entry_id", "mention", "n_entities", "n_visual_ambiguities", "n_grounded_entities", F.size(F.coalesce("categories", F.array().cast("array<string>"))).alias("n_categories")).distinct()


def entities(df: DataFrame, distinct: bool = True) -> DataFrame:
    """One row per entity and entry, keyed by (entry_id, entity_idx); copies of an entry are kept if not distinct."""
    rows = _each(F.col("ambiguities"), lambda e, i: F.struct(*_entity_keys(e, i), *[e[f].alias(f) for f in ENTITY_FIELDS]))
    out = pick(df, "entry_id", "ambiguities").select(F.inline(rows))
    return out.distinct() if distinct else out


def images(df: DataFrame, fields: tuple[str, ...] = IMAGE_FIELDS, distinct: bool = True) -> DataFrame:
    """One row per image in a list, keyed by (entry_id, entity_idx, img_list, image_idx).

    names_entity tells whether the image's used_by holds the entity's qid; a null or empty used_by doesn't, and for an entity without qid
    it is null.
    """

    def row(e: Column, i: Column, name: str, im: Column, k: Column) -> Column:
        named = F.when(e["qid"].isNotNull(), F.coalesce(F.array_contains(F.coalesce(im["used_by"], F.array().cast("array<string>")), e["qid"]), F.lit(False)))
        return F.array(F.struct(*_entity_keys(e, i), F.lit(name).alias("img_list"), k.alias("image_idx"), im["url"].alias("url"), *[im[f].alias(f) for f in fields], named.alias("names_entity")))

    out = pick(df, "entry_id", "ambiguities").select(F.inline(_per_image(row)))
    return out.distinct() if distinct else out


def image_users(df: DataFrame) -> DataFrame:
    """One row per user in an image's used_by, keyed by (entry_id, entity_idx, img_list, image_idx, user_idx)."""

    def row(e: Column, i: Column, name: str, im: Column, k: Column) -> Column:
        return _each(im["used_by"], lambda u, j: F.struct(*_entity_keys(e, i), F.lit(name).alias("img_list"), k.alias("image_idx"), im["url"].alias("url"), j.alias("user_idx"), u.alias("user_qid")))

    return pick(df, "entry_id", "ambiguities").select(F.inline(_per_image(row))).distinct()


def unnamed_images(df: DataFrame) -> DataFrame:
    """Images with a url whose used_by lacks the qid of the entity that lists them; entities without qid give no row."""
    return images(df, ()).filter((F.col("url") != "") & ~F.col("names_entity")).select("entry_id", "qid", "img_list", "url").distinct()
