"""The knowledge base and the mention entries put together from flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorline.functions import strings as S
from anchorline.operators.arrays import in_order
from anchorline.operators.closure import reachable


def special_pages(types: DataFrame, data: DataFrame) -> DataFrame:
    """(qid) of pages that are no entities: with a null type, or an article named as a disambiguation page."""
    untyped = types.filter(F.col("type").isNull()).select("qid")
    return untyped.unionByName(data.filter(F.col("url_wikipedia").rlike(r"(?i)\(disambiguation\)")).select("qid")).distinct()


def stripped_users(images: DataFrame, special: DataFrame, key: str = "filename") -> DataFrame:
    """(key, used_by) without special pages and nulls, in order; images whose users are all gone keep an empty list."""
    users = images.select(key, F.posexplode("used_by").alias("pos", "qid")).join(special, "qid", "left_anti").filter(F.col("qid").isNotNull())
    lists = users.groupBy(key).agg(in_order("pos", F.col("qid")).alias("used_by"))
    return images.select(key).distinct().join(lists, key, "left").select(key, F.coalesce("used_by", F.array().cast("array<string>")).alias("used_by"))


def knowledge_base(data: DataFrame, types: DataFrame, intros: DataFrame, portraits: DataFrame) -> DataFrame:
    """One row per entity of data, with defaults for what is missing. All sides have unique qids."""
    rows = data.join(types, "qid", "left").join(intros, "qid", "left").join(portraits, "qid", "left")
    empty = F.lit("")
    return rows.select("qid", S.or_else(F.col("name"), F.col("qid")).alias("name"), F.coalesce("desc", empty).alias("desc"), F.coalesce("intro", empty).alias("intro"), S.or_else(F.col("type"), F.lit("OTHER")).alias("type"), "infobox_img", F.coalesce("url_wikipedia", empty).alias("url_wikipedia"))


def image_lists(files: DataFrame, images: DataFrame, portraits: DataFrame) -> DataFrame:
    """(qid, pos, ...) of the files of each entity that have image data; is_infobox compares names under one spelling.

    files: (qid, files ARRAY<STRING>); images: unique filename; portraits: (qid, infobox_img).
    """
    rows = files.select("qid", F.posexplode("files").alias("pos", "filename")).join(images, "filename").join(portraits, "qid", "left")
    same = F.when(S.filled(F.col("infobox_img")), S.image_name(F.col("filename")) == S.image_name(F.col("infobox_img"))).otherwise(False)
    return rows.select("qid", "pos", "url", "used_by", F.size("used_by").alias("n_used_by"), same.alias("is_infobox"), "width", "height", F.coalesce("mime", F.lit("")).alias("mime"), F.coalesce("license", F.lit("")).alias("license"))


def nested_entities(kb: DataFrame, page: DataFrame, commons: DataFrame) -> DataFrame:
    """kb with its two image lists nested; page and commons as from image_lists."""
    fields = ("url", "used_by", "n_used_by", "is_infobox", "width", "height", "mime", "license")
    out = kb
    for rows, name in ((page, "page_imglist"), (commons, "commons_imglist")):
        lists = rows.groupBy("qid").agg(in_order("pos", F.struct(*fields)).alias(name))
        out = out.join(lists, "qid", "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
    return out


def candidates(links: DataFrame, known: DataFrame) -> DataFrame:
    """(ord, pos, qid): the known entities of each page in order of their first mention; pages with fewer than two are left out."""
    rows = links.select("ord", F.posexplode("qids").alias("pos", "qid")).join(known.select("qid"), "qid", "left_semi")
    first = rows.groupBy("ord", "qid").agg(F.min("pos").alias("pos"))
    enough = first.groupBy("ord").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("ord")
    return first.join(enough, "ord", "left_semi").select("ord", "pos", "qid")


def _anchored(entity: Column, others: Column, everyone: Column) -> Column:
    """Whether an image of the entity is used outside the candidates but by no other candidate."""
    usable = F.filter(entity["page_imglist"], lambda im: ~F.coalesce(im["is_infobox"], F.lit(False)))
    users = lambda im: F.filter(F.coalesce(im["used_by"], F.array().cast("array<string>")), lambda u: u.isNotNull())
    return F.exists(usable, lambda im: (F.size(F.array_intersect(users(im), others)) == 0) & (F.size(F.array_except(users(im), everyone)) > 0))


def visual_counts(entries: DataFrame) -> DataFrame:
    """(entry_id, n_entities, n_visual_ambiguities, n_grounded_entities) from nested entries, inside each row.

    Shared images are those with two or more candidates among their users, counted by url.
    """
    known = F.filter(F.coalesce("ambiguities", F.array().cast(entries.schema["ambiguities"].dataType)), lambda e: e.isNotNull() & e["qid"].isNotNull())
    rows = entries.select("entry_id", known.alias("e")).withColumn("all", F.array_distinct(F.transform("e", lambda e: e["qid"])))
    empty = F.array().cast("array<string>")

    def shared(e: Column) -> Column:
        images = F.filter(F.coalesce(e["page_imglist"], F.array().cast(entries.schema["ambiguities"].dataType.elementType["page_imglist"].dataType)), lambda im: im.isNotNull() & im["url"].isNotNull())
        hits = F.filter(images, lambda im: F.size(F.array_intersect(F.coalesce(im["used_by"], empty), F.col("all"))) >= 2)
        return F.transform(hits, lambda im: im["url"])

    anchored = F.filter("e", lambda e: F.coalesce(_anchored(e, F.array_remove(F.col("all"), e["qid"]), F.col("all")), F.lit(False)))
    return rows.select("entry_id", F.size("all").alias("n_entities"), F.size(F.array_distinct(F.flatten(F.transform("e", shared)))).alias("n_visual_ambiguities"), F.size(anchored).alias("n_grounded_entities")).distinct()


def coarse_types(membership: DataFrame, subclass: DataFrame, roots: dict[str, str], barred: str | None = None) -> DataFrame:
    """(qid, type): the coarse type of each member by the roots its classes fall under; PERS before ORG before LOC; null under no root.

    membership: (qid, cls); subclass: (child, parent). Members of the barred class or its subclasses have no type.
    """
    spark = membership.sparkSession
    seeds = spark.createDataFrame([(r,) for r in [*roots, *([barred] if barred else [])]], "seed string")
    under = reachable(seeds, subclass.select(F.col("parent").alias("src"), F.col("child").alias("dst"))).select("seed", F.col("node").alias("cls"))
    typed = membership.join(under, "cls")
    rank = F.when(F.lit(False), 0)
    name = F.when(F.lit(False), "")
    for root, t in roots.items():
        rank = rank.when(F.col("seed") == root, S.TYPE_PRIORITY.get(t, 9))
        name = name.when(F.col("seed") == root, t)
    best = typed.groupBy("qid").agg(F.min_by(name, rank).alias("type"), F.coalesce(F.max(F.col("seed") == F.lit(barred)), F.lit(False)).alias("out"))
    return membership.select("qid").distinct().join(best, "qid", "left").select("qid", F.when(~F.coalesce("out", F.lit(False)), F.col("type")).alias("type"))
