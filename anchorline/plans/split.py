"""Instances: images and mentions whose candidate sets share exactly one entity.

Everything works on four flat tables; nested entries are taken apart once and put together again only in the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from anchorline.functions import strings as S
from anchorline.operators import nested
from anchorline.operators.arrays import have_repeat
from anchorline.session import cut


@dataclass(frozen=True)
class SplitRules:
    """Filters of a split. A maximum of 0 means none."""

    types: tuple[str, ...] = ("PERS", "ORG", "LOC")
    need_intro: bool = True
    need_infobox: bool = True
    mime: str = "image/jpeg"
    min_side: int = 250
    min_uses: int = 2
    max_uses: int = 10
    min_mention: int = 3
    ban: tuple[str, ...] = ("and",)
    no_leading_digit: bool = True
    min_pool: int = 2
    max_pool: int = 0
    min_visual: int = 2
    max_visual: int = 0
    unique_portraits: bool = False
    share_type: bool = False
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, settings: dict) -> SplitRules:
        """Rules from settings by name, lists becoming tuples; an unknown name raises TypeError."""
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in settings.items()})


def mention_ok(mention: Column, rules: SplitRules) -> Column:
    """A surface form without banned words, long enough, with a letter; a null one isn't ok."""
    ok = (F.length(mention) >= rules.min_mention) & mention.rlike(r"\p{L}")
    if rules.ban:
        ok = ok & ~mention.rlike(S.whole_word(rules.ban))
    if rules.no_leading_digit:
        ok = ok & ~mention.rlike(rf"(?U)^{S.SPACE}*\d")
    return F.coalesce(ok, F.lit(False))


def categories_ok(categories: Column, rules: SplitRules) -> Column:
    have = F.coalesce(categories, F.array().cast("array<string>"))
    ok = F.lit(True)
    if rules.include:
        ok = ok & F.coalesce(F.arrays_overlap(have, F.array(*map(F.lit, rules.include))), F.lit(False))
    if rules.exclude:
        ok = ok & ~F.coalesce(F.arrays_overlap(have, F.array(*map(F.lit, rules.exclude))), F.lit(False))
    return ok


def in_categories(entries: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """categories_ok for lists of categories that are tables (category): entries in one of include and in none of exclude."""
    held = entries.select("entry_id", F.explode("categories").alias("category")).distinct()
    for names, how in ((include, "left_semi"), (exclude, "left_anti")):
        if names is not None:
            entries = entries.join(held.join(names.select("category").distinct(), "category", "left_semi").select("entry_id").distinct(), "entry_id", how)
    return entries


def entity_ok(rules: SplitRules, name: Column | None = None) -> Column:
    """A real name, a text or portrait (each of them where required), and a wanted type."""
    intro, portrait = S.filled(F.col("intro")), S.filled(F.col("infobox_img"))
    ok = ~F.coalesce((name if name is not None else F.col("name")).rlike(r"^Q\d+$"), F.lit(False)) & (intro | portrait)
    if rules.need_intro:
        ok = ok & intro
    if rules.need_infobox:
        ok = ok & portrait
    return ok & S.or_else(F.col("type"), F.lit("OTHER")).isin(*rules.types)


def size_ok(n: Column, least: int, most: int) -> Column:
    return (n >= least) & (n <= most) if most else n >= least


def image_ok(rules: SplitRules) -> Column:
    uses, zero = F.coalesce(F.col("n_used_by"), F.lit(0)), F.lit(0)
    sides = F.least(F.coalesce("width", zero), F.coalesce("height", zero))
    return F.coalesce(F.col("mime") == rules.mime, F.lit(False)) & (sides >= rules.min_side) & uses.between(rules.min_uses, rules.max_uses)


@dataclass
class Scan:
    """entries (entry_id, mention), kept and pool (entry_id, entity_idx, qid), kb (qid, ...), uses (entry_id, entity_idx, image_idx, qid, url), images (url, ...)."""

    entries: DataFrame
    kept: DataFrame
    pool: DataFrame
    kb: DataFrame
    uses: DataFrame
    images: DataFrame


def _first(df: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Per key the fields of its first row."""
    return df.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("f")).select(key, "f.*")


def scan(mentions: DataFrame, rules: SplitRules, excluded: DataFrame | None = None) -> Scan:
    """Filter and flatten nested mention entries; excluded: (qid) to leave out everywhere."""
    entries = mentions.filter(mention_ok(F.col("mention"), rules) & categories_ok(F.col("categories"), rules))
    # copies go only after the texts are gone, and each flat table is written once instead of being taken out of the nested rows by every reader
    flat = nested.entities(entries, distinct=False).filter(F.col("qid").isNotNull() & entity_ok(rules))
    listed = cut(flat.select("entry_id", "entity_idx", "qid", "name", "type", "infobox_img").distinct())
    sizes = listed.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n")).filter(size_ok(F.col("n"), rules.min_pool, rules.max_pool))
    listed = listed.join(sizes.select("entry_id"), "entry_id", "left_semi")
    body = nested.images(entries, distinct=False).filter((F.col("img_list") == "page_imglist") & S.filled(F.col("url")) & ~F.coalesce("is_infobox", F.lit(False)))
    shown = body.select("entry_id", "entity_idx", "image_idx", "qid", "url", "n_used_by", "width", "height", "mime", "license").distinct()
    uses = cut(shown.join(listed.select("entry_id", "entity_idx"), ["entry_id", "entity_idx"], "left_semi"))
    kept = listed
    if excluded is not None:
        kept = listed.join(excluded, "qid", "left_anti")
        uses = uses.join(excluded, "qid", "left_anti")
    kb = _first(kept, "qid", ["entry_id", "entity_idx"], ["name", "type", "infobox_img"])
    images = _first(uses, "url", ["entry_id", "entity_idx", "image_idx"], ["n_used_by", "width", "height", "mime", "license"])
    kept = kept.select("entry_id", "entity_idx", "qid")
    pool = kept
    if excluded is not None:
        still = pool.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n")).filter(size_ok(F.col("n"), rules.min_pool, rules.max_pool))
        pool = pool.join(still, "entry_id", "left_semi")
    return Scan(mentions.select("entry_id", "mention").distinct(), kept, pool, kb, uses.select("entry_id", "entity_idx", "image_idx", "qid", "url"), images)


def kb_rows(mentions: DataFrame, s: Scan) -> DataFrame:
    """The kept entities with their texts, each from the first place that lists it."""
    flat = nested.entities(mentions, distinct=False).join(s.kept.select("entry_id", "entity_idx"), ["entry_id", "entity_idx"], "left_semi")
    return _first(flat, "qid", ["entry_id", "entity_idx"], ["name", "type", "desc", "intro", "infobox_img", "url_wikipedia"])


def visual_pools(s: Scan) -> DataFrame:
    """(url, visual_candidates): the kept entities that list the image, sorted."""
    return s.uses.groupBy("url").agg(F.array_sort(F.collect_set("qid")).alias("visual_candidates"))


def text_pools(s: Scan) -> DataFrame:
    return s.pool.groupBy("entry_id").agg(F.array_sort(F.collect_set("qid")).alias("text_candidates"))


def forbidden_entries(pool: DataFrame, edges: DataFrame, properties: tuple[str, ...]) -> DataFrame:
    """(entry_id) with two different candidates that an edge of a forbidden property links, in either direction. edges: (src, prop, dst)."""
    links = edges.filter(F.col("prop").isin(*properties) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct()
    a = pool.select("entry_id", F.col("qid").alias("src")).distinct()
    b = pool.select("entry_id", F.col("qid").alias("dst")).distinct()
    return a.join(links, "src").join(b, ["entry_id", "dst"], "left_semi").select("entry_id").distinct()


def portraits(kb: DataFrame) -> DataFrame:
    """(qid, portrait) under one spelling; entities without a portrait are left out."""
    return kb.filter(S.filled(F.col("infobox_img"))).select("qid", S.image_name(F.col("infobox_img")).alias("portrait"))


def shared_portrait_entries(s: Scan) -> DataFrame:
    """(entry_id) with two candidates that have the same portrait."""
    names = s.pool.select("entry_id", "qid").distinct().join(portraits(s.kb), "qid")
    return names.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("portrait").alias("d")).filter("n <> d").select("entry_id")


def qualifying_images(s: Scan, rules: SplitRules) -> DataFrame:
    """Images of enough quality that are nobody's portrait."""
    faces = portraits(s.kb).select(F.col("portrait").alias("image_name")).distinct()
    return s.images.filter(image_ok(rules)).withColumn("image_name", S.image_name(F.col("url"))).join(faces, "image_name", "left_anti").drop("image_name")


def judged_pairs(s: Scan, rules: SplitRules, edges: DataFrame | None = None) -> DataFrame:
    """Each distinct (url, mention) with the first reason to reject it, or none. The first page that has a pair decides about it."""
    pool = s.pool
    if rules.forbidden and edges is not None:
        pool = pool.join(forbidden_entries(pool, edges, rules.forbidden), "entry_id", "left_anti")
    if rules.unique_portraits:
        pool = pool.join(shared_portrait_entries(s), "entry_id", "left_anti")
    rows = s.uses.join(pool.select("entry_id", "entity_idx"), ["entry_id", "entity_idx"], "left_semi").join(s.entries, "entry_id")
    rows = rows.join(qualifying_images(s, rules), "url")
    pairs = rows.groupBy("url", "mention").agg(F.min_by("entry_id", F.struct("entry_id", "entity_idx", "image_idx")).alias("entry_id"))
    types = s.kb.select("qid", S.or_else(F.col("type"), F.lit("OTHER")).alias("type"))
    texts = pool.select("entry_id", "qid").distinct().join(types, "qid").groupBy("entry_id").agg(
        F.array_sort(F.collect_set("qid")).alias("text_candidates"), F.collect_list(F.struct("qid", "type")).alias("typed")
    )
    # pools are put together for images that qualify only, and only if they aren't too large: a sign that everybody uses never becomes an array
    shown = s.uses.select("url", "qid").distinct().join(pairs.select("url").distinct(), "url", "left_semi")
    if rules.max_visual:
        sizes = shown.groupBy("url").agg(F.count(F.lit(1)).alias("n_visual"))
        small = shown.join(sizes.filter(F.col("n_visual") <= rules.max_visual), "url", "left_semi")
        visual = sizes.join(small.groupBy("url").agg(F.array_sort(F.collect_set("qid")).alias("visual_candidates")), "url", "left")
    else:
        small = shown
        visual = shown.groupBy("url").agg(F.array_sort(F.collect_set("qid")).alias("visual_candidates")).withColumn("n_visual", F.size("visual_candidates"))
    if rules.unique_portraits:
        faces = small.join(portraits(s.kb), "qid")
        visual = visual.join(faces.groupBy("url").agg(have_repeat(F.collect_list("portrait")).alias("alike")), "url", "left")
    else:
        visual = visual.withColumn("alike", F.lit(False))
    both = pairs.join(visual, "url").join(texts, "entry_id").withColumn("common", F.array_intersect("text_candidates", "visual_candidates"))
    both = both.withColumn("answer", F.when(F.size("common") == 1, F.element_at("common", 1)))
    kind = F.element_at(F.filter("typed", lambda t: t["qid"] == F.col("answer")), 1)["type"]
    lonely = F.lit(False)
    if rules.share_type:
        lonely = F.size(F.filter("typed", lambda t: t["type"] == kind)) < 2
    reason = (
        F.when(~size_ok(F.col("n_visual"), rules.min_visual, rules.max_visual), "visual_pool")
        .when(F.coalesce("alike", F.lit(False)), "visual_portrait")
        .when(F.size("common") != 1, "intersection")
        .when(lonely, "type_not_shared")
        .otherwise("written")
    )
    return both.select("url", "mention", "entry_id", "answer", "text_candidates", "visual_candidates", reason.alias("reason"))


def instances(s: Scan, rules: SplitRules, edges: DataFrame | None = None) -> DataFrame:
    """The written pairs with the image's fields."""
    rows = judged_pairs(s, rules, edges).filter("reason = 'written'")
    image = F.struct("url", "n_used_by", "width", "height", "mime", "license").alias("image")
    return rows.join(s.images, "url").select("mention", image, "answer", "text_candidates", "visual_candidates")


def cascade(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
