"""What is collected before anything is assembled: pages under a category crawl, rows of a knowledge graph, titles and their entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorline.functions import strings as S
from anchorline.operators.closure import reachable
from anchorline.operators.skew import safe_join

#: Kinds of category members, fixed: articles and subcategories.
ARTICLE, SUBCATEGORY = 0, 14


def page_categories(members: DataFrame, root: str) -> DataFrame:
    """(title, categories): the articles in any category under the root, each with all of these categories that hold it directly, sorted.

    members: (parent, child, ns). Cycles of categories are fine; titles that are numbers, other kinds of members and nulls are left out.
    """
    seeds = members.sparkSession.createDataFrame([(root,)], "seed string")
    tree = members.filter(F.col("ns") == SUBCATEGORY).select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    visited = reachable(seeds, tree).select(F.col("node").alias("parent")).distinct()
    pages = members.filter((F.col("ns") == ARTICLE) & F.col("child").isNotNull() & ~S.is_number_title(F.col("child"))).select("parent", "child").distinct()
    held = safe_join(pages, visited, "parent")
    return held.groupBy(F.col("child").alias("title")).agg(F.array_sort(F.collect_set("parent")).alias("categories"))


def folded_entities(rows: DataFrame) -> DataFrame:
    """(qid, name, desc, url_wikipedia): several rows of one entity as one, in the order of ord.

    rows: (ord, qid, name, desc, url_wikipedia). The last name that is no null counts, the first description and the first address that aren't empty; a
    null qid is left out. Rows with the same ord and entity should be equal.
    """
    name = F.max_by("name", F.when(F.col("name").isNotNull(), F.col("ord")))
    first = lambda c: F.min_by(c, F.when(S.filled(F.col(c)), F.col("ord")))
    return rows.filter(F.col("qid").isNotNull()).groupBy("qid").agg(name.alias("name"), first("desc").alias("desc"), first("url_wikipedia").alias("url_wikipedia"))


def known_first(titles: DataFrame, known: DataFrame, lookup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, asked): entities of titles, those of known winning; asked holds what lookup was needed for, with null where it had no answer.

    titles: (title); known and lookup: unique (title, qid). A null title is left out. asked is what to keep, so that titles without an answer aren't asked for again.
    """
    wanted = titles.filter(F.col("title").isNotNull()).select("title").distinct()
    asked = wanted.join(known.select("title"), "title", "left_anti").join(lookup.select("title", "qid"), "title", "left")
    resolved = wanted.join(known.select("title", F.col("qid").alias("k")), "title", "left").join(asked.select("title", F.col("qid").alias("a")), "title", "left")
    return resolved.select("title", F.coalesce("k", "a").alias("qid")), asked


def second_pass(seen: DataFrame, found: DataFrame) -> DataFrame:
    """(qid) that only the images brought up and the first pass hasn't seen: the input of the second pass over entity data, texts and image lists."""
    return found.filter(F.col("qid").isNotNull()).select("qid").distinct().join(seen.select("qid"), "qid", "left_anti")
