"""Queries of the split: pools, filters, the instance rule, closure and assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.functions import strings as S
from anchorline.operators import closure, incremental
from anchorline.operators.arrays import lookup_list
from anchorline.plans import assemble, split
from anchorline.registry import image_name_sql, query
from anchorline.session import read_table

RULES = split.SplitRules()
STRICT = split.SplitRules(unique_portraits=True, share_type=True)

_MENTION_OK = r"length(mention) >= 3 and regexp_matches(mention, '\p{L}') and not regexp_matches(mention, '(?i)\band\b') and not regexp_matches(mention, '^\s*\d')"
_ENTITY_OK = r"""not coalesce(regexp_full_match(e.name, 'Q\d+'), false) and coalesce(length(e.intro), 0) > 0 and coalesce(length(e.infobox_img), 0) > 0
 and coalesce(nullif(e.type, ''), 'OTHER') in ('PERS', 'ORG', 'LOC')"""
_IMAGE_OK = "mime = 'image/jpeg' and least(coalesce(width, 0), coalesce(height, 0)) >= 250 and coalesce(n_used_by, 0) between 2 and 10"
_SCAN = f"""
with recursive keepm as (select distinct entry_id, mention from mention_entries where {_MENTION_OK}),
raw_e as (select entry_id, unnest(ambiguities) e, generate_subscripts(ambiguities, 1) - 1 entity_idx from mention_entries where entry_id in (select entry_id from keepm)),
cand as (select distinct entry_id, entity_idx, e.qid qid, e.name as name, e.type as type, e.infobox_img infobox_img from raw_e where e.qid is not null and {_ENTITY_OK}),
pool as (select * from cand where entry_id in (select entry_id from cand group by 1 having count(*) >= 2)),
im as (select distinct entry_id, entity_idx, image_idx, qid, im.url url, im.is_infobox is_infobox, im.n_used_by n_used_by, im.width width, im.height height, im.mime mime, im.license license from
  (select entry_id, entity_idx, e.qid qid, unnest(e.page_imglist) im, generate_subscripts(e.page_imglist, 1) - 1 image_idx from raw_e)),
uses as (select im.* from im join (select distinct entry_id, entity_idx from pool) using (entry_id, entity_idx) where url <> '' and not coalesce(is_infobox, false)),
kb as (select distinct on (qid) qid, name, type, infobox_img from pool order by qid, entry_id, entity_idx),
portrait as (select qid, {image_name_sql("infobox_img")} portrait from kb where infobox_img <> ''),
meta as (select distinct on (url) url, n_used_by, width, height, mime, license from uses order by url, entry_id, entity_idx, image_idx),
quality as (select * from meta where {_IMAGE_OK} and {image_name_sql("url")} not in (select portrait from portrait)),
vis as (select url, list_sort(list(distinct qid)) v from uses group by url),
txt as (select entry_id, list_sort(list(distinct qid)) t from pool group by entry_id)
"""
_PAIRS = _SCAN + """
, pairs as (select distinct on (url, mention) url, mention, entry_id from uses join keepm using (entry_id) where url in (select url from quality) order by url, mention, entry_id, entity_idx, image_idx),
judged as (select *, list_intersect(t, v) c from pairs join vis using (url) join txt using (entry_id))
"""
_STRICT = _SCAN + """
, bad as (select entry_id from (select distinct entry_id, qid from pool) join portrait using (qid) group by 1 having count(*) <> count(distinct portrait)),
alike as (select url from (select distinct url, qid from uses) join portrait using (qid) group by 1 having count(*) <> count(distinct portrait)),
pairs as (select distinct on (url, mention) url, mention, entry_id from uses join keepm using (entry_id)
  where url in (select url from quality) and entry_id not in (select entry_id from bad) order by url, mention, entry_id, entity_idx, image_idx),
judged as (select *, list_intersect(t, v) c from pairs join vis using (url) join txt using (entry_id)),
types as (select entry_id, qid, coalesce(nullif(kb.type, ''), 'OTHER') as type from (select distinct entry_id, qid from pool) join kb using (qid)),
reasons as (select case when len(v) < 2 then 'visual_pool' when url in (select url from alike) then 'visual_portrait' when len(c) <> 1 then 'intersection'
  when (select count(*) from types a join types b on a.entry_id = b.entry_id and a.type = b.type where a.entry_id = judged.entry_id and a.qid = c[1]) < 2 then 'type_not_shared' else 'written' end reason from judged)
"""


def _scan(spark: SparkSession, d: str, rules: split.SplitRules = RULES) -> split.Scan:
    return split.scan(read_table(spark, d, "mention_entries"), rules)


@query(_PAIRS + """select mention, url, c[1] answer, array_to_string(t, ' ') text_candidates, array_to_string(v, ' ') visual_candidates, q.width width, q.license license
from judged join quality q using (url) where len(v) >= 2 and len(c) = 1""")
def bipartite_grounding(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: every image and mention whose candidate sets share exactly one entity."""
    out = split.instances(_scan(spark, d), RULES)
    return out.select("mention", F.col("image.url").alias("url"), "answer", F.array_join("text_candidates", " ").alias("text_candidates"), F.array_join("visual_candidates", " ").alias("visual_candidates"), F.col("image.width").alias("width"), F.col("image.license").alias("license"))


@query(_PAIRS + "select case when len(v) < 2 then 'visual_pool' when len(c) <> 1 then 'intersection' else 'written' end reason, count(*) n from judged group by 1")
def split_cascade_counts(spark: SparkSession, d: str) -> DataFrame:
    return split.cascade(split.judged_pairs(_scan(spark, d), RULES))


@query(_STRICT + "select reason, count(*) n from reasons group by 1")
def strict_cascade_counts(spark: SparkSession, d: str) -> DataFrame:
    """With distinct portraits and a shared answer type required."""
    return split.cascade(split.judged_pairs(_scan(spark, d, STRICT), STRICT))


@query(_PAIRS + "select case when len(v) < 2 or len(v) > 3 then 'visual_pool' when len(c) <> 1 then 'intersection' else 'written' end reason, count(*) n from judged group by 1")
def bounded_cascade_counts(spark: SparkSession, d: str) -> DataFrame:
    """With pools of at most three entities; larger ones are counted but never put together."""
    rules = split.SplitRules(max_visual=3)
    return split.cascade(split.judged_pairs(_scan(spark, d, rules), rules))


@query(_SCAN.replace("e.infobox_img infobox_img from raw_e", 'e.infobox_img infobox_img, e."desc" as "desc", e.intro intro, e.url_wikipedia url_wikipedia from raw_e') + """
select distinct on (qid) qid, name, type, "desc", intro, infobox_img, url_wikipedia from pool order by qid, entry_id, entity_idx""")
def split_kb(spark: SparkSession, d: str) -> DataFrame:
    """The knowledge base that a split comes with."""
    mentions = read_table(spark, d, "mention_entries")
    return split.kb_rows(mentions, split.scan(mentions, RULES))


@query(_SCAN + "select url, array_to_string(v, ' ') visual_candidates, len(v) n from vis")
def visual_pool(spark: SparkSession, d: str) -> DataFrame:
    return split.visual_pools(_scan(spark, d)).select("url", F.array_join("visual_candidates", " ").alias("visual_candidates"), F.size("visual_candidates").cast("long").alias("n"))


@query(_SCAN + "select entry_id, array_to_string(t, ' ') text_candidates from txt")
def text_pool(spark: SparkSession, d: str) -> DataFrame:
    return split.text_pools(_scan(spark, d)).select("entry_id", F.array_join("text_candidates", " ").alias("text_candidates"))


@query(_SCAN + "select entry_id from (select distinct entry_id, qid from pool) join portrait using (qid) group by 1 having count(*) <> count(distinct portrait)")
def shared_portrait_reject(spark: SparkSession, d: str) -> DataFrame:
    return split.shared_portrait_entries(_scan(spark, d))


@query(_SCAN + "select url from quality")
def portrait_image_exclude(spark: SparkSession, d: str) -> DataFrame:
    return split.qualifying_images(_scan(spark, d), RULES).select("url")


@query(f"select entry_id, mention from mention_entries where {_MENTION_OK} group by all")
def keep_mention_filter(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "mention_entries").select("entry_id", "mention").distinct().filter(split.mention_ok(F.col("mention"), RULES))


@query("""select distinct entry_id from mention_entries where list_has_any(coalesce(categories, []), (select list(c) from (select c from (select unnest(categories) c from mention_entries) where c < 'M' group by c)))
and not list_has_any(coalesce(categories, []), (select list(c) from (select c from (select unnest(categories) c from mention_entries) where c < 'C' group by c)))""")
def category_include_exclude(spark: SparkSession, d: str) -> DataFrame:
    """Entries in a category before M and in none before C."""
    m = read_table(spark, d, "mention_entries")
    names = m.select(F.explode("categories").alias("category")).distinct()
    return split.in_categories(m, names.filter("category < 'M'"), names.filter("category < 'C'")).select("entry_id").distinct()


@query(f"select qid from (select unnest([e]) e, qid from (select e, e.qid qid from (select entity_kb e from entity_kb))) where qid is not null and {_ENTITY_OK} group by qid")
def keep_entity_filter(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "entity_kb").filter(split.entity_ok(RULES) & F.col("qid").isNotNull()).select("qid").distinct()


@query(f"select distinct filename from (select *, len(used_by) n_used_by from image_data) where {_IMAGE_OK}")
def keep_image_filter(spark: SparkSession, d: str) -> DataFrame:
    images = read_table(spark, d, "image_data").withColumn("n_used_by", F.size("used_by"))
    return images.filter(split.image_ok(RULES)).select("filename").distinct()


#: Edges of the data: an entity to the one whose number is greater by three.
_EDGES = """edges as (select distinct qid src, 'P361' prop, 'Q' || (cast(substr(qid, 2) as bigint) + 3) dst from entity_kb where regexp_full_match(qid, 'Q[0-9]+'))"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    kb = read_table(spark, d, "entity_kb").filter(F.col("qid").rlike("^Q[0-9]+$"))
    return kb.select(F.col("qid").alias("src"), F.lit("P361").alias("prop"), F.concat(F.lit("Q"), (F.substring("qid", 2, 30).cast("long") + 3).cast("string")).alias("dst")).distinct()


@query(_SCAN + f", {_EDGES} select distinct a.entry_id from pool a join edges on src = a.qid join pool b on b.entry_id = a.entry_id and b.qid = dst and a.qid <> b.qid")
def forbidden_pair_filter(spark: SparkSession, d: str) -> DataFrame:
    """Entries with two candidates that an edge links."""
    return split.forbidden_entries(_scan(spark, d).pool, _edges(spark, d), ("P361",))


#: A class tree of the data: part k falls under part k div 4; each part also belongs to the class of its size.
_TREE = "tree as (select distinct 'C' || p_partkey child, 'C' || (p_partkey // 4) parent from part where p_partkey // 4 > 0)"
_MEMBERS = "members as (select distinct qid, 'C' || (1 + cast(substr(qid, 2) as bigint) % (select count(*) from part)) cls from entity_kb where regexp_full_match(qid, 'Q[0-9]+'))"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    up = F.floor(F.col("p_partkey") / 4)
    c = lambda x: F.concat(F.lit("C"), x.cast("string"))
    return read_table(spark, d, "part").filter(up > 0).select(c(F.col("p_partkey")).alias("child"), c(up).alias("parent")).distinct()


def _members(spark: SparkSession, d: str) -> DataFrame:
    n = read_table(spark, d, "part").count()
    kb = read_table(spark, d, "entity_kb").filter(F.col("qid").rlike("^Q[0-9]+$"))
    return kb.select("qid", F.concat(F.lit("C"), (1 + F.pmod(F.substring("qid", 2, 30).cast("long"), F.lit(n))).cast("string")).alias("cls")).distinct()


@query(f"""with recursive {_TREE}, {_MEMBERS}, under as (select 'C2' cls union select child from tree join under on parent = cls union all select 'C3' where false)
select distinct qid from members where cls in (select cls from under)""".replace(" union all select 'C3' where false", ""))
def exclude_instance_of(spark: SparkSession, d: str) -> DataFrame:
    """Entities of a class or any of its subclasses."""
    return closure.instances_of(_members(spark, d), _tree(spark, d), ["C2"])


@query(f"""with recursive {_TREE}, down as (select 'C1' node, 0 depth union select child, depth + 1 from tree join down on parent = node)
select 'C1' seed, node, cast(min(depth) as int) depth from down group by node""")
def category_bfs(spark: SparkSession, d: str) -> DataFrame:
    """All categories below a root with their depth."""
    seeds = spark.createDataFrame([("C1",)], "seed string")
    return closure.reachable(seeds, _tree(spark, d).select(F.col("parent").alias("src"), F.col("child").alias("dst")))


@query(f"""with recursive {_TREE}, {_MEMBERS}, u as (select r seed, r node from (values ('C1'), ('C2'), ('C3'), ('C5')) t(r) union select seed, child from u join tree on parent = node),
m as (select qid, min(case seed when 'C3' then 0 when 'C2' then 1 when 'C1' then 2 end) k, bool_or(seed = 'C5') barred from members left join u on cls = node group by qid)
select qid, case when not coalesce(barred, false) then case k when 0 then 'PERS' when 1 then 'ORG' when 2 then 'LOC' end end as type from m""")
def type_priority_closure(spark: SparkSession, d: str) -> DataFrame:
    """Coarse types by the roots that classes fall under, one class being barred."""
    return assemble.coarse_types(_members(spark, d), _tree(spark, d), {"C3": "PERS", "C2": "ORG", "C1": "LOC"}, "C5")


_RESOLVE = """with t as (select distinct title from documents where title is not null), norm as (select title src, trim(title) dst from t where title <> trim(title)),
red as (select title src, regexp_replace(title, ' \\([^)]*\\)$', '') dst from t where regexp_matches(title, ' \\([^)]*\\)$')), tgt as (select name title, min(qid) qid from entity_kb where name is not null group by 1)
"""


@query(_RESOLVE + """select t.title, coalesce(red.dst, coalesce(norm.dst, t.title)) resolved, qid from t left join norm on norm.src = t.title
left join red on red.src = coalesce(norm.dst, t.title) left join tgt on tgt.title = coalesce(red.dst, coalesce(norm.dst, t.title))""")
def redirect_chain(spark: SparkSession, d: str) -> DataFrame:
    """Titles through a spelling and a redirect table to entities."""
    t = read_table(spark, d, "documents").select("title").filter("title is not null").distinct()
    normal = t.filter("title <> trim(title)").select(F.col("title").alias("src"), F.trim("title").alias("dst"))
    tail = r" \([^)]*\)$"
    redirects = t.filter(F.col("title").rlike(tail)).select(F.col("title").alias("src"), F.regexp_replace("title", tail, "").alias("dst"))
    target = read_table(spark, d, "entity_kb").filter("name is not null").groupBy(F.col("name").alias("title")).agg(F.min("qid").alias("qid"))
    return incremental.resolve(t, normal, redirects, target)


_KB_TABLES = """with types as (select qid, min(nullif(trim(type), '')) as type from entity_kb where qid is not null group by qid),
data as (select qid, min(name) as name, min("desc") as "desc", min(url_wikipedia) url_wikipedia from entity_kb where qid is not null group by qid),
special as (select qid from types where type is null union select qid from data where regexp_matches(url_wikipedia, '(?i)\\(disambiguation\\)'))
"""


def _kb_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    kb = read_table(spark, d, "entity_kb").filter("qid is not null")
    types = kb.groupBy("qid").agg(F.min(F.nullif(F.trim("type"), F.lit(""))).alias("type"))
    return types, kb.groupBy("qid").agg(F.min("name").alias("name"), F.min("desc").alias("desc"), F.min("url_wikipedia").alias("url_wikipedia"))


@query(_KB_TABLES + """, one as (select url as filename, arg_min(used_by, {'f': coalesce(filename, ''), 'u': coalesce(array_to_string(used_by, ' '), '')}) used_by from image_data where url <> '' group by url),
u as (select filename, unnest(used_by) q, generate_subscripts(used_by, 1) pos from one), k as (select * from u where q is not null and q not in (select qid from special))
select one.filename filename, coalesce(string_agg(q, ' ' order by pos), '') used_by from one left join k using (filename) group by 1""")
def special_strip_used_by(spark: SparkSession, d: str) -> DataFrame:
    """Users of each image without pages that are no entities."""
    types, data = _kb_tables(spark, d)
    images = read_table(spark, d, "image_data").filter("url <> ''").groupBy(F.col("url")).agg(F.min_by("used_by", F.struct(F.coalesce("filename", F.lit("")), F.coalesce(F.array_join("used_by", " "), F.lit("")))).alias("used_by")).withColumnRenamed("url", "filename")
    return assemble.stripped_users(images, assemble.special_pages(types, data)).select("filename", F.array_join("used_by", " ").alias("used_by"))


@query(_KB_TABLES + """, i as (select qid, min(intro) intro, min(infobox_img) infobox_img from entity_kb where qid is not null group by qid)
select data.qid qid, coalesce(nullif(name, ''), data.qid) as name, coalesce("desc", '') as "desc", coalesce(intro, '') intro, coalesce(nullif(type, ''), 'OTHER') as type, infobox_img, coalesce(url_wikipedia, '') url_wikipedia
from data left join types using (qid) left join i using (qid)""")
def assemble_kb(spark: SparkSession, d: str) -> DataFrame:
    """The knowledge base joined from its tables."""
    types, data = _kb_tables(spark, d)
    kb = read_table(spark, d, "entity_kb").filter("qid is not null")
    return assemble.knowledge_base(data, types, kb.groupBy("qid").agg(F.min("intro").alias("intro")), kb.groupBy("qid").agg(F.min("infobox_img").alias("infobox_img")))


_IMAGE_LISTS = f"""with f as (select qid, list_transform(arg_min(page_imglist, coalesce(intro, '')), lambda x: x.url) files, min(infobox_img) infobox_img from entity_kb where qid is not null and page_imglist is not null group by qid),
img as (select url as u, arg_min(used_by, coalesce(filename, '')) used_by, min(width) width, min(height) height from image_data where url <> '' and used_by is not null group by url),
r as (select qid, infobox_img, unnest(files) fn, generate_subscripts(files, 1) - 1 pos from f)
select qid, cast(pos as int) pos, fn url, cast(len(used_by) as int) n_used_by, case when infobox_img <> '' then {image_name_sql("fn")} = {image_name_sql("infobox_img")} else false end is_infobox, width, height from r join img on fn = u"""


@query(_IMAGE_LISTS)
def assemble_image_lists(spark: SparkSession, d: str) -> DataFrame:
    """Each entity's files with their image data and whether they are its portrait."""
    kb = read_table(spark, d, "entity_kb").filter("qid is not null and page_imglist is not null")
    files = kb.groupBy("qid").agg(F.min_by(F.transform("page_imglist", lambda x: x["url"]), F.coalesce("intro", F.lit(""))).alias("files"), F.min("infobox_img").alias("infobox_img"))
    rows = read_table(spark, d, "image_data").filter("url <> '' and used_by is not null")
    images = rows.groupBy(F.col("url")).agg(F.min_by("used_by", F.coalesce("filename", F.lit(""))).alias("used_by"), F.min("width").alias("width"), F.min("height").alias("height"), F.min("mime").alias("mime"), F.min("license").alias("license")).withColumn("filename", F.col("url"))
    return assemble.image_lists(files, images, files.select("qid", "infobox_img")).select("qid", "pos", "url", "n_used_by", "is_infobox", "width", "height")


@query("""with l as (select entry_id ord, list_transform(any_value(ambiguities), lambda e: e.qid) qids from mention_entries group by 1),
r as (select ord, unnest(qids) qid, generate_subscripts(qids, 1) - 1 pos from l), f as (select ord, qid, min(pos) pos from r where qid in (select qid from entity_kb) group by all)
select ord, cast(pos as int) pos, qid from f where ord in (select ord from f group by 1 having count(*) >= 2)""")
def ordered_link_join(spark: SparkSession, d: str) -> DataFrame:
    """The known entities of each page in order of first mention."""
    links = read_table(spark, d, "mention_entries").groupBy(F.col("entry_id").alias("ord")).agg(F.first(F.transform("ambiguities", lambda e: e["qid"])).alias("qids"))
    return assemble.candidates(links, read_table(spark, d, "entity_kb").select("qid").distinct())


@query("""with kb as (select qid, min(name) as name from entity_kb where qid is not null and name is not null group by 1),
r as (select instance_id, unnest(text_candidates) q, generate_subscripts(text_candidates, 1) pos from (select distinct instance_id, text_candidates from instances))
select instance_id, string_agg(name, '|' order by pos) names from r join kb on q = qid group by 1""")
def candidate_names(spark: SparkSession, d: str) -> DataFrame:
    """Each instance's candidates by name, in order."""
    kb = read_table(spark, d, "entity_kb").filter("qid is not null and name is not null").groupBy("qid").agg(F.min("name").alias("name"))
    rows = read_table(spark, d, "instances").select("instance_id", "text_candidates").distinct()
    return lookup_list(rows, ["instance_id"], "text_candidates", kb, "qid", "name").select("instance_id", F.array_join("text_candidates", "|").alias("names"))


@query("""with r as (select distinct entry_id, unnest(ambiguities) e, generate_subscripts(ambiguities, 1) pos from mention_entries),
a as (select * from r where e.qid is not null), al as (select entry_id, list_distinct(list(e.qid)) q from a group by 1),
im as (select entry_id, pos, e.qid qid, unnest(e.page_imglist) im from a),
x as (select im.*, q, len(list_intersect(list_filter(coalesce(im.used_by, []), lambda u: u is not null), q)) hits, len(list_intersect(list_filter(coalesce(im.used_by, []), lambda u: u is not null), list_filter(q, lambda z: z <> qid))) others,
  len(list_filter(list_distinct(coalesce(im.used_by, [])), lambda u: u is not null and not list_contains(q, u))) outside from im join al using (entry_id) where im is not null),
v as (select entry_id, count(distinct im.url) n from x where hits >= 2 group by 1),
g as (select entry_id, count(distinct pos) n from x where not coalesce(im.is_infobox, false) and others = 0 and outside > 0 group by 1)
select m.entry_id entry_id, cast(coalesce(len(q), 0) as int) n_entities, cast(coalesce(v.n, 0) as int) n_visual_ambiguities, cast(coalesce(g.n, 0) as int) n_grounded_entities
from (select distinct entry_id from mention_entries) m left join al using (entry_id) left join v on v.entry_id = m.entry_id left join g on g.entry_id = m.entry_id""")
def visual_ambiguity_counts(spark: SparkSession, d: str) -> DataFrame:
    return assemble.visual_counts(read_table(spark, d, "mention_entries"))


@query("select distinct qid from image_usage where qid is not null and qid not in (select answer from instances where answer is not null)")
def pending_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Using entities that are no answer yet."""
    done = read_table(spark, d, "instances").select(F.col("answer").alias("qid"))
    return incremental.pending(read_table(spark, d, "image_usage").select("qid").distinct(), done, "qid")


@query("""with o as (select url, min(width) width from image_data where url is not null group by 1), n as (select image.url url, max(image.width) width from instances where image.url is not null group by 1)
select * from n union all select * from o where url not in (select url from n)""")
def merge_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Image widths, those of the instances winning."""
    old = read_table(spark, d, "image_data").filter("url is not null").groupBy("url").agg(F.min("width").alias("width"))
    new = read_table(spark, d, "instances").filter("image.url is not null").groupBy("image.url").agg(F.max("image.width").alias("width"))
    return incremental.merge_last(old, new, "url")


@query("""select im.url url from (select unnest(page_imglist) im from entity_kb) where im is not null
union select im.url from (select unnest(commons_imglist) im from entity_kb) where im is not null""")
def union_image_sources(spark: SparkSession, d: str) -> DataFrame:
    kb = read_table(spark, d, "entity_kb")
    return incremental.union_distinct([kb.select(F.explode(c).alias("im")).filter("im is not null").select("im.url") for c in ("page_imglist", "commons_imglist")])


@query("""select distinct qid from entity_kb where qid in (select answer from instances union select unnest(text_candidates) from instances union select unnest(visual_candidates) from instances)""")
def referenced_kb_semi_join(spark: SparkSession, d: str) -> DataFrame:
    i = read_table(spark, d, "instances")
    used = i.select(F.explode(F.concat(F.array("answer"), F.coalesce("text_candidates", F.array().cast("array<string>")), F.coalesce("visual_candidates", F.array().cast("array<string>")))).alias("qid")).distinct()
    return read_table(spark, d, "entity_kb").select("qid").distinct().join(used, "qid", "left_semi")


@query("select qid, cast(nullif(trim(type), '') is not null as int) typed from (select distinct qid, type from entity_kb where coalesce(url_wikipedia, '') <> '')")
def entities_with_article(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "entity_kb").filter(S.filled(F.col("url_wikipedia"))).select("qid", "type").distinct()
    return rows.select("qid", F.nullif(F.trim("type"), F.lit("")).isNotNull().cast("int").alias("typed"))
