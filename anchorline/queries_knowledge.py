"""Queries of collection, whole assembly, prompts, and of small functions on the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.functions import strings as S
from anchorline.operators import closure
from anchorline.operators.arrays import lookup_list, ordered_union
from anchorline.plans import assemble, evaluate, knowledge, split, stats
from anchorline.queries_split import _EDGES, _IMAGE_OK, _MEMBERS, _SCAN, _TREE, RULES, _edges, _kb_tables, _members, _tree
from anchorline.queries_split import _KB_TABLES as _KB
from anchorline.registry import image_name_sql, query
from anchorline.session import read_table

_CRAWL = f"""with recursive {_TREE}, np as (select count(*) n from part),
members as (select parent, child, 14 ns from tree union all select 'C' || (1 + doc_id % (select n from np)), title, case when doc_id % 5 = 0 then 6 else 0 end from documents),
down as (select 'C1' node union select child from members join down on parent = node where ns = 14)
"""


@query(_CRAWL + r"""select child title, string_agg(distinct parent, ' ' order by parent) categories from members where ns = 0 and child is not null and not regexp_full_match(child, '\d+') and parent in (select node from down) group by child""")
def page_categories(spark: SparkSession, d: str) -> DataFrame:
    """Each article under the crawl with its categories; other kinds of members are left out."""
    n = read_table(spark, d, "part").count()
    tree = _tree(spark, d).select("parent", "child", F.lit(knowledge.SUBCATEGORY).alias("ns"))
    docs = read_table(spark, d, "documents")
    pages = docs.select(F.concat(F.lit("C"), (1 + F.col("doc_id") % n).cast("string")).alias("parent"), F.col("title").alias("child"), F.when(F.col("doc_id") % 5 == 0, 6).otherwise(knowledge.ARTICLE).alias("ns"))
    out = knowledge.page_categories(tree.unionByName(pages), "C1")
    return out.select("title", F.array_join("categories", " ").alias("categories"))


@query("""select qid, (arg_max(title, doc_id) filter (where title is not null)) as name, (arg_min(lang, doc_id) filter (where lang <> '')) as "desc", (arg_min(source, doc_id) filter (where source <> '')) url_wikipedia
from documents where qid is not null group by qid""")
def folded_entities(spark: SparkSession, d: str) -> DataFrame:
    """The rows of an entity as one: last name, first description, first address."""
    rows = read_table(spark, d, "documents").select(F.col("doc_id").alias("ord"), "qid", F.col("title").alias("name"), F.col("lang").alias("desc"), F.col("source").alias("url_wikipedia"))
    return knowledge.folded_entities(rows)


_NAMES = "names as (select name title, min(qid) qid from entity_kb where name is not null group by 1)"


def _names(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "entity_kb").filter("name is not null").groupBy(F.col("name").alias("title")).agg(F.min("qid").alias("qid"))


@query(f"with {_NAMES}, t as (select distinct title from documents where title is not null) select t.title, qid, not coalesce(t.title < 'M' and t.title in (select title from names), false) asked from t left join names using (title)")
def title_known_first(spark: SparkSession, d: str) -> DataFrame:
    """Entities of titles; only titles that aren't known already are looked up, and those without an answer are kept as asked."""
    names = _names(spark, d)
    resolved, asked = knowledge.known_first(read_table(spark, d, "documents").select("title"), names.filter("title < 'M'"), names)
    return resolved.join(asked.select("title", F.lit(True).alias("asked")), "title", "left").select("title", "qid", F.coalesce("asked", F.lit(False)).alias("asked"))


@query("select distinct qid from image_usage where qid is not null and qid not in (select qid from entity_kb where qid is not null)")
def second_pass_entities(spark: SparkSession, d: str) -> DataFrame:
    return knowledge.second_pass(read_table(spark, d, "entity_kb").select("qid").distinct(), read_table(spark, d, "image_usage"))


_WHOLE = f"""{_KB}, i as (select qid, min(intro) intro, min(infobox_img) infobox_img from entity_kb where qid is not null group by qid),
img as (select url as u, min(width) width from image_data where url <> '' group by url),
f as (select qid, 'p' l, list_transform(arg_min(page_imglist, coalesce(intro, '')), lambda x: x.url) files from entity_kb where qid is not null and page_imglist is not null group by qid
  union all select qid, 'c', list_transform(arg_min(commons_imglist, coalesce(intro, '')), lambda x: x.url) from entity_kb where qid is not null and commons_imglist is not null group by qid),
r as (select qid, l, unnest(files) fn, generate_subscripts(files, 1) pos from f),
x as (select r.qid qid, l, string_agg(fn, ' ' order by pos) urls, cast(count_if(case when infobox_img <> '' then {image_name_sql("fn")} = {image_name_sql("infobox_img")} else false end) as bigint) n_portraits from r join img on fn = u left join i on i.qid = r.qid group by all)
select data.qid qid, coalesce(nullif(name, ''), data.qid) as name, coalesce(nullif(type, ''), 'OTHER') as type, coalesce(intro, '') intro, coalesce(p.urls, '') page_urls, coalesce(c.urls, '') commons_urls, coalesce(p.n_portraits, 0) + coalesce(c.n_portraits, 0) n_portraits
from data left join types using (qid) left join i using (qid) left join (select * from x where l = 'p') p on p.qid = data.qid left join (select * from x where l = 'c') c on c.qid = data.qid"""


@query(_WHOLE)
def assemble_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities from all their tables with both image lists nested."""
    types, data = _kb_tables(spark, d)
    kb = read_table(spark, d, "entity_kb").filter("qid is not null")
    faces = kb.groupBy("qid").agg(F.min("infobox_img").alias("infobox_img"))
    base = assemble.knowledge_base(data, types, kb.groupBy("qid").agg(F.min("intro").alias("intro")), faces)
    none = F.array().cast("array<string>")
    images = read_table(spark, d, "image_data").filter("url <> ''").groupBy("url").agg(F.min(F.coalesce("used_by", none)).alias("used_by"), F.min("width").alias("width"), F.min("height").alias("height"), F.min("mime").alias("mime"), F.min("license").alias("license")).withColumn("filename", F.col("url"))

    def listed(c: str) -> DataFrame:
        rows = kb.filter(F.col(c).isNotNull()).groupBy("qid").agg(F.min_by(F.transform(c, lambda x: x["url"]), F.coalesce("intro", F.lit(""))).alias("files"))
        return assemble.image_lists(rows, images, faces)

    whole = assemble.nested_entities(base, listed("page_imglist"), listed("commons_imglist"))
    urls = lambda c: F.array_join(F.transform(c, lambda x: x["url"]), " ")
    faces_in = lambda c: F.size(F.filter(c, lambda x: x["is_infobox"])).cast("long")
    return whole.select("qid", "name", "type", "intro", urls("page_imglist").alias("page_urls"), urls("commons_imglist").alias("commons_urls"), (faces_in("page_imglist") + faces_in("commons_imglist")).alias("n_portraits"))


_EXCLUDED = f"""{_SCAN.replace("with recursive ", f"with recursive {_TREE}, {_MEMBERS}, under as (select 'C2' cls union select child from tree join under on parent = cls), gone as (select distinct qid from members where cls in (select cls from under)), ", 1)},
kept as (select * from pool where qid not in (select qid from gone)), pool2 as (select * from kept where entry_id in (select entry_id from kept group by 1 having count(*) >= 2)),
uses2 as (select * from uses where qid not in (select qid from gone)),
kb2 as (select distinct on (qid) qid, infobox_img from kept order by qid, entry_id, entity_idx), portrait2 as (select {image_name_sql("infobox_img")} portrait from kb2 where infobox_img <> ''),
meta2 as (select distinct on (url) url, n_used_by, width, height, mime, license from uses2 order by url, entry_id, entity_idx, image_idx),
quality2 as (select * from meta2 where {_IMAGE_OK} and {image_name_sql("url")} not in (select portrait from portrait2)),
vis2 as (select url, list_sort(list(distinct qid)) v from uses2 group by url), txt2 as (select entry_id, list_sort(list(distinct qid)) t from pool2 group by entry_id),
pairs2 as (select distinct on (url, mention) url, mention, entry_id from uses2 join keepm using (entry_id) join (select entry_id, entity_idx from pool2) using (entry_id, entity_idx) where url in (select url from quality2) order by url, mention, entry_id, entity_idx, image_idx),
judged2 as (select *, list_intersect(t, v) c from pairs2 join vis2 using (url) join txt2 using (entry_id))
"""


@query(_EXCLUDED + "select mention, url, c[1] answer, array_to_string(t, ' ') text_candidates, array_to_string(v, ' ') visual_candidates from judged2 where len(v) >= 2 and len(c) = 1")
def grounding_without_class(spark: SparkSession, d: str) -> DataFrame:
    """The instance rule after the entities of a class and its subclasses have gone everywhere, pools being checked again."""
    gone = closure.instances_of(_members(spark, d), _tree(spark, d), ["C2"])
    out = split.instances(split.scan(read_table(spark, d, "mention_entries"), RULES, gone), RULES)
    return out.select("mention", F.col("image.url").alias("url"), "answer", F.array_join("text_candidates", " ").alias("text_candidates"), F.array_join("visual_candidates", " ").alias("visual_candidates"))


_LINKED = _SCAN + f""", {_EDGES}, linked as (select distinct a.entry_id from pool a join edges on src = a.qid join pool b on b.entry_id = a.entry_id and b.qid = dst and a.qid <> b.qid),
pairs as (select distinct on (url, mention) url, mention, entry_id from uses join keepm using (entry_id) where url in (select url from quality) and entry_id not in (select entry_id from linked) order by url, mention, entry_id, entity_idx, image_idx),
judged as (select *, list_intersect(t, v) c from pairs join vis using (url) join txt using (entry_id))
"""


@query(_LINKED + "select case when len(v) < 2 then 'visual_pool' when len(c) <> 1 then 'intersection' else 'written' end reason, count(*) n from judged group by 1")
def forbidden_cascade_counts(spark: SparkSession, d: str) -> DataFrame:
    """The cascade where entries with linked candidates are left out."""
    rules = split.SplitRules(forbidden=("P361",))
    return split.cascade(split.judged_pairs(split.scan(read_table(spark, d, "mention_entries"), rules), rules, _edges(spark, d)))


@query(f"select distinct instance_id, array_to_string(list_transform(list_filter(list_transform(list_concat(coalesce(text_candidates, []), coalesce(visual_candidates, [])), lambda x, i: {{'x': x, 'i': i}}), lambda s: list_position(list_concat(coalesce(text_candidates, []), coalesce(visual_candidates, [])), s.x) = s.i and s.x is not null), lambda s: s.x), ' ') alternatives from instances")
def alternatives(spark: SparkSession, d: str) -> DataFrame:
    """All candidates of an instance in order, each once."""
    rows = read_table(spark, d, "instances").select("instance_id", "text_candidates", "visual_candidates")
    both = ordered_union(F.col("text_candidates"), F.col("visual_candidates"))
    return rows.select("instance_id", F.array_join(F.filter(both, lambda x: x.isNotNull()), " ").alias("alternatives")).distinct()


@query("""with kb as (select qid, min(name) as name from entity_kb where qid is not null and name is not null group by 1),
r as (select instance_id, unnest(list_concat(coalesce(text_candidates, []), coalesce(visual_candidates, []))) q, generate_subscripts(list_concat(coalesce(text_candidates, []), coalesce(visual_candidates, [])), 1) pos from (select distinct instance_id, text_candidates, visual_candidates from instances)),
f as (select instance_id, name, min(pos) pos from r join kb on q = qid group by all) select instance_id, string_agg(name, '|' order by pos) names from f group by 1""")
def distinct_names(spark: SparkSession, d: str) -> DataFrame:
    """The names of all candidates, each at its first place."""
    kb = read_table(spark, d, "entity_kb").filter("qid is not null and name is not null").groupBy("qid").agg(F.min("name").alias("name"))
    none = F.array().cast("array<string>")
    rows = read_table(spark, d, "instances").select("instance_id", F.concat(F.coalesce("text_candidates", none), F.coalesce("visual_candidates", none)).alias("c")).distinct()
    return lookup_list(rows, ["instance_id"], "c", kb, "qid", "name", distinct=True).select("instance_id", F.array_join("c", "|").alias("names"))


_LINES = """with kb as (select qid, min(name) as name, min("desc") as "desc", min(intro) intro from entity_kb where qid is not null group by 1), i as (select distinct instance_id, mention, answer, text_candidates from instances),
r as (select instance_id, mention, answer, unnest(text_candidates) q, generate_subscripts(text_candidates, 1) - 1 pos from i),
l as (select *, coalesce(name, '') || case when coalesce(length(coalesce(nullif(trim(split_part(coalesce(intro, ''), '. ', 1)), ''), "desc")), 0) > 0
  then ' - ' || coalesce(nullif(trim(split_part(coalesce(intro, ''), '. ', 1)), ''), "desc") else '' end line from r join kb on q = qid),
n as (select *, row_number() over (partition by instance_id order by {order}, pos, q) no from l),
p as (select instance_id, coalesce(any_value(mention), '') mention, string_agg(no || '. ' || {line}, chr(10) order by no) lines, count(*) n, cast(coalesce(min(case when q = answer then no end), -1) as int) as label from n group by instance_id)
"""


def _prompt_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    kb = read_table(spark, d, "entity_kb").filter("qid is not null").groupBy("qid").agg(F.min("name").alias("name"), F.min("desc").alias("desc"), F.min("intro").alias("intro"))
    return read_table(spark, d, "instances").select("instance_id", "mention", "answer", "text_candidates").distinct(), kb


@query(_LINES.format(order="coalesce((q <> answer)::int, 1)", line="line") + """select instance_id, label, 'Which entity does the picture show under the name ' || mention || '?' || chr(10) || 'Each candidate is given by its name, a description and a picture.' || chr(10)
|| lines || chr(10) || 'Answer with one number from 1 to ' || n || '.' || chr(10) || 'Answer -1 if no candidate fits.' prompt from p""")
def whole_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Header, fields, candidates, footer and hint."""
    return evaluate.prompts(*_prompt_parts(spark, d), image=True, allow_none=True).select("instance_id", "label", "prompt")


@query(_LINES.format(order="md5(instance_id || ':' || q || ':7')", line="coalesce(name, '')") + """select instance_id, label, 'Rank the candidates for ' || mention || '.' || chr(10) || 'Each candidate is given by its name.' || chr(10) || lines || chr(10) || 'List all ' || n || ' numbers.' prompt from p""")
def shuffled_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Ranking prompts of names only, with candidates shuffled by a seed."""
    template = evaluate.Template(header="Rank the candidates for {mention}.", footer="List all {n} numbers.", ranking=True)
    return evaluate.prompts(*_prompt_parts(spark, d), template, description=False, shuffle_seed=7).select("instance_id", "label", "prompt")


@query("select distinct instance_id, case when coalesce(length(image.url), 0) = 0 then 'no image' end error from instances")
def skipped_without_image(spark: SparkSession, d: str) -> DataFrame:
    """Instances to be asked about, and those that are skipped as they have no image."""
    kept, skipped = evaluate.answerable(read_table(spark, d, "instances"), F.col("image.url"))
    return kept.select("instance_id", F.lit(None).cast("string").alias("error")).unionByName(skipped.select("instance_id", "error")).distinct()


@query("select word, count(*) n from (select unnest(regexp_extract_all(lower(mention), '[\\p{L}\\p{Nl}\\p{No}]+')) word from (select distinct mention from instances)) where length(word) >= 2 and word not in ('the', 'of', 'and') group by 1")
def word_frequency_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Words of the distinct mentions."""
    return stats.word_frequency(read_table(spark, d, "instances"), "mention", ("the", "of", "and"), distinct=True)


@query("select distinct filename, 'http://commons.files.example/wiki/Special:FilePath/' || replace(url_encode(filename), '%2F', '/') url from image_data where filename is not null")
def file_path_urls(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "image_data").filter("filename is not null").select("filename", S.file_path_url(F.col("filename")).alias("url")).distinct()


@query("select distinct filename, coalesce(nullif(license, ''), nullif(mime, ''), '') license from image_data")
def license_pick(spark: SparkSession, d: str) -> DataFrame:
    """The first filled one of two texts, here the license and the media type."""
    return read_table(spark, d, "image_data").select("filename", S.license_of(F.col("license"), F.col("mime")).alias("license")).distinct()


@query("""select c_custkey, case when b >= 1000000 then regexp_replace((b + 50000) // 1000000 || '.' || ((b + 50000) // 100000) % 10, '\\.0$', '') || 'M'
when b >= 1000 then regexp_replace((b + 50) // 1000 || '.' || ((b + 50) // 100) % 10, '\\.0$', '') || 'k' else cast(b as varchar) end short from (select c_custkey, (c_custkey * c_custkey * 7) % 3000017 b from customer)""")
def short_counts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_custkey") * F.col("c_custkey") * 7 % 3000017
    return read_table(spark, d, "customer").select("c_custkey", S.short_count(n).alias("short"))


@query("select distinct qid, case n when 0 then 'PERS' when 1 then 'ORG' when 2 then 'LOC' end as type from (select qid, cast(substr(qid, 2) as bigint) % 4 n from entity_kb where regexp_full_match(qid, 'Q[0-9]+'))")
def root_types(spark: SparkSession, d: str) -> DataFrame:
    """Coarse types of root classes, each entity falling under one of the roots or none."""
    n = F.substring("qid", 2, 30).cast("long") % 4
    rows = read_table(spark, d, "entity_kb").filter(F.col("qid").rlike("^Q[0-9]+$"))
    root = F.element_at(F.array(*[F.lit(q) for q in [*S.ROOT_TYPES, "Q1"]]), (n + 1).cast("int"))
    return rows.select("qid", S.root_type(root).alias("type")).distinct()


@query("select distinct instance_id, mention from instances where contains(lower(mention), 'an') or contains(lower(answer), 'an')")
def mention_search(spark: SparkSession, d: str) -> DataFrame:
    """Rows that a search text is found in."""
    return read_table(spark, d, "instances").filter(S.found_in("AN", F.col("mention"), F.col("answer"))).select("instance_id", "mention").distinct()


@query("""select distinct instance_id, q qid, case when q = answer then 'answer' when coalesce(list_contains(text_candidates, q), false) and coalesce(list_contains(visual_candidates, q), false) then 'both'
when coalesce(list_contains(text_candidates, q), false) then 'text' when coalesce(list_contains(visual_candidates, q), false) then 'visual' else 'none' end as role
from (select *, unnest(list_concat(coalesce(text_candidates, []), coalesce(visual_candidates, []))) q from instances) where q is not null""")
def candidate_roles(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "instances").select("instance_id", "answer", "text_candidates", "visual_candidates")
    each = rows.withColumn("qid", F.explode(ordered_union(F.col("text_candidates"), F.col("visual_candidates")))).filter("qid is not null")
    return each.select("instance_id", "qid", S.candidate_role(F.col("qid"), F.col("answer"), F.col("text_candidates"), F.col("visual_candidates")).alias("role")).distinct()


@query("""select distinct url, case when contains(url, '/wikipedia/commons/') and not contains(url, '/wikipedia/commons/thumb/') then replace(url, '/wikipedia/commons/', '/wikipedia/commons/thumb/') || '/320px-' || regexp_extract(url, '[^/]*$') else url end thumb from image_data""")
def thumb_urls(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "image_data").select("url", S.thumb_url(F.col("url")).alias("thumb")).distinct()


@query("""select event_id, try_cast(json_extract_string(props, '$.k') as int) k, '{"k":' || json_extract_string(props, '$.k') || ',"type":"' || event_type || '"}' written from events""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """A JSON text read and written again with another field."""
    k = F.from_json("props", "k int")["k"]
    return read_table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("written"))


@query("select instance_id, mention, answer from (select distinct instance_id, mention, answer from instances) order by md5(instance_id || ':42'), instance_id limit 1000")
def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    """1,000 instances, the same on every run."""
    return evaluate.seeded_sample(read_table(spark, d, "instances").select("instance_id", "mention", "answer").distinct(), "instance_id", 1000)
