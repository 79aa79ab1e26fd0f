"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.functions import strings as S
from anchorline.registry import image_name_sql, query
from anchorline.session import read_table

_LINES = r"regexp_split_to_array({}, '\r\n|[\n\x0B\x0C\r\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')"
#: The grammar of strings.ITEM_MARK, ITEM_STYLE and ITEM_LINK, fixed.
_ITEM = r"^([*#]+)\s*[''`_~]*\[\[([^\]|#]+)(?:\|[^\]]+)?\]\](.*)$"


@query(rf"""with l as (select doc_id, unnest({_LINES.format("regexp_replace(text, '(?s)==\\s*[Ss]ee also\\s*==.*', '')")}) x from documents),
p as (select doc_id, regexp_extract(trim(x), '{_ITEM}', ['b', 't', 'r']) m from l where regexp_matches(trim(x), '{_ITEM}'))
select doc_id, count(*) n_links, string_agg(trim(m.t), '|' order by trim(m.t)) targets from p
where not contains(m.t, ':') and (len(m.b) > 1 or (regexp_matches(m.r, '[\p{{L}}\p{{N}}]') and not starts_with(trim(m.r), ':'))) group by doc_id""")
def wikitext_links(spark: SparkSession, d: str) -> DataFrame:
    """Entity links of the pages in wiki markup."""
    rows = read_table(spark, d, "documents").select("doc_id", S.entity_links(F.col("text")).alias("links")).filter(F.size("links") > 0)
    return rows.select("doc_id", F.size("links").cast("long").alias("n_links"), F.array_join(F.array_sort("links"), "|").alias("targets"))


_SPACE = r"[\s\p{Z}\x0B\x{85}\x1C-\x1F]"


@query(rf"""select distinct mention, regexp_replace(regexp_replace(mention, '{_SPACE}*\([^)]*\){_SPACE}*$', ''), '^{_SPACE}+|{_SPACE}+$', '', 'g') cleaned from instances""")
def clean_mention(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "instances").select("mention").distinct().select("mention", S.clean_mention(F.col("mention")).alias("cleaned"))


@query(f"select distinct filename, {image_name_sql('filename')} image_name, {image_name_sql('url')} url_name from image_data")
def normalise_image_name(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "image_data").select("filename", S.image_name(F.col("filename")).alias("image_name"), S.image_name(F.col("url")).alias("url_name")).distinct()


@query("""select distinct qid, coalesce(nullif(trim(split_part(coalesce(intro, ''), '. ', 1)), ''), "desc") sentence, trim(split_part(intro, chr(10) || chr(10), 1)) paragraph from entity_kb""")
def first_sentence_fallback(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "entity_kb").select("qid", S.first_sentence(F.col("intro"), F.col("desc")).alias("sentence"), S.first_paragraph(F.col("intro")).alias("paragraph")).distinct()


@query("""select distinct url_wikipedia, replace(regexp_replace(url_wikipedia, '^.*?/wiki/', ''), '_', ' ') title, regexp_extract(url_wikipedia, '[^/]*$') segment,
'https://en.enc.example/wiki/' || replace(name, ' ', '_') url from entity_kb""")
def title_urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url_wikipedia")
    return read_table(spark, d, "entity_kb").select(u, S.title_from_url(u).alias("title"), S.last_segment(u).alias("segment"), S.title_to_url(F.col("name")).alias("url")).distinct()


@query("select distinct filename from image_data where not regexp_matches(lower(filename), '\\.(svg|gif|ogg|ogv|webm|midi|mp3|wav)$')")
def photo_filter(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "image_data").select("filename").distinct().filter(S.is_photo(F.col("filename")))


@query("select distinct title from documents where not regexp_full_match(title, '\\d+')")
def numeric_title_filter(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("title").distinct().filter(~S.is_number_title(F.col("title")))


@query("select distinct url, sha1(url) key from image_data where url is not null")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "image_data").select("url", F.sha1("url").alias("key")).distinct().filter("url is not null")


@query("select word, count(*) n from (select unnest(regexp_extract_all(lower(mention), '[\\p{L}\\p{Nl}\\p{No}]+')) word from instances) where length(word) >= 2 and word not in ('the', 'of', 'and') group by 1")
def word_frequency(spark: SparkSession, d: str) -> DataFrame:
    from anchorline.plans.stats import word_frequency as frequency

    return frequency(read_table(spark, d, "instances"), "mention", ("the", "of", "and"))


#: Answers made of the data: a JSON number, a bare number, none, or a number out of range.
_RESPONSES = """with base as (select distinct instance_id, answer, text_candidates from instances where text_candidates is not null and answer is not null),
resp as (select *, list_position(text_candidates, answer) place, case instance_id % 4 when 0 then '{"number": ' || (1 + instance_id % 3) || '}' when 1 then 'I say ' || (instance_id % 5) || ' or 2'
  when 2 then 'no idea' else 'maybe -1' end response,
  case instance_id % 4 when 0 then '{"ranking": [2, 1, 3]}' when 1 then 'so [3 1 2 4]' when 2 then '{"ranking": [a]}' else 'nothing' end ranking_response from base),
parsed as (select *, try_cast(coalesce(nullif(regexp_extract(response, '"number"\\s*:\\s*(-?\\d+)', 1), ''), nullif(regexp_extract(response, '-?\\d+'), '')) as int) number,
  case instance_id % 4 when 0 then [2, 1, 3] when 1 then [3, 1, 2, 4] end ranking, coalesce(nullif(place, 0), -1) as label from resp)
"""


def responses(spark: SparkSession, d: str) -> DataFrame:
    """(instance_id, answer, text_candidates, label, number, ranking) read from answers made of the data."""
    i, k = F.col("instance_id"), F.col("instance_id") % 4
    base = read_table(spark, d, "instances").select("instance_id", "answer", "text_candidates").filter("text_candidates is not null and answer is not null").distinct()
    said = F.when(k == 0, F.concat(F.lit('{"number": '), (1 + i % 3).cast("string"), F.lit("}"))).when(k == 1, F.concat(F.lit("I say "), (i % 5).cast("string"), F.lit(" or 2"))).when(k == 2, "no idea").otherwise("maybe -1")
    ranked = F.when(k == 0, '{"ranking": [2, 1, 3]}').when(k == 1, "so [3 1 2 4]").when(k == 2, '{"ranking": [a]}').otherwise("nothing")
    at = F.array_position("text_candidates", F.col("answer"))
    return base.withColumn("number", S.parse_number(said)).withColumn("ranking", S.parse_ranking(ranked)).withColumn("label", F.when(at > 0, at).otherwise(-1).cast("int"))


@query(_RESPONSES + "select instance_id, number, case when number between 1 and len(text_candidates) then text_candidates[number] end pred_qid from parsed")
def parse_number(spark: SparkSession, d: str) -> DataFrame:
    from anchorline.plans.evaluate import predicted_qid

    return responses(spark, d).select("instance_id", "number", predicted_qid(F.col("text_candidates"), F.col("number")).alias("pred_qid"))


@query(_RESPONSES + "select instance_id, array_to_string(ranking, ' ') ranking, cast(nullif(list_position(ranking, label), 0) as bigint) rank from parsed")
def parse_ranking(spark: SparkSession, d: str) -> DataFrame:
    from anchorline.plans.evaluate import gold_rank

    return responses(spark, d).select("instance_id", F.array_join(F.transform("ranking", lambda x: x.cast("string")), " ").alias("ranking"), gold_rank(F.col("ranking"), F.col("label")).alias("rank"))


@query(_RESPONSES + """select count(*) n, count_if(coalesce(number = label, false)) n_correct, count_if(number is null) n_unparsed, count_if(coalesce(number = -1, false)) n_none,
count_if(coalesce(number = label, false)) / count(*) accuracy, avg(1.0 / nullif(len(text_candidates), 0)) random_baseline from parsed""".replace("count_if(coalesce(number = label, false)) n_correct", "cast(count_if(coalesce(number = label, false)) as bigint) n_correct").replace("count_if(number is null)", "cast(count_if(number is null) as bigint)").replace("count_if(coalesce(number = -1, false))", "cast(count_if(coalesce(number = -1, false)) as bigint)"))
def accuracy_metrics(spark: SparkSession, d: str) -> DataFrame:
    from anchorline.plans.evaluate import accuracy

    return accuracy(responses(spark, d).withColumn("pool_size", F.size("text_candidates")))


_K = ", ".join(f"avg(case when rank <= {k} then 1.0 else 0.0 end) hit_{k}, avg(case when rank <= {k} then 1.0 else 0.0 end) / {k} precision_{k}, avg(case when rank <= {k} then 1.0 else 0.0 end) recall_{k}, avg(case when rank <= {k} then 1 / log2(rank + 1) else 0.0 end) ndcg_{k}" for k in (1, 3, 5, 10))


@query(_RESPONSES + f", r as (select nullif(list_position(ranking, label), 0) as rank from parsed) select count(*) n, cast(count_if(rank is null) as bigint) n_unparsed, avg(coalesce(1.0 / rank, 0.0)) mrr, {_K} from r")
def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    from anchorline.plans.evaluate import gold_rank, ranking_scores

    return ranking_scores(responses(spark, d).select(gold_rank(F.col("ranking"), F.col("label")).alias("rank")))


@query("""with kb as (select qid, min(name) as name from entity_kb group by 1), x as (select d.doc_id, name, text from documents d join kb using (qid))
select doc_id, coalesce(coalesce(length(name), 0) > 0 and contains(lower(text), lower(name)), false) matched from x""")
def free_choice_match(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document names the entity it describes."""
    from anchorline.plans.evaluate import free_choice

    kb = read_table(spark, d, "entity_kb").groupBy("qid").agg(F.min("name").alias("name"))
    return read_table(spark, d, "documents").join(kb, "qid").select("doc_id", free_choice(F.col("text"), F.col("name")).alias("matched"))


_KB1 = """kb as (select qid, min(name) as name, min("desc") as "desc", min(intro) intro from entity_kb where qid is not null group by 1)"""


@query(f"""with {_KB1}, i as (select distinct instance_id, mention, answer, text_candidates from instances), r as (select instance_id, answer, unnest(text_candidates) q, generate_subscripts(text_candidates, 1) - 1 pos from i),
l as (select instance_id, answer, q, coalesce((q <> answer)::int, 1) k, pos, coalesce(name, '') || case when coalesce(length(coalesce(nullif(trim(split_part(coalesce(intro, ''), '. ', 1)), ''), "desc")), 0) > 0
  then ' - ' || coalesce(nullif(trim(split_part(coalesce(intro, ''), '. ', 1)), ''), "desc") else '' end line from r join kb on q = qid),
n as (select *, row_number() over (partition by instance_id order by k, pos, q) no from l)
select instance_id, string_agg(no || '. ' || line, chr(10) order by no) prompt, cast(coalesce(min(case when q = answer then no end), -1) as int) as label from n group by instance_id""")
def prompt_lines(spark: SparkSession, d: str) -> DataFrame:
    from anchorline.plans.evaluate import candidate_lines

    kb = read_table(spark, d, "entity_kb").filter("qid is not null").groupBy("qid").agg(F.min("name").alias("name"), F.min("desc").alias("desc"), F.min("intro").alias("intro"))
    rows = read_table(spark, d, "instances").select("instance_id", "mention", "answer", "text_candidates").distinct()
    return candidate_lines(rows, kb).select("instance_id", "prompt", "label")
